"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate that brings its share of the mix, in bytes of
text, to its weight. A document's number of copies is the Poisson quantile, at that mean,
of a uniform number hashed from its key, so the mix does not depend on order,
partitioning or retries. Copies are exploded and shuffled globally by a hash of their own.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.llm.common import struct_of

REST = "rest"  # the pool of all sources without a weight of their own, NULL among them
TAIL = 1e-17  # of the distribution left out above its table: less than a hashed number can tell


def hashed_uniform(seed: str, *parts: Column) -> Column:
    """Uniform in (0, 1) from 52 bits of an MD5; NULL parts hash as ``null``."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_table(rate: Column) -> Column:
    """``(first, cdf)``: cumulative probabilities of a Poisson variable from ``first`` on.

    Terms are built in logarithms from zero up; the table spans the mean by twelve standard
    deviations and a margin, beyond which less than ``TAIL`` is left on either side.
    """
    spread = F.lit(12.0) * F.sqrt(rate) + 40
    first = F.greatest(F.floor(rate - spread), F.lit(0)).cast("int")
    last = F.ceil(rate + spread).cast("int")
    log_first = F.aggregate(
        F.sequence(F.lit(0), first), F.lit(0.0),
        lambda acc, k: F.when(k == 0, -rate).otherwise(acc + F.log(rate) - F.log(k.cast("double"))))
    start = F.struct(log_first.alias("log_p"), F.exp(log_first).alias("total"), F.array(F.exp(log_first)).alias("cdf"))
    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.array_append(acc["cdf"], total).alias("cdf"))
    return F.struct(first.alias("first"), F.aggregate(F.sequence(first + 1, last), start, step, lambda acc: acc["cdf"]).alias("cdf"))


def repetition_rates(docs: DataFrame, weights: Mapping[str, float], epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row per weighted pool that has documents: ``pool``, ``rate``, ``n_docs``, ``n_bytes``.

    ``rate`` is ``weight / sum of weights of pools with bytes * epochs * all bytes / pool's bytes``.
    A pool whose texts are all empty repeats by ``epochs``. At most as many rows as weights.
    """
    total_weight = sum(weights.values())
    if not weights or min(weights.values()) < 0 or total_weight <= 0:
        raise ValueError("weights must be at least zero, and one above")
    sizes = (docs.select(_pool(docs, weights, source).alias("pool"), F.coalesce(F.octet_length(docs[f"`{text}`"]), F.lit(0)).cast("long").alias("b"))
             .groupBy("pool").agg(F.count("*").alias("n_docs"), F.sum("b").alias("n_bytes")))
    weight = F.coalesce(*[F.when(F.col("pool") == k, F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    rows = sizes.withColumn("weight", weight)
    # At most one row per weight, in one window.
    every = Window.partitionBy(F.lit(0))
    rows = rows.select("*", F.sum(F.when(F.col("n_bytes") > 0, F.col("weight"))).over(every).alias("all_weight"),
                       F.sum("n_bytes").over(every).alias("all_bytes"))
    rate = (F.when(F.col("weight") == 0, 0.0).when(F.col("n_bytes") == 0, F.lit(float(epochs)))
            .otherwise(F.col("weight") / F.col("all_weight") * float(epochs) * F.col("all_bytes") / F.col("n_bytes")))
    return rows.select("pool", rate.alias("rate"), "n_docs", "n_bytes")


def _pool(docs: DataFrame, weights: Mapping[str, float], source: str) -> Column:
    own = docs[f"`{source}`"].cast("string")
    named = [k for k in weights if k != REST]
    return F.when(own.isin(named), own).otherwise(REST) if named else F.lit(REST)


def mix(docs: DataFrame, weights: Mapping[str, float], epochs: float = 1.0, seed: str = "mix", key: str = "doc_id",
        source: str = "source", text: str = "text", shuffled: bool = True, number: str | None = "copy") -> DataFrame:
    """Every copy of every document of the mix: the columns of ``docs`` and, as ``number``, which copy it is (from 0).

    ``weights`` gives sources their share of the mix; ``rest`` stands for all others,
    which get none if it is missing. The mix is expected to hold ``epochs`` times the bytes
    of ``docs``. Copies are dealt and sorted by a hash of key and copy: a global shuffle.
    Rows with the same key repeat equally often. A column of the input called as ``number``
    is replaced; without ``number`` all columns keep their content and none is added.
    """
    rates = repetition_rates(docs, weights, epochs, source, text)
    tables = rates.select(F.col("pool").alias("pool_of"), "rate", F.when(F.col("rate") > 0, poisson_table(F.col("rate"))).alias("table"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != number]
    body = docs[f"`{key}`"]
    drawn = docs.select(struct_of(docs, "row"), body.alias("key"), _pool(docs, weights, source).alias("pool"), hashed_uniform(seed, body).alias("u"))
    # At most one row per weight on the other side.
    joined = drawn.join(F.broadcast(tables), F.col("pool") == F.col("pool_of"))
    copies = F.when(F.col("rate") > 0, F.col("table.first") + F.size(F.filter("table.cdf", lambda c: c < F.col("u")))).otherwise(0)
    out = (joined.withColumn("copies", copies).where("copies > 0")
           .select("row", "key", F.explode_outer(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")))
    if shuffled:
        # Hashed keys deal evenly whatever the source; the sort puts each part in random order.
        place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("copy")))
        out = out.withColumn("place", place).repartition("place").sortWithinPartitions("place")
    return out.select(*kept, *([F.col("copy").alias(number)] if number else []))
