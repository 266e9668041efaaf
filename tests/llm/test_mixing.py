import math

import pytest
from pyspark.sql import functions as F

from episcope.llm import mixing
from tests.llm.helpers import SCHEMA, documents, odd_documents, rows


def quantile(u, rate):
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total < u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_poisson_table_is_the_distribution(spark):
    for rate in (0.01, 0.7, 3.0, 45.0, 900.0, 20_000.0):
        first, cdf = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("t")).select("t.first", "t.cdf").first()
        log_p = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(first, first + len(cdf))]
        total = 0.0
        for got, lp in zip(cdf, log_p, strict=True):
            total += math.exp(lp)
            assert abs(got - total) < 1e-8  # sums of up to 20,000 logarithms
        assert abs(cdf[-1] - 1) < 1e-7 and (first == 0 or cdf[0] < 1e-15)


def test_copies_are_the_quantile_of_the_hashed_number(spark):
    docs = documents(spark, ["t" * (1 + k % 7) for k in range(400)]).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    weights = {"a": 0.7, "b": 0.1, "rest": 0.2}
    rates = {r["pool"]: r["rate"] for r in mixing.repetition_rates(docs, weights, 2.0).collect()}
    got = {r["doc_id"]: r["n"] for r in mixing.mix(docs, weights, 2.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in docs.withColumn("u", mixing.hashed_uniform("mix", F.col("doc_id"))).collect():
        assert got.get(r["doc_id"], 0) == quantile(r["u"], rates[r["source"] or "rest"])
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    for pool, w in weights.items():
        size = docs.where(F.coalesce("source", F.lit("rest")) == pool).agg(F.sum(F.octet_length("text"))).first()[0]
        assert rates[pool] * size == pytest.approx(w * 2.0 * total)


def test_shares_reach_the_weights_with_a_hot_source(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("some text of a document").alias("text"),
                                      F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 300 == 0, "rare").otherwise("cold").alias("source"))
    mixed = mixing.mix(docs, {"hot": 0.25, "rare": 0.25, "cold": 0.5}, 1.0)
    share = {r["source"]: r["n"] / 30_000 for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert share["hot"] == pytest.approx(0.25, abs=0.02) and share["rare"] == pytest.approx(0.25, abs=0.04) and share["cold"] == pytest.approx(0.5, abs=0.03)
    assert mixed.select("doc_id", "copy").distinct().count() == mixed.count()
    # A global shuffle: neighbours in the result are not neighbours in the input.
    order = [r["doc_id"] for r in mixed.limit(1000).collect()]
    assert sum(abs(a - b) < 100 for a, b in zip(order, order[1:])) < 50


def test_order_and_partitioning_do_not_matter(spark):
    docs = documents(spark, [f"text {k}" for k in range(200)])
    one = rows(mixing.mix(docs.coalesce(1), {"a": 1.0}, 1.5), "doc_id", "copy")
    assert one == rows(mixing.mix(docs.repartition(7).orderBy(F.rand(1)), {"a": 1.0}, 1.5), "doc_id", "copy")


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumn("source", F.when(F.col("doc_id") < 6, F.col("source"))).withColumn("copy", F.lit("mine")).withColumn("_u", F.lit(1))
    out = mixing.mix(docs.drop("_u"), {"a": 1.0, "rest": 1.0}, 3.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and dict(out.dtypes)["copy"] == "int"
    assert mixing.mix(docs.drop("_u"), {"zzz": 1.0}).count() == 0  # no pool has a document
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty, {"a": 1.0}).count() == 0
    blank = documents(spark, ["", None, ""])
    assert mixing.repetition_rates(blank, {"a": 1.0}, 2.0).first()["rate"] == 2.0
    for bad in ({}, {"a": 0.0}, {"a": -1.0, "b": 2.0}):
        with pytest.raises(ValueError):
            mixing.repetition_rates(docs, bad)


def test_main_path_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mix(docs, {"src0": 0.5, "rest": 0.5})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
