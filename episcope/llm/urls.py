"""URL filters: host-suffix x path-prefix expressions against a hashed rule list.

Each URL is expanded into the expressions a rule could have (a suffix of its host by
whole labels, joined to a prefix of its path), restricted to the label counts and path
lengths that occur in the rules. Expressions meet rules in an equi-join on a short
prefix of their SHA-256; the full digest then confirms the match, and the most specific
rule of each URL decides. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.llm.common import struct_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8  # four bytes of the digest
MAX_BROADCAST_RULES = 100_000  # at most some 20 MB of digests and strings


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(host, path, action)`` as a DataFrame; ``action`` is ``allow`` or ``block``."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "action")])
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.

    Empty when the URL is NULL or has no ``://``.
    """
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and every subdomain if the path starts with the rule's path.
    Of several fitting rules the longest host-and-path wins, then the longest host;
    if one rule is listed both ways, ``block`` wins. Without a rule, ``rule`` is NULL
    and the verdict is ``default``. Result columns replace input columns of the same
    name; every row is judged by itself, so repeated rows and NULL keys stay.
    """
    rules = rules.select(
        "action", F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule"), F.length("path").alias("path_len"),
        F.size(F.split("host", r"\.")).alias("labels")).withColumn("digest", F.sha2("rule", 256))
    # Metadata of the rule list: distinct label counts and path lengths, both bounded by URL length.
    labels = sorted(r[0] for r in rules.select("labels").distinct().collect())
    lengths = sorted(r[0] for r in rules.select("path_len").distinct().collect())
    listed = rules.select(
        F.substring("digest", 1, PREFIX_HEX).alias("rule_prefix"), F.col("digest").alias("rule_digest"),
        F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("n_host"),
                 (F.col("action") == "block").cast("int").alias("block"), F.col("rule"), F.col("action")).alias("found"))
    if rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES:
        listed = F.broadcast(listed)

    parts = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*[
        F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, F.lit(n)), ".")) for n in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    # The id only keeps the expressions of one row together; it is made and used within one plan.
    rows = pages.select(struct_of(pages, "row"), F.monotonically_increasing_id().alias("row_id"),
                        url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    if labels and lengths:
        expressions = F.when(F.col("host") != "", F.flatten(
            F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))
        best = (rows.select("*", F.explode_outer(expressions).alias("expression"))
                .withColumn("digest", F.sha2("expression", 256))
                .withColumn("digest_prefix", F.substring("digest", 1, PREFIX_HEX))
                .join(listed, F.col("digest_prefix") == F.col("rule_prefix"), "left")
                .groupBy("row_id")
                .agg(F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"),
                     F.max(F.when(F.col("digest") == F.col("rule_digest"), F.col("found"))).alias("best")))
    else:
        best = rows.withColumn("best", F.lit(None).cast("struct<rule:string,action:string>"))
    made = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("best.rule"),
            "verdict": F.coalesce("best.action", F.lit(default))}
    kept = [F.col(f"row.`{c}`") for c in pages.columns if c not in made]
    return best.select(*kept, *[v.alias(k) for k, v in made.items()])
