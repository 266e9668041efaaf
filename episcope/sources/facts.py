"""The maintained daily fact of a curated table (AGG-6..8, TS-1..3 without a case scan).

The fact holds a row for each day and region: case count, flag sums, and of the ages their
number, sum and a mergeable quantile sketch (KLL). It is stored by year beside the curated
table, and notes of which loads each year was made: ``refresh_daily_fact`` computes only years
whose loads have changed. Every indicator, series and description of any window or
region then reads the fact, whose size follows days and regions, not cases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.operators.metrics import percent
from episcope.sources import versions

#: Sketch size: the rank of a quantile is off by 1.65 % at most, with a probability of 99 % (KLL with k = 200).
SKETCH_K = 200
RANK_ERROR = 0.0165


def daily_fact_with_ages(curated: DataFrame, keys: Sequence[str] = ("sg_uf",)) -> DataFrame:
    """``daily_fact`` by ``year``, day and ``keys``, with ``ages``, ``age_sum`` and ``age_sketch`` (NULL without ages)."""
    age = F.col("idade_anos").cast("double")
    counted = curated.groupBy("year", F.col("dt_notific").alias("day"), *keys).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("obito").cast("bigint").alias("deaths"),
        F.sum("internou_uti").cast("bigint").alias("icu"), F.sum("vacinado").cast("bigint").alias("vaccinated"),
        F.count(age).alias("ages"), F.sum(age).alias("age_sum"), F.kll_sketch_agg_double(age, SKETCH_K).alias("age_sketch"))
    return counted.withColumn("age_sketch", F.when(F.col("ages") > 0, F.col("age_sketch")))


def _signature(loads: list[str]) -> str:
    return ",".join(loads)


def stale_years(spark: SparkSession, curated_root: str, fact_root: str) -> list[str]:
    """Years of the curated table that the fact does not hold as they are now, and years that it holds no more."""
    cases, fact = versions.head(spark, curated_root), versions.head(spark, fact_root)
    wanted = {y: _signature(loads) for y, loads in cases.parts.items()}
    return sorted({y for y in {*wanted, *fact.notes} if wanted.get(y) != fact.notes.get(y)})


def refresh_daily_fact(spark: SparkSession, curated_root: str, fact_root: str, keys: Sequence[str] = ("sg_uf",)) -> list[str]:
    """Bring the fact up to date; returns the years computed anew. Nothing is read if no load has changed.

    The fact is made from one state of the curated table. A load that comes meanwhile is
    seen by the next refresh.
    """
    state = versions.head(spark, curated_root)
    stale = stale_years(spark, curated_root, fact_root)
    if stale:
        years = [None if y == versions.NULL_PARTITION else int(y) for y in stale]
        notes = {y: _signature(state.parts[y]) for y in stale if y in state.parts}
        versions.replace(daily_fact_with_ages(versions.read(spark, curated_root, years, state), keys), fact_root, "year", years, notes)
    return stale


def read_daily_fact(spark: SparkSession, fact_root: str, year: int | None = None) -> DataFrame:
    """The fact, or one year of it: a ``daily_fact`` with more columns, for all operators on facts."""
    return versions.read(spark, fact_root, None if year is None else [year])


def _quantile(sketch: Column, n: Column, q: float) -> Column:
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(q)))


def describe_fact(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-7 from the fact, for any days and regions that ``fact`` holds: sketches are merged, no case is read.

    All columns but the median are exact; ``idade_mediana`` is the value of a rank within
    ``RANK_ERROR`` of the middle one.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    merged = fact.groupBy(*keys).agg(
        total("cases").alias("total_casos"), total("deaths").alias("total_obitos"), total("icu").alias("total_uti"),
        total("vaccinated").alias("total_vacinados"), F.sum("ages").alias("_ages"), F.sum("age_sum").alias("_age_sum"),
        F.kll_merge_agg_double("age_sketch").alias("_sketch"),
        F.date_format(F.min("day"), "yyyy-MM-dd").alias("data_inicio"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("data_fim"))
    cases = F.col("total_casos")
    return merged.select(
        *keys, "total_casos", "total_obitos", "total_uti", "total_vacinados",
        percent(F.col("total_obitos"), cases).alias("taxa_mortalidade"), percent(F.col("total_uti"), cases).alias("taxa_uti"),
        percent(F.col("total_vacinados"), cases).alias("taxa_vacinacao"),
        F.round(F.try_divide("_age_sum", "_ages"), 6).alias("idade_media"),
        _quantile(F.col("_sketch"), F.col("_ages"), 0.5).alias("idade_mediana"), "data_inicio", "data_fim")
