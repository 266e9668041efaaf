"""Surveillance indicators (AGG-1..8) over one shared daily aggregate.

Plan shape: the case table is scanned once into the *daily fact*
``(day[, keys]) -> cases, deaths, icu, vaccinated``. Its partial aggregation runs
map-side, so the shuffle carries at most one row per (task, day, key) no matter
how skewed a region or day is, and the fact itself holds at most ~366 rows per
year and key. Every rate, the growth windows, the series and the per-region
variants are computed from the fact; the "last date" anchor is a scalar
subquery over the fact (one value, no join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope import schema as S


def daily_fact(cases: DataFrame, keys: Sequence[str] = (), date_col: str = "dt_notific") -> DataFrame:
    """One row per (day, keys): case count and the three flag sums (all BIGINT)."""
    return (cases.groupBy(F.col(date_col).alias("day"), *keys)
            .agg(F.count(F.lit(1)).alias("cases"),
                 F.sum("obito").cast("bigint").alias("deaths"),
                 F.sum("internou_uti").cast("bigint").alias("icu"),
                 F.sum("vacinado").cast("bigint").alias("vaccinated")))


def anchor_day(fact: DataFrame) -> Column:
    """Last notification day as a scalar subquery (global for all groups)."""
    return fact.agg(F.max("day")).scalar()


def percent(part: Column, total: Column) -> Column:
    """``part / total * 100`` as DOUBLE; 0.0 for an empty total (AGG-2 guard)."""
    return F.coalesce(F.try_divide(part.cast("double"), total) * 100, F.lit(0.0))


def growth(cur: Column, prev: Column) -> Column:
    """AGG-5: ``(cur - prev) / prev * 100``; 0.0 when there is no previous case."""
    return F.when(prev > 0, F.try_divide((cur - prev).cast("double"), prev) * 100).otherwise(F.lit(0.0))


def _window_sum(day: Column, start: Column, end: Column | None = None) -> Column:
    cond = day >= start if end is None else (day >= start) & (day < end)
    return F.sum(F.when(cond, F.col("cases")).otherwise(F.lit(0))).cast("bigint")


def metric_aggregates(anchor: Column, period_days: int = 30) -> list[Column]:
    """Aggregate expressions of AGG-1..5 over a daily fact, in one pass.

    Growth keeps the source's asymmetry: the current window spans P + 1 days
    (``day >= anchor - P``) and the previous one P days.
    """
    if not 1 <= period_days <= 365:
        raise ValueError("period_days must be within 1..365")
    day = F.col("day")
    cur_start = F.date_sub(anchor, period_days)
    prev_start = F.date_sub(anchor, 2 * period_days)
    return [
        F.sum("cases").cast("bigint").alias("_total"),
        F.sum("deaths").cast("bigint").alias("_deaths"),
        F.sum("icu").cast("bigint").alias("_icu"),
        F.sum("vaccinated").cast("bigint").alias("_vacc"),
        _window_sum(day, cur_start).alias("_cur"),
        _window_sum(day, prev_start, cur_start).alias("_prev"),
    ]


def finish_metrics(agg: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Turn the raw sums into the metrics record (five named columns)."""
    total = F.coalesce(F.col("_total"), F.lit(0)).cast("bigint")
    return agg.select(
        *keys,
        growth(F.col("_cur"), F.col("_prev")).alias(S.M_GROWTH),
        percent(F.coalesce(F.col("_deaths"), F.lit(0)), F.col("_total")).alias(S.M_MORTALITY),
        percent(F.coalesce(F.col("_icu"), F.lit(0)), F.col("_total")).alias(S.M_ICU),
        percent(F.coalesce(F.col("_vacc"), F.lit(0)), F.col("_total")).alias(S.M_VACCINATION),
        total.alias(S.M_TOTAL),
    )


def all_metrics(fact: DataFrame, period_days: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-6 (flagship): growth, mortality, ICU, vaccination and total in one aggregate.

    With ``keys`` this is AGG-8: one row per group, all groups sharing the global
    anchor day so their growth windows cover the same calendar days.
    """
    aggs = metric_aggregates(anchor_day(fact), period_days)
    agg = fact.groupBy(*keys).agg(*aggs) if keys else fact.agg(*aggs)
    return finish_metrics(agg, keys)


def metrics_rollup(fact: DataFrame, key: str = "sg_uf", period_days: int = 30) -> DataFrame:
    """AGG-8 with a national total row via ``rollup`` on the fact.

    ``is_total`` tells that row from the one of cases without a region: ``key`` is NULL in both.
    """
    agg = fact.rollup(key).agg(*metric_aggregates(anchor_day(fact), period_days), (F.grouping_id() == 1).alias("is_total"))
    return finish_metrics(agg, [key, "is_total"])


def total_cases(fact: DataFrame) -> DataFrame:
    """AGG-1: ``COUNT(*)`` as BIGINT."""
    return fact.agg(F.coalesce(F.sum("cases"), F.lit(0)).cast("bigint").alias(S.M_TOTAL))


def _rate(fact: DataFrame, column: str, name: str) -> DataFrame:
    return fact.agg(percent(F.coalesce(F.sum(column), F.lit(0)), F.sum("cases")).alias(name))


def mortality_rate(fact: DataFrame) -> DataFrame:
    """AGG-2: deaths per case, percent."""
    return _rate(fact, "deaths", S.M_MORTALITY)


def icu_rate(fact: DataFrame) -> DataFrame:
    """AGG-3: ICU admissions per case, percent (the source calls it occupancy)."""
    return _rate(fact, "icu", S.M_ICU)


def vaccination_rate(fact: DataFrame) -> DataFrame:
    """AGG-4: vaccinated per case (unknown status in the denominator), percent."""
    return _rate(fact, "vaccinated", S.M_VACCINATION)


def growth_rate(fact: DataFrame, period_days: int = 30) -> DataFrame:
    """AGG-5: case growth of the last window against the one before."""
    aggs = metric_aggregates(anchor_day(fact), period_days)
    return fact.agg(*aggs).select(growth(F.col("_cur"), F.col("_prev")).alias(S.M_GROWTH))


def describe_cases(cases: DataFrame, exact_median: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-7: counts, rates, mean and median age (NULLs skipped), first and last day, for each group of ``keys``.

    The exact median keeps a value→count map per partial aggregate, so its
    memory follows the number of *distinct* ages (a few thousand), not rows;
    ``exact_median=False`` switches to ``percentile_approx``.
    """
    age = F.col("idade_anos")
    median = F.median(age) if exact_median else F.percentile_approx(age, 0.5, 10000)
    n = F.count(F.lit(1))
    return cases.groupBy(*keys).agg(
        n.cast("bigint").alias("total_casos"),
        F.coalesce(F.sum("obito"), F.lit(0)).cast("bigint").alias("total_obitos"),
        F.coalesce(F.sum("internou_uti"), F.lit(0)).cast("bigint").alias("total_uti"),
        F.coalesce(F.sum("vacinado"), F.lit(0)).cast("bigint").alias("total_vacinados"),
        percent(F.coalesce(F.sum("obito"), F.lit(0)), n).alias("taxa_mortalidade"),
        percent(F.coalesce(F.sum("internou_uti"), F.lit(0)), n).alias("taxa_uti"),
        percent(F.coalesce(F.sum("vacinado"), F.lit(0)), n).alias("taxa_vacinacao"),
        F.round(F.avg(age), 6).alias("idade_media"),
        F.round(median, 6).alias("idade_mediana"),
        F.date_format(F.min("dt_notific"), "yyyy-MM-dd").alias("data_inicio"),
        F.date_format(F.max("dt_notific"), "yyyy-MM-dd").alias("data_fim"),
    )
