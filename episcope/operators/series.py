"""Case time series and top-k (TS-1..3, TOP-1, REP-6 series shape).

All series read the daily fact, so they never touch the case rows again.
Dates leave as ``yyyy-MM-dd`` / ``yyyy-MM`` text, the shape the series had in
the source's query results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.operators.metrics import anchor_day


def _check_months(n: int) -> None:
    if not 1 <= n <= 24:
        raise ValueError("months must be within 1..24")


def daily_cases(fact: DataFrame, last_n_days: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """TS-1: cases per day on the last ``n + 1`` calendar days; empty days stay absent."""
    if not 1 <= last_n_days <= 365:
        raise ValueError("days must be within 1..365")
    cut = F.date_sub(anchor_day(fact), last_n_days)
    out = (fact.where(F.col("day") >= cut)
           .groupBy(*keys, "day").agg(F.sum("cases").cast("bigint").alias("cases")))
    return (out.orderBy(*keys, "day")
            .select(*keys, F.date_format("day", "yyyy-MM-dd").alias("date"), "cases"))


def monthly_cases(fact: DataFrame, last_n_months: int = 12) -> DataFrame:
    """TS-2 / TOP-1: the last ``n`` *non-empty* months, in calendar order.

    ``orderBy(desc).limit(n)`` plans as a TakeOrderedAndProject (per-task top-n,
    then a merge); the final ascending sort touches at most ``n`` rows.
    """
    _check_months(last_n_months)
    monthly = (fact.groupBy(F.date_format("day", "yyyy-MM").alias("month"))
               .agg(F.sum("cases").cast("bigint").alias("cases")))
    return monthly.orderBy(F.col("month").desc()).limit(last_n_months).orderBy("month")


def monthly_cases_calendar(fact: DataFrame, last_n_months: int = 12) -> DataFrame:
    """TS-3: months after ``month(max) - n`` on the calendar; a gap month shortens it."""
    _check_months(last_n_months)
    first = F.add_months(F.trunc(anchor_day(fact), "MM"), -last_n_months)
    return (fact.where(F.trunc("day", "MM") > first)
            .groupBy(F.date_format("day", "yyyy-MM").alias("month"))
            .agg(F.sum("cases").cast("bigint").alias("cases"))
            .orderBy("month"))


def chart_series(fact: DataFrame, keys: Sequence[str] = (), last_n_days: int = 30,
                 last_n_months: int = 12) -> DataFrame:
    """REP-6: JSON-ready daily and monthly series, one row per group.

    Each array holds at most ``last_n_days + 1`` / ``last_n_months`` entries, so
    the per-group collect is bounded by the calendar, not by the data.
    """
    daily = daily_cases(fact, last_n_days, keys)
    dgroups = daily.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("date", "cases"))).alias("daily"))
    monthly = (fact.groupBy(*keys, F.date_format("day", "yyyy-MM").alias("month"))
               .agg(F.sum("cases").cast("bigint").alias("cases")))
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.col("month").desc()) if keys else \
        Window.orderBy(F.col("month").desc())
    mgroups = (monthly.withColumn("_rn", F.row_number().over(w))
               .where(F.col("_rn") <= last_n_months)
               .groupBy(*keys)
               .agg(F.array_sort(F.collect_list(F.struct("month", "cases"))).alias("monthly")))
    if keys:
        # Null-safe: the group without a key is one group.
        right = mgroups.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "monthly")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys])
        # Every group has a month, so the monthly side holds all of them.
        joined = right.join(dgroups, same, "left").select(
            *[F.col(f"_m_{k}").alias(k) for k in keys], "daily", "monthly")
    else:
        # National series: two one-value scalar subqueries on a one-row aggregate.
        joined = fact.agg(F.count(F.lit(1)).alias("_n")).select(
            dgroups.select("daily").scalar().alias("daily"),
            mgroups.select("monthly").scalar().alias("monthly"))
    return joined.select(*keys, F.coalesce(F.to_json("daily"), F.lit("[]")).alias("daily_json"),
                         F.coalesce(F.to_json("monthly"), F.lit("[]")).alias("monthly_json"))
