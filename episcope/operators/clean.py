"""Projection, typing and filters of the case table (PRJ-1..5, FIL-1..4, CLEAN).

``clean_cases`` is one narrow ``select`` + ``where``: a single stage with no
shuffle, so it streams through any input size at the scan's parallelism.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope import schema as S
from episcope.functions.cases import age_years, any_flag, coerce_code, coerce_date, flag
from episcope.functions.memo import columns_once


def prune_columns(raw: DataFrame) -> DataFrame:
    """PRJ-1: keep the 24 relevant columns; a missing one is an error."""
    missing = [c for c in S.RAW_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns in case file: {', '.join(missing)}")
    return raw.select(*S.RAW_COLUMNS)


def _typing_exprs(present: tuple[str, ...]) -> list[Column]:
    exprs = []
    for c in S.RAW_COLUMNS:
        if c not in present:
            exprs.append(F.lit(None).cast("int").alias(c))
        elif c in S.DATE_COLUMNS:
            exprs.append(coerce_date(c).alias(c))
        elif c in S.TEXT_COLUMNS:
            exprs.append(F.col(c).cast("string").alias(c))
        elif c == "NU_IDADE_N":
            exprs.append(F.col(c).cast("string").try_cast("double").alias(c))
        else:
            exprs.append(coerce_code(c).alias(c))
    return exprs


def type_columns(raw: DataFrame) -> DataFrame:
    """PRJ-2 + code typing: dates parsed, codes cast to INT, text kept as text."""
    present = tuple(c for c in S.RAW_COLUMNS if c in set(raw.columns))
    return raw.select(*columns_once(("typing", present), lambda: _typing_exprs(present)))


def _derived_exprs() -> list[Column]:
    return [
        age_years("NU_IDADE_N", "TP_IDADE").alias("IDADE_ANOS"),
        flag("EVOLUCAO", S.DEATH).alias("OBITO"),
        flag("UTI", S.YES).alias("INTERNOU_UTI"),
        any_flag(F.col("VACINA").eqNullSafe(S.YES),
                 F.col("VACINA_COV").eqNullSafe(S.YES)).alias("VACINADO"),
        flag("HOSPITAL", S.YES).alias("HOSPITALIZADO"),
    ]


def derive_columns(typed: DataFrame) -> DataFrame:
    """PRJ-3 + PRJ-4: age in years and the four 0/1 case flags."""
    return typed.select("*", *columns_once("derived", _derived_exprs))


def year_range(c: Column | str, year: int) -> Column:
    """``c`` in calendar ``year``, written as a range so it can reach a Parquet scan."""
    col = F.col(c) if isinstance(c, str) else c
    return (col >= F.lit(dt.date(year, 1, 1))) & (col < F.lit(dt.date(year + 1, 1, 1)))


def require_notification_date(df: DataFrame, column: str = "DT_NOTIFIC") -> DataFrame:
    """FIL-1: drop rows without a valid notification date."""
    return df.where(F.col(column).isNotNull())


def filter_year(df: DataFrame, year: int | None, column: str = "DT_NOTIFIC") -> DataFrame:
    """FIL-2: keep one calendar year (``None`` keeps everything)."""
    if year is None:
        return df
    return df.where(columns_once(("year", column, year), lambda: year_range(column, year)))


def half_open_range(df: DataFrame, column: str, start, end) -> DataFrame:
    """FIL-4: ``start <= column < end``."""
    return df.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def curate_columns(processed: DataFrame) -> DataFrame:
    """PRJ-5: the 22 lower-case columns of the curated table."""
    present = tuple(sorted(set(processed.columns) & {src for _, src in S.CURATED_COLUMNS}))
    return processed.select(*columns_once(("curate", present), lambda: [
        (F.col(src) if src in present else F.lit(None).cast("int")).alias(dst)
        for dst, src in S.CURATED_COLUMNS
    ]))


def clean_cases(raw: DataFrame, year: int | None = 2024, curated: bool = True) -> DataFrame:
    """CLEAN: type → derive → drop undated → keep ``year`` → curated columns.

    The year is a parameter (the source hard-codes one). Codes are cast to INT
    before comparison, so a text code ``'2'`` counts; see ``coerce_code``.
    """
    out = filter_year(require_notification_date(derive_columns(type_columns(raw))), year)
    return curate_columns(out) if curated else out


def last_n_days(df: DataFrame, n: int, column: str = "dt_notific",
                anchor: Column | None = None) -> DataFrame:
    """FIL-3: rows on or after ``max(column) - n`` days (n + 1 calendar days)."""
    if not 1 <= n <= 365:
        raise ValueError("days must be within 1..365")
    if anchor is None:
        anchor = df.agg(F.max(column)).scalar()
    return df.where(F.col(column) >= F.date_sub(anchor, n))
