"""Scalar column expressions for case cleaning (PRJ-2, PRJ-3, PRJ-4).

All of them are built-in Catalyst expressions, so they run inside whole-stage
codegen; there is no Python on the row path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from episcope import schema as S

# Day-month-year pattern that accepts one- or two-digit months and days
# ("2024-1-5") but rejects a time suffix, blanks and empty strings.
DATE_PATTERN = "yyyy-M-d"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_date(c: Column | str) -> Column:
    """PRJ-2: text -> DATE; anything that does not parse becomes NULL.

    The canonical ``yyyy-MM-dd`` shape takes the cast parser (no formatter);
    any other text goes through the ``yyyy-M-d`` pattern. Both reject
    impossible dates, so the result is the same as the pattern alone.
    """
    s = _col(c).cast("string")
    canonical = s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(canonical, s.try_cast("date")).otherwise(F.try_to_date(s, DATE_PATTERN))


def coerce_code(c: Column | str) -> Column:
    """Coded answer -> INT; a dirty value becomes NULL instead of failing.

    Deviation on purpose: text codes are cast, so ``'2'`` counts as 2, and so does the
    ``2.0`` that a nullable code column becomes in CSV; other fractions are dirty.
    """
    n = _col(c).cast("string").try_cast("double")
    return F.when(n == F.floor(n), n.try_cast("int"))


def age_years(amount: Column | str, unit: Column | str) -> Column:
    """PRJ-3: age in years from an amount and its unit code; other units -> NULL."""
    n = _col(amount).cast("string").try_cast("double")
    u = _col(unit)
    return (F.when(u == S.AGE_YEARS, n)
            .when(u == S.AGE_MONTHS, n / 12)
            .when(u == S.AGE_DAYS, n / 365)
            .when(u == S.AGE_HOURS, n / (365 * 24)))


def flag(c: Column | str, value: int) -> Column:
    """PRJ-4: 1 when the code equals ``value``, else 0 — an unknown code counts as 0."""
    return _col(c).eqNullSafe(F.lit(value)).cast("int")


def any_flag(*conds: Column) -> Column:
    """0/1 flag that is 1 when any null-safe comparison holds."""
    out = conds[0]
    for cond in conds[1:]:
        out = out | cond
    return out.cast("int")
