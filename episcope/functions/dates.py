"""Feed date parsing (NEWS-2, NEWS-2b), in Spark expressions.

An RFC 822 stamp is taken apart by one regular expression: day and month (short or full
English name, in either order), year of two or four digits, time, zone; a weekday before
and comments after them are skipped. The written day gives the *local* calendar date, and
the zone turns the written time into an instant (unknown or missing zones read as UTC).
ISO 8601 stamps, extended, basic or by week, give a date but no sort instant, so they sort
after every RFC one. A day, time or offset out of range makes the whole stamp unreadable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours that the named zones of RFC 822 are off UTC; other names read as UTC.
ZONE_HOURS = {
    "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
# The English months, readable by their first three letters or in full.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_SEP = "\u0001"  # between the parts of a stamp
_DAY_NAME = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?|[^\\s,]*,)"
_MONTH = "(?:" + "|".join(m if len(m) == 3 else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + ")"
_RFC = (rf"(?is)^\s*(?:{_DAY_NAME}\s*)?(?:(\d{{1,2}})(?:-(?=\S+\s+\S+\s+\S+\s*$)({_MONTH})-|\s+({_MONTH})\s+)|({_MONTH})\s+(\d{{1,2}}),?\s+)(\d{{1,4}}),?\s+"
        r"(\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2}))?(?:\s*([+-]\d{1,4})(?!\d)|\s+(\S+))?(?:\s.*)?$")
_ZONE = r"(?:[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?"
_CLOCK = r"(?:[01]\d|2[0-3])(?:(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)|(?:[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?))?"
_ISO_DAY = rf"(?s)^(\d{{4}})(-?)(\d\d)\2(\d\d)(?:.{_CLOCK} ?{_ZONE})?$"
_ISO_WEEK = rf"(?s)^(\d{{4}})(-?)W(\d\d)(?:\2([1-7])(?:.{_CLOCK} ?{_ZONE})?)?$"


def _read(raw: Column, pattern: str, n_groups: int, build: Callable[[Column], Column]) -> Column:
    """``build(groups)`` of a stamp that ``pattern`` matches, NULL otherwise; a group left out is empty.

    The groups are bound as a lambda's variable: every part of a stamp reads them, and the
    regular expression runs once.
    """
    taken = F.split(F.regexp_replace(raw, pattern, _SEP.join(f"${k}" for k in range(1, n_groups + 1))), _SEP, -1)
    return F.get(F.transform(F.array(taken), lambda p: F.when(F.size(p) == n_groups, build(p))), 0)


def _number(part: Column) -> Column:
    return F.nullif(part, F.lit("")).cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date; NULL if there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day))


def _rfc_instant(p: Column) -> Column:
    """Of an RFC 822 stamp's groups ``(day at midnight, instant)``; NULL if day, time or offset are out of range."""
    # Day and month may stand in several places; all but one are empty.
    name = F.lower(F.left(F.concat(F.get(p, 1), F.get(p, 2), F.get(p, 3)), F.lit(3)))
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name).cast("int")
    short = _number(F.get(p, 5))
    year = short + F.when(short >= 100, 0).when(short > 68, 1900).otherwise(2000)
    hour, minute, second = _number(F.get(p, 6)), _number(F.get(p, 7)), F.coalesce(_number(F.get(p, 8)), F.lit(0))
    digits = _number(F.get(p, 9))
    of_digits = F.signum(digits).cast("int") * (F.floor(F.abs(digits) / 100) * 3600 + F.abs(digits) % 100 * 60)
    named = F.create_map(*[F.lit(x) for pair in ZONE_HOURS.items() for x in pair])[F.upper(F.get(p, 10))]
    offset = F.coalesce(of_digits, named * 3600, F.lit(0)).cast("int")
    written = F.unix_date(_day(year, month, _number(F.concat(F.get(p, 0), F.get(p, 4))))).cast("long") * 86400
    good = (hour < 24) & (minute < 60) & (second < 60) & (F.abs(offset) < 86400) & written.isNotNull()
    return F.when(good, F.struct(F.timestamp_seconds(written).alias("day"),
                                 F.timestamp_seconds(written + hour * 3600 + minute * 60 + second - offset).alias("instant")))


def _iso_week_day(p: Column) -> Column:
    # The 4th of January is in week 1; a week that the year does not have falls into another one.
    first = F.date_trunc("week", _day(F.get(p, 0).cast("int"), F.lit(1), F.lit(4))).cast("date")
    week = F.get(p, 2).cast("int")
    day = F.date_add(first, 7 * (week - 1) + F.coalesce(_number(F.get(p, 3)), F.lit(1)) - 1)
    return F.when(F.weekofyear(day) == week, day.cast("timestamp"))


def sort_instant(raw: Column) -> Column:
    """NEWS-2b: UTC instant of an RFC 822 stamp; NULL otherwise (sorts last)."""
    return _read(raw, _RFC, 11, _rfc_instant)["instant"]


def normalize_date(raw: Column) -> Column:
    """NEWS-2: ``yyyy-MM-dd`` local date of an RFC 822 or ISO 8601 stamp; NULL if neither."""
    utc = F.replace(raw, F.lit("Z"), F.lit("+00:00"))
    by_day = _read(utc, _ISO_DAY, 4, lambda p: _day(*[F.get(p, k).cast("int") for k in (0, 2, 3)]).cast("timestamp"))
    by_week = _read(utc, _ISO_WEEK, 4, _iso_week_day)
    return F.date_format(F.coalesce(_read(raw, _RFC, 11, _rfc_instant)["day"], by_day, by_week), "yyyy-MM-dd")


def epoch_micros(df_schema, column: str) -> Column:
    """Microseconds since 1970-01-01 for a TIMESTAMP or TIMESTAMP_NTZ column.

    A zone-less timestamp is measured on its wall clock (no session time zone
    involved); a zoned one is an instant (``unix_micros``).
    """
    from pyspark.sql import types as T
    if isinstance(df_schema[column].dataType, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(column))
    return F.unix_micros(F.col(column).cast("timestamp"))
