"""Scalar text expressions: number formats, whitespace, HTML and query cleanup.

Everything except entity decoding is a built-in expression. Patterns carry
``(?U)`` so ``\\s`` and ``\\d`` follow Unicode like Python's ``re``.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt2(x: Column | str) -> Column:
    """Two decimals, no grouping, rounding like Python's ``format(x, '.2f')``."""
    return F.call_function("format_number", _col(x).cast("double"), F.lit("0.00"))


def fmt_int(x: Column | str) -> Column:
    """Integer with ``,`` thousands separators (Python ``f'{n:,}'``)."""
    return F.format_number(_col(x).cast("bigint"), 0)


def fill(template: str, *values: Column) -> Column:
    """``template`` with each ``{}`` replaced by the next column, as one ``concat``."""
    pieces = template.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError("template placeholders and values differ in number")
    parts: list[Column] = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def collapse_ws(c: Column | str) -> Column:
    """Runs of whitespace → one blank, then trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def capitalize(c: Column | str) -> Column:
    """Python ``str.capitalize``: first letter upper, the rest lower."""
    s = _col(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


# --- fixed values: characters removed from a search query, and its length limit ---
QUERY_STRIP = r"""[<>"'%;()&+]"""
QUERY_MAX = 200


def sanitize_query(c: Column | str) -> Column:
    """GRD-2: delete ``< > " ' % ; ( ) & +`` and keep the first 200 characters."""
    return F.substring(F.regexp_replace(_col(c), QUERY_STRIP, ""), 1, QUERY_MAX)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else html.unescape(v))


# --- fixed values: entities decoded JVM-side, "&amp;" last so nothing decodes twice ---
COMMON_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)


def unescape_entities(c: Column | str) -> Column:
    """HTML entities → characters, as Python's ``html.unescape``.

    Text whose every ``&`` starts one of the common entities is decoded with
    JVM-side replaces (with ``&amp;`` last this equals one left-to-right pass).
    Only text holding other entities (or a bare ``&``) is sent to Python; the
    others pass NULL to the UDF, so Python sees almost no data.
    """
    s = _col(c)
    rest = s
    decoded = s
    for entity, char in COMMON_ENTITIES:
        rest = F.replace(rest, F.lit(entity), F.lit(""))
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    needs_python = s.contains("&") & rest.contains("&")
    return (F.when(~s.contains("&"), s)
            .when(needs_python, _unescape(F.when(needs_python, s)))
            .otherwise(decoded))


# In one pass, from left to right as a parser reads: elements whose text it does not report, comments,
# then any other tag. A tag begins with a letter, ``/``, ``!`` or ``?``; quoted attribute values may hold
# ``>``. Possessive, so that an unclosed tag costs one pass.
_HIDDEN = "|".join(rf"<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "template"))
_MARKUP = rf"""(?is){_HIDDEN}|<!--.*?(?:-->|\z)|<[/!?a-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""


def strip_markup(c: Column | str) -> Column:
    """Hidden blocks and tags replaced by blanks (entities still encoded)."""
    return F.regexp_replace(_col(c), _MARKUP, " ")


def html_text(c: Column | str) -> Column:
    """Visible text of an HTML fragment: hidden blocks dropped, tags → blanks, entities decoded."""
    return unescape_entities(strip_markup(c))


def truncate_summary(text: Column, max_length: int = 320) -> Column:
    """Cut already collapsed text longer than ``max_length`` and add ``…``."""
    cut = F.concat(F.rtrim(F.substring(text, 1, max_length)), F.lit("…"))
    return F.when(F.length(text) > max_length, cut).otherwise(text)


def clean_summary(c: Column | str, max_length: int = 320) -> Column:
    """NEWS-1: visible text, whitespace collapsed; longer than ``max_length`` → cut + ``…``.

    For large tables prefer ``with_clean_summary``, which stages the
    intermediate texts as columns so no regex pass is repeated.
    """
    out = truncate_summary(collapse_ws(html_text(c)), max_length)
    return F.when(_col(c).isNull() | (_col(c) == ""), F.lit("")).otherwise(out)


def with_clean_summary(df: DataFrame, source: str, out: str, max_length: int = 320,
                       text_out: str | None = None) -> DataFrame:
    """NEWS-1 as staged columns: strip → decode → collapse → cut, each pass once.

    ``text_out`` also keeps the whole collapsed text under that name.
    """
    src = F.col(source)
    staged = (df.withColumn("_markup_free", strip_markup(src))
              .withColumn("_decoded", unescape_entities(F.col("_markup_free")))
              .withColumn("_collapsed", collapse_ws(F.col("_decoded"))))
    summary = F.when(src.isNull() | (src == ""), F.lit("")).otherwise(
        truncate_summary(F.col("_collapsed"), max_length))
    out_df = staged.withColumn(out, summary)
    if text_out:
        out_df = out_df.withColumn(text_out, F.col("_collapsed"))
    return out_df.drop("_markup_free", "_decoded", "_collapsed")


def extract_title(c: Column | str) -> Column:
    """Text of the first ``<title>`` element (empty when absent)."""
    return F.regexp_extract(_col(c), r"(?is)<title[^>]*>(.*?)</title", 1)
