"""Personal-data detection and masking over text tables (PII-1..3).

Row-wise regex expressions on whole texts; no shuffle, so the cost is one
pass over the text column at scan parallelism.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.functions.pii import anonymize, pii_types


def detect_pii(df: DataFrame, column: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """PII-1: ``has_pii`` and ``pii_types`` (ARRAY<STRING>) per row."""
    types = pii_types(F.col(column))
    return df.select(*keys, (F.size(types) > 0).alias("has_pii"), types.alias("pii_types"))


def anonymize_column(df: DataFrame, column: str = "text", out: str | None = None) -> DataFrame:
    """PII-2: the masked text in ``out`` (default: replace ``column``)."""
    return df.withColumn(out or column, anonymize(F.col(column)))


def scrub_texts(df: DataFrame, column: str = "text") -> DataFrame:
    """PII-3: detect, then mask only the rows where something was found.

    The kinds are computed once; detection is ``size(kinds) > 0``, so every
    pattern is tested once per text before masking.
    """
    found = df.withColumn("pii_types", pii_types(F.col(column)))
    detected = F.size("pii_types") > 0
    return found.select(*[c for c in df.columns if c != column],
                        detected.alias("pii_detected"), "pii_types",
                        F.when(detected, anonymize(F.col(column))).otherwise(F.col(column)).alias(column))
