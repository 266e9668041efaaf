"""Output validation and query sanitising (GRD-2..4).

Each check is an ordered ``when`` chain — the first failing rule names the
message — evaluated row-wise, so checking a whole report or metrics table is
a single projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope import schema as S
from episcope.functions.text import sanitize_query

# --- fixed values: metric ranges and their messages, in checking order ---
REQUIRED_METRICS = (S.M_GROWTH, S.M_MORTALITY, S.M_ICU, S.M_VACCINATION)
MISSING_METRIC = "Métrica obrigatória ausente: "
RANGE_RULES = (
    (S.M_GROWTH, -100, 1000, "Taxa de aumento de casos fora do range esperado"),
    (S.M_MORTALITY, 0, 100, "Taxa de mortalidade fora do range esperado (0-100%)"),
    (S.M_ICU, 0, 100, "Taxa de ocupação de UTI fora do range esperado (0-100%)"),
    (S.M_VACCINATION, 0, 100, "Taxa de vacinação fora do range esperado (0-100%)"),
)
OK = "OK"

# --- fixed values: report checks ---
MIN_REPORT_LENGTH = 100
SHORT_REPORT = "Relatório muito curto ou vazio"
REQUIRED_SECTIONS = ("Métricas Principais", "Taxa de Mortalidade",
                     "Taxa de Ocupação de UTI", "Taxa de Vacinação")
MISSING_SECTION = "Seção obrigatória ausente: "


def _ordered(rules: list[tuple[Column, str]]) -> Column:
    """Message of the first failing rule, else ``OK``."""
    out = F.lit(OK)
    for failed, message in reversed(rules):
        out = F.when(failed, F.lit(message)).otherwise(out)
    return out


def metric_message(df_columns: Sequence[str]) -> Column:
    rules: list[tuple[Column, str]] = []
    for name in REQUIRED_METRICS:
        missing = F.lit(True) if name not in df_columns else F.col(name).isNull()
        rules.append((missing, MISSING_METRIC + name))
    for name, lo, hi, message in RANGE_RULES:
        if name in df_columns:
            x = F.col(name).cast("double")
            rules.append((~((x >= lo) & (x <= hi)) | F.isnan(x), message))
    return _ordered(rules)


def validate_metrics(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """GRD-3: required keys (NULL = missing) and ranges; first failure wins."""
    msg = metric_message(metrics.columns)
    return metrics.select(*keys, (msg == OK).alias("valid"), msg.alias("message"))


def report_message(report: Column) -> Column:
    rules = [(report.isNull() | (F.length(report) < MIN_REPORT_LENGTH), SHORT_REPORT)]
    rules += [(~report.contains(s), MISSING_SECTION + s) for s in REQUIRED_SECTIONS]
    return _ordered(rules)


def validate_report(reports: DataFrame, column: str = "report", keys: Sequence[str] = ()) -> DataFrame:
    """GRD-4: length >= 100 and the four required phrases; first failure wins."""
    msg = report_message(F.col(column))
    return reports.select(*keys, (msg == OK).alias("valid"), msg.alias("message"))


def sanitize(df: DataFrame, column: str, out: str = "sanitized") -> DataFrame:
    """GRD-2 over a text column."""
    return df.withColumn(out, sanitize_query(F.col(column)))
