"""Risk classification over metrics rows (RISK-1..6).

Pure row-wise ``when`` chains: one narrow projection over however many metric
rows (one per region) there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope import schema as S
from episcope.functions.text import fill, fmt2

# --- fixed values: finding messages and risk labels ---
GROWTH_HIGH = "Crescimento relevante de casos no período recente."
GROWTH_LOW = "Redução relevante de casos no período recente."
GROWTH_STABLE = "Casos relativamente estáveis no período recente."
MORTALITY_MSG = "Taxa de mortalidade observada: {}%."
ICU_MSG = "Taxa de internação em UTI observada: {}%."
VACCINATION_MSG = "Taxa de vacinação observada: {}%."
RISK_HIGH, RISK_MODERATE, RISK_LOW = "alto", "moderado", "baixo"


def metric(name: str) -> Column:
    """A metric column where a missing value counts as 0.0."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _finding(kind: str, severity: Column, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), message.alias("message"))


def growth_finding(v: Column) -> Column:
    """RISK-1: >10 high, <-10 low, else moderate."""
    sev = F.when(v > 10, "high").when(v < -10, "low").otherwise("moderate")
    msg = F.when(v > 10, GROWTH_HIGH).when(v < -10, GROWTH_LOW).otherwise(GROWTH_STABLE)
    return _finding("growth", sev, msg)


def mortality_finding(v: Column) -> Column:
    """RISK-2: >10 high, >=5 moderate, else low."""
    sev = F.when(v > 10, "high").when(v >= 5, "moderate").otherwise("low")
    return _finding("mortality", sev, fill(MORTALITY_MSG, fmt2(v)))


def icu_finding(v: Column) -> Column:
    """RISK-3: >30 high, >=20 moderate, else low."""
    sev = F.when(v > 30, "high").when(v >= 20, "moderate").otherwise("low")
    return _finding("uti", sev, fill(ICU_MSG, fmt2(v)))


def vaccination_finding(v: Column) -> Column:
    """RISK-4: <50 high, <70 moderate, else low."""
    sev = F.when(v < 50, "high").when(v < 70, "moderate").otherwise("low")
    return _finding("vaccination", sev, fill(VACCINATION_MSG, fmt2(v)))


def findings_array() -> Column:
    """RISK-5: the four findings in order growth, mortality, ICU, vaccination."""
    return F.array(growth_finding(metric(S.M_GROWTH)), mortality_finding(metric(S.M_MORTALITY)),
                   icu_finding(metric(S.M_ICU)), vaccination_finding(metric(S.M_VACCINATION)))


def risk_score() -> Column:
    """RISK-6 score: growth>10 +2, mortality>10 +2, ICU>30 +1, vaccination<50 +1."""
    return ((metric(S.M_GROWTH) > 10).cast("int") * 2
            + (metric(S.M_MORTALITY) > 10).cast("int") * 2
            + (metric(S.M_ICU) > 30).cast("int")
            + (metric(S.M_VACCINATION) < 50).cast("int"))


def risk_label(score: Column) -> Column:
    return F.when(score >= 4, RISK_HIGH).when(score >= 2, RISK_MODERATE).otherwise(RISK_LOW)


def with_findings(metrics: DataFrame) -> DataFrame:
    """Metrics rows + ``findings`` array + ``risk_score`` + ``risk_level``."""
    return (metrics.withColumn("findings", findings_array())
            .withColumn("risk_score", risk_score())
            .withColumn("risk_level", risk_label(F.col("risk_score"))))


def findings(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """RISK-5 as rows: one row per (keys, finding) with its position."""
    return (metrics.select(*keys, F.posexplode(findings_array()).alias("pos", "f"))
            .select(*keys, (F.col("pos") + 1).alias("pos"), "f.kind", "f.severity", "f.message"))


def risk_levels(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """RISK-6 per row: score and label."""
    return metrics.select(*keys, risk_score().alias("risk_score"),
                          risk_label(risk_score()).alias("risk_level"))
