"""Risk findings, report rows and output checks."""

import datetime as dt

from pyspark.sql import functions as F

from episcope import schema as S
from episcope.functions.text import fmt2
from episcope.operators import checks as CH
from episcope.operators import report as REP
from episcope.operators import risk as R

COLS = f"{S.M_GROWTH} DOUBLE, {S.M_MORTALITY} DOUBLE, {S.M_ICU} DOUBLE, {S.M_VACCINATION} DOUBLE, {S.M_TOTAL} BIGINT"


def metrics(spark, *rows):
    return spark.createDataFrame(list(rows), COLS)


def test_high_risk_all_findings_high(spark):
    m = metrics(spark, (20.0, 12.0, 35.0, 40.0, 1000))
    lv = R.risk_levels(m).first()
    assert (lv.risk_score, lv.risk_level) == (6, "alto")
    f = R.findings(m).orderBy("pos").collect()
    assert [x.kind for x in f] == ["growth", "mortality", "uti", "vaccination"]
    assert all(x.severity == "high" for x in f)
    assert f[1].message == "Taxa de mortalidade observada: 12.00%."


def test_reference_table_is_moderate(spark):
    m = metrics(spark, (0.0, 25.0, 100 / 3, 50.0, 12))
    assert R.risk_levels(m).first().risk_level == "moderado"  # 50 is not < 50


def test_empty_metrics_low_risk(spark):
    m = metrics(spark, (None, None, None, None, None))
    lv = R.risk_levels(m).first()
    assert (lv.risk_score, lv.risk_level) == (1, "baixo")


def test_two_decimals_round_like_python(spark):
    vals = [2.675, 0.125, 8.045, 1.005, -3.551912568306011]
    df = spark.createDataFrame([(v,) for v in vals], "v DOUBLE")
    assert [r[0] for r in df.select(fmt2("v")).collect()] == [f"{v:.2f}" for v in vals]


def test_report_renders_and_validates(spark):
    m = metrics(spark, (-3.5, 33.3, 17.6, 51.9, 7848))
    rep = REP.render_report(m, F.lit("exec-1"), dt.datetime(2026, 1, 1, 12, 0))
    text = rep.first().report
    assert text.startswith("# Relatório de Monitoramento de SRAG\n")
    assert "**ID de Execução:** exec-1\n**Nível de Risco:** MODERADO\n" in text
    assert "foram registrados **7,848** casos de SRAG." in text
    assert "**tendência de redução** de 3.50%" in text
    assert "- **High**: Taxa de mortalidade observada: 33.30%.\n" in text
    assert "Nenhuma notícia recente disponível." in text
    assert "*Data de geração: 01/01/2026 às 12:00*\n" in text
    chk = CH.validate_report(rep).first()
    assert (chk.valid, chk.message) == (True, "OK")
    legacy = REP.render_report(m, F.lit("exec-1"), dt.datetime(2026, 1, 1, 12, 0), layout="legacy").first().report
    assert "Nível de Risco" not in legacy and "casos de SRAG em 2024." in legacy
    assert "Fonte e Rastreabilidade" not in legacy


def test_report_news_block(spark):
    m = metrics(spark, (0.0, 1.0, 1.0, 90.0, 5)).withColumn("news", F.array(F.struct(
        F.lit("T").alias("title"), F.lit("S").alias("source"), F.lit("2026-07-02").alias("date"),
        F.lit("sum").alias("summary"))))
    text = REP.render_report(m, F.lit("e"), dt.datetime(2026, 1, 1), news=F.col("news")).first().report
    assert "**1. T**  \n*S - 2026-07-02*  \nsum\n\n---" in text


def test_report_checks_first_failure_wins(spark):
    df = spark.createDataFrame([("short",), ("x" * 100,), ("Métricas Principais " * 10,)], "report STRING")
    got = [r.message for r in CH.validate_report(df).collect()]
    assert got == ["Relatório muito curto ou vazio", "Seção obrigatória ausente: Métricas Principais",
                   "Seção obrigatória ausente: Taxa de Mortalidade"]


def test_metric_checks(spark):
    m = metrics(spark, (5.0, 10.0, 20.0, 30.0, 1), (2000.0, 10.0, 20.0, 30.0, 1),
                (5.0, 101.0, 20.0, 30.0, 1), (None, 10.0, 20.0, 30.0, 1))
    got = [r.message for r in CH.validate_metrics(m).collect()]
    assert got == ["OK", "Taxa de aumento de casos fora do range esperado",
                   "Taxa de mortalidade fora do range esperado (0-100%)",
                   f"Métrica obrigatória ausente: {S.M_GROWTH}"]
    # a metrics frame without a required column fails on it
    assert CH.validate_metrics(m.drop(S.M_ICU)).first().message == f"Métrica obrigatória ausente: {S.M_ICU}"


def test_recommendation_thresholds(spark):
    m = metrics(spark, (0.0, 12.0, 31.0, 55.0, 1))
    r = REP.recommendations_rows(m).first()
    assert "acima da média histórica" in r.recommendations
    assert "**elevada**" in r.recommendations
    assert "abaixo do ideal" in r.recommendations  # 55 < 60 although RISK-4 calls it moderate
    assert r.growth_text.strip() == "Os casos mantêm-se **estáveis** em relação ao período anterior."


EXPECTED_REPORT = "\n".join([
    "# Relatório de Monitoramento de SRAG",
    "## Síndrome Respiratória Aguda Grave - Brasil",
    "",
    "**Data do Relatório:** 01/01/2026 12:00",
    "**ID de Execução:** exec-1",
    "**Nível de Risco:** MODERADO",
    "",
    "---",
    "",
    "## 1. Métricas Principais",
    "",
    "### 1.1 Taxa de Aumento de Casos",
    "**-3.50%** nos últimos 30 dias em relação ao período anterior.",
    "",
    "### 1.2 Taxa de Mortalidade",
    "**33.30%** dos casos registrados resultaram em óbito.",
    "",
    "### 1.3 Taxa de Ocupação de UTI",
    "**17.60%** dos casos necessitaram de internação em UTI.",
    "",
    "### 1.4 Taxa de Vacinação",
    "**51.90%** dos pacientes registrados possuíam vacinação prévia.",
    "",
    "---",
    "",
    "## 2. Análise Contextual",
    "",
    "### 2.1 Cenário Atual",
    "",
    "Com base nos dados mais recentes do DATASUS, foram registrados **7,848** casos de SRAG.",
    "",
    "Observa-se uma **tendência de redução** de 3.50% nos casos, sinalizando possível controle "
    "da situação epidemiológica.",
    "",
    "### 2.2 Achados Epidemiológicos",
    "",
    "- **Moderate**: Casos relativamente estáveis no período recente.",
    "- **High**: Taxa de mortalidade observada: 33.30%.",
    "- **Low**: Taxa de internação em UTI observada: 17.60%.",
    "- **Moderate**: Taxa de vacinação observada: 51.90%.",
    "",
    "### 2.3 Notícias Recentes",
    "",
    "Nenhuma notícia recente disponível.",
    "",
    "---",
    "",
    "## 3. Visualizações",
    "",
    "---",
    "",
    "## 4. Conclusões e Recomendações",
    "",
    "- A taxa de mortalidade está **acima da média histórica**, exigindo revisão dos protocolos "
    "de atendimento.",
    "- A taxa de ocupação de UTI está **controlada**.",
    "- A taxa de vacinação está **abaixo do ideal**, recomenda-se intensificar campanhas de imunização.",
    "",
    "---",
    "",
    "## 5. Fonte e Rastreabilidade",
    "",
    "- Fonte: DATASUS/SIVEP-Gripe",
    "- Tipo de fonte: não informado",
    "- Última atualização local: não informada",
    "- Narrativa: deterministica",
    "",
    "---",
    "",
    "**Relatório gerado automaticamente pelo Sistema de Monitoramento de SRAG**  ",
    "*Fonte de dados: DATASUS/SIVEP-Gripe*  ",
    "*Data de geração: 01/01/2026 às 12:00*",
    "",
])


def test_full_report_text(spark):
    m = metrics(spark, (-3.5, 33.3, 17.6, 51.9, 7848))
    text = REP.render_report(m, F.lit("exec-1"), dt.datetime(2026, 1, 1, 12, 0)).first().report
    assert text == EXPECTED_REPORT
