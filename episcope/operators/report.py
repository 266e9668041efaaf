"""Report rows (REP-1..5): one Markdown report per metrics row.

The report is a single ``concat`` over the row's metrics, its findings array
and an optional news array, so a per-region report table is one narrow
projection of the per-region metrics — no driver-side string building.
Timestamp and execution id are parameters, which keeps output deterministic.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope import schema as S
from episcope.functions.memo import columns_once
from episcope.functions.text import capitalize, fill, fmt2, fmt_int
from episcope.operators.risk import findings_array, metric, risk_label, risk_score

# --- fixed values: report text; each {} is filled with a value in order ---
HEADER = ("# Relatório de Monitoramento de SRAG\n## Síndrome Respiratória Aguda Grave - Brasil\n\n"
          "**Data do Relatório:** {}\n**ID de Execução:** {}\n")
RISK_LINE = "**Nível de Risco:** {}\n"
METRICS_INTRO = "\n---\n\n## 1. Métricas Principais\n\n"
GROWTH_LINE = ("### 1.1 Taxa de Aumento de Casos\n"
               "**{}%** nos últimos 30 dias em relação ao período anterior.\n\n")
MORTALITY_LINE = "### 1.2 Taxa de Mortalidade\n**{}%** dos casos registrados resultaram em óbito.\n\n"
ICU_LINE = "### 1.3 Taxa de Ocupação de UTI\n**{}%** dos casos necessitaram de internação em UTI.\n\n"
VACC_LINE = ("### 1.4 Taxa de Vacinação\n"
             "**{}%** dos pacientes registrados possuíam vacinação prévia.\n\n")
CONTEXT = ("---\n\n## 2. Análise Contextual\n\n### 2.1 Cenário Atual\n\n"
           "Com base nos dados mais recentes do DATASUS, foram registrados **{}** casos de SRAG.\n")
CONTEXT_LEGACY = ("---\n\n## 2. Análise Contextual\n\n### 2.1 Cenário Atual\n\n"
                  "Com base nos dados mais recentes do DATASUS, foram registrados **{}** casos de SRAG em 2024.\n")
GROWTH_UP = ("\nObserva-se uma **tendência de crescimento** de {}% nos casos, indicando necessidade "
             "de atenção reforçada às medidas preventivas.\n")
GROWTH_DOWN = ("\nObserva-se uma **tendência de redução** de {}% nos casos, sinalizando "
               "possível controle da situação epidemiológica.\n")
GROWTH_FLAT = "\nOs casos mantêm-se **estáveis** em relação ao período anterior.\n"
FINDINGS_TITLE = "\n### 2.2 Achados Epidemiológicos\n\n"
FINDING_LINE = "- **{}**: {}\n"
NEWS_TITLE = "\n### 2.3 Notícias Recentes\n\n"
NEWS_TITLE_LEGACY = "\n### 2.2 Notícias Recentes\n\n"
NEWS_ENTRY = "**{}. {}**  \n*{} - {}*  \n{}\n\n"
NO_NEWS = "Nenhuma notícia recente disponível.\n\n"
CHARTS_TITLE = "---\n\n## 3. Visualizações\n\n"
DAILY_CHART = "### 3.1 Casos Diários (Últimos 30 Dias)\n\n![Casos Diários]({})\n\n"
MONTHLY_CHART = "### 3.2 Casos Mensais (Últimos 12 Meses)\n\n![Casos Mensais]({})\n\n"
CONCLUSIONS_TITLE = "---\n\n## 4. Conclusões e Recomendações\n\n"
MORT_HIGH = ("- A taxa de mortalidade está **acima da média histórica**, "
             "exigindo revisão dos protocolos de atendimento.")
MORT_LOW = ("- A taxa de mortalidade está **abaixo da média histórica**, "
            "indicando eficácia dos protocolos de tratamento.")
MORT_MID = "- A taxa de mortalidade está **dentro da faixa esperada** para SRAG."
ICU_HIGH = ("- A taxa de ocupação de UTI está **elevada**, recomenda-se "
            "monitoramento da capacidade hospitalar.")
ICU_OK = "- A taxa de ocupação de UTI está **controlada**."
VACC_LOW = ("- A taxa de vacinação está **abaixo do ideal**, recomenda-se "
            "intensificar campanhas de imunização.")
VACC_OK = ("- A taxa de vacinação está **satisfatória**, contribuindo para "
           "o controle de casos graves.")
SOURCE = ("\n---\n\n## 5. Fonte e Rastreabilidade\n\n- Fonte: {}\n- Tipo de fonte: {}\n"
          "- Última atualização local: {}\n- Narrativa: {}\n")
DEFAULT_PROVIDER = "DATASUS/SIVEP-Gripe"
DEFAULT_SOURCE_TYPE = "não informado"
DEFAULT_UPDATED = "não informada"
DETERMINISTIC = "deterministica"
FOOTER = ("\n---\n\n**Relatório gerado automaticamente pelo Sistema de Monitoramento de SRAG**  \n"
          "*Fonte de dados: DATASUS/SIVEP-Gripe*  \n*Data de geração: {}*\n")
HEADER_STAMP = "%d/%m/%Y %H:%M"
FOOTER_STAMP = "%d/%m/%Y às %H:%M"


def growth_text(v: Column) -> Column:
    """REP-1: growth / reduction (absolute value) / stable sentence."""
    return (F.when(v > 0, fill(GROWTH_UP, fmt2(v)))
            .when(v < 0, fill(GROWTH_DOWN, fmt2(F.abs(v))))
            .otherwise(F.lit(GROWTH_FLAT)))


def recommendations(mortality: Column, icu: Column, vaccination: Column) -> Column:
    """REP-2: three recommendation lines (vaccination cut at 60, not RISK-4's 50/70)."""
    return F.concat(
        F.concat_ws("\n",
                    F.when(mortality > 10, MORT_HIGH).when(mortality < 5, MORT_LOW).otherwise(MORT_MID),
                    F.when(icu > 30, ICU_HIGH).otherwise(ICU_OK),
                    F.when(vaccination < 60, VACC_LOW).otherwise(VACC_OK)),
        F.lit("\n"))


def news_block(news: Column | None) -> Column:
    """Numbered news entries, or the no-news line for an empty / NULL array."""
    if news is None:
        return F.lit(NO_NEWS)
    return F.coalesce(news_entries(news), F.lit(NO_NEWS))


def news_entries(news: Column) -> Column:
    """Rendered news entries of a news array; NULL when it is empty or NULL."""
    entries = F.transform(news, lambda x, i: fill(
        NEWS_ENTRY, (i + 1).cast("string"), *[F.coalesce(x[c], F.lit("")) for c in ("title", "source", "date", "summary")]))
    return F.when(F.coalesce(F.size(news), F.lit(0)) > 0, F.array_join(entries, ""))


def findings_block() -> Column:
    items = F.transform(findings_array(), lambda f: fill(
        FINDING_LINE, capitalize(f["severity"]), f["message"]))
    return F.array_join(items, "")


def charts_block(charts: dict | None) -> str:
    out = ""
    charts = charts or {}
    if charts.get("daily", {}).get("success"):
        out += DAILY_CHART.replace("{}", charts["daily"]["filename"])
    if charts.get("monthly", {}).get("success"):
        out += MONTHLY_CHART.replace("{}", charts["monthly"]["filename"])
    return out


def render_report(metrics: DataFrame, execution_id: Column, report_time: dt.datetime,
                  news: Column | None = None, charts: dict | None = None,
                  source: dict | Column | None = None, layout: str = "current",
                  keys: Sequence[str] = (), news_text: Column | None = None) -> DataFrame:
    """REP-3 (``layout='current'``) / REP-4 (``layout='legacy'``): one report per row.

    ``execution_id`` and ``news`` are columns of ``metrics`` (or literals);
    ``news`` is an ARRAY<STRUCT<title, source, date, summary>> column;
    ``news_text`` is an already rendered block (see ``news.ranked_news_text``).
    ``report_time`` fixes both the header and footer stamps. ``source`` fills section 5:
    ``provider``, ``source_type`` and ``updated_at`` as values, or all three as one scalar
    column (see ``source_scalar``).
    """
    if layout not in ("current", "legacy"):
        raise ValueError("layout must be 'current' or 'legacy'")
    if isinstance(source, Column):
        middle, tail = _report_parts(layout, report_time, charts, source)
    else:
        # The pieces do not depend on the report time: it is filled in last.
        key = ("report", layout, json.dumps(charts or {}, sort_keys=True), json.dumps(source or {}, sort_keys=True))
        middle, tail = columns_once(key, lambda: _report_parts(layout, None, charts, source))
        tail = [*tail[:-1], fill(FOOTER, F.lit(report_time.strftime(FOOTER_STAMP)))]
    parts = [fill(HEADER, F.lit(report_time.strftime(HEADER_STAMP)), F.coalesce(execution_id.cast("string"), F.lit(""))), *middle,
             news_text if news_text is not None else news_block(news), *tail]
    return metrics.select(*keys, F.concat(*parts).alias("report"))


def _report_parts(layout: str, report_time: dt.datetime | None, charts: dict | None,
                  source: dict | Column | None) -> tuple[list[Column], list[Column]]:
    """The report pieces before and after the news block (fixed per parameters)."""
    g, m = metric(S.M_GROWTH), metric(S.M_MORTALITY)
    u, v = metric(S.M_ICU), metric(S.M_VACCINATION)
    total = F.coalesce(F.col(S.M_TOTAL), F.lit(0))
    middle: list[Column] = []
    if layout == "current":
        middle.append(fill(RISK_LINE, F.upper(risk_label(risk_score()))))
    middle += [F.lit(METRICS_INTRO),
               fill(GROWTH_LINE, fmt2(g)), fill(MORTALITY_LINE, fmt2(m)),
               fill(ICU_LINE, fmt2(u)), fill(VACC_LINE, fmt2(v)),
               fill(CONTEXT if layout == "current" else CONTEXT_LEGACY, fmt_int(total)),
               growth_text(g)]
    if layout == "current":
        middle += [F.lit(FINDINGS_TITLE), findings_block(), F.lit(NEWS_TITLE)]
    else:
        middle.append(F.lit(NEWS_TITLE_LEGACY))
    tail = [F.lit(CHARTS_TITLE + charts_block(charts) + CONCLUSIONS_TITLE), recommendations(m, u, v)]
    if layout == "current":
        defaults = {"provider": DEFAULT_PROVIDER, "source_type": DEFAULT_SOURCE_TYPE, "updated_at": DEFAULT_UPDATED}
        own = source if isinstance(source, Column) else F.struct(*[F.lit((source or {}).get(k)).cast("string").alias(k) for k in defaults])
        tail.append(fill(SOURCE, *[F.coalesce(F.nullif(own[k], F.lit("")), F.lit(v)) for k, v in defaults.items()], F.lit(DETERMINISTIC)))
    tail.append(fill(FOOTER, F.lit(report_time.strftime(FOOTER_STAMP) if report_time else "")))
    return middle, tail


def recommendations_rows(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """REP-1 + REP-2 per row: growth sentence and recommendation lines."""
    return metrics.select(*keys, growth_text(metric(S.M_GROWTH)).alias("growth_text"),
                          recommendations(metric(S.M_MORTALITY), metric(S.M_ICU),
                                          metric(S.M_VACCINATION)).alias("recommendations"))


def latest_source(load_history: DataFrame) -> DataFrame:
    """REP-5: the newest load-history row (provider, source type, path, time, url)."""
    return load_history.agg(F.max_by(F.struct(*[c for c in load_history.columns]),
                                     F.col("ingested_at")).alias("s")).select("s.*")


def source_metadata(load_history: DataFrame, *more: str) -> DataFrame:
    """REP-5: the five fields of the newest load, by their names in the report state, and ``more`` columns; no row without a load."""
    return latest_source(load_history).where(F.col("ingested_at").isNotNull()).select(
        "provider", "source_type", F.col("table_path").alias("db_path"), F.col("ingested_at").alias("updated_at"), "source_url", *more)


def source_scalar(load_history: DataFrame) -> Column:
    """The newest load as a scalar struct for section 5 of ``render_report``."""
    return source_metadata(load_history).select(F.struct("provider", "source_type", "updated_at")).scalar()
