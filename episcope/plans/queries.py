"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's test tables through ``plans.fixtures`` and runs
one or more operators over the whole tables. Output dates leave as text so the
result compares across engines; computed columns carry the same names as the
oracle SQL in ``plans.oracle``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope import schema as S
from episcope.functions import dates as DT
from episcope.functions import text as TX
from episcope.operators import checks as CH
from episcope.operators import clean as C
from episcope.operators import metrics as M
from episcope.operators import news as N
from episcope.operators import ops as OPS
from episcope.operators import privacy as PV
from episcope.operators import ratelimit as RL
from episcope.operators import report as REP
from episcope.operators import risk as R
from episcope.operators import series as TS
from episcope.plans import fixtures as FX
from episcope.session import materialize, shared_dir
from episcope.sources import audit as SA
from episcope.sources import cases as SC
from episcope.sources import facts as SFA
from episcope.sources import feeds as SF
from episcope.streaming import jobs as ST

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

# Year kept by the cleaning step on the test tables (they span 1995-2001).
FIXTURE_YEAR = 2000


def query(name: str):
    def wrap(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return wrap


def dates_as_text(df: DataFrame) -> DataFrame:
    """DATE / TIMESTAMP columns → ISO text, for engine-neutral comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# Coded answers may be unknown (NULL). Query outputs carry them as text, like
# dates, so a NULL reads the same through either engine's pandas conversion
# (nullable INT would be float/NaN on one side and Int32/<NA> on the other).
CODE_COLUMNS = ("cs_sexo", "evolucao", "uti", "vacina", "vacina_cov",
                "febre", "tosse", "dispneia", "saturacao")


def codes_as_text(df: DataFrame, columns=CODE_COLUMNS) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


# ---------------------------------------------------------------- case family

def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = FX.mapped_cases(spark, sf_dir, year=FIXTURE_YEAR)
    return C.clean_cases(raw, year=FIXTURE_YEAR)


def fact(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    # The fact is tiny (days x keys); materialising it once lets the anchor
    # subquery and every aggregate read it instead of re-scanning the cases.
    return materialize(M.daily_fact(cases(spark, sf_dir), keys))


def daily(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    """The fact for a query that reads it once: nothing runs before the action."""
    return M.daily_fact(cases(spark, sf_dir), keys)


@query("clean_cases")
def q_clean_cases(spark, sf_dir):
    return codes_as_text(dates_as_text(cases(spark, sf_dir)))


@query("sample_rows")
def q_sample_rows(spark, sf_dir):
    # SRC-2: the first N raw rows, before cleaning, in order of their columns; the limit is the feature.
    return SC.sample_rows(FX.mapped_cases(spark, sf_dir), 100, S.RAW_COLUMNS)


@query("total_cases")
def q_total_cases(spark, sf_dir):
    return M.total_cases(daily(spark, sf_dir))


@query("mortality_rate")
def q_mortality_rate(spark, sf_dir):
    return M.mortality_rate(daily(spark, sf_dir))


@query("icu_rate")
def q_icu_rate(spark, sf_dir):
    return M.icu_rate(daily(spark, sf_dir))


@query("vaccination_rate")
def q_vaccination_rate(spark, sf_dir):
    return M.vaccination_rate(daily(spark, sf_dir))


@query("growth_rate")
def q_growth_rate(spark, sf_dir):
    return M.growth_rate(fact(spark, sf_dir), 30)


@query("growth_rate_7d")
def q_growth_rate_7d(spark, sf_dir):
    return M.growth_rate(fact(spark, sf_dir), 7)


@query("all_metrics")
def q_all_metrics(spark, sf_dir):
    return M.all_metrics(fact(spark, sf_dir))


@query("describe_cases")
def q_describe_cases(spark, sf_dir):
    return M.describe_cases(cases(spark, sf_dir))


@query("metrics_by_uf")
def q_metrics_by_uf(spark, sf_dir):
    return M.all_metrics(fact(spark, sf_dir, ["sg_uf"]), keys=["sg_uf"])


@query("metrics_rollup_unknown_region")
def q_metrics_rollup_unknown_region(spark, sf_dir):
    """AGG-8: cases without a region have a row of their own beside the national total."""
    known = F.when(F.col("sg_uf") != "CANADA", F.col("sg_uf"))
    return M.metrics_rollup(materialize(M.daily_fact(cases(spark, sf_dir).withColumn("sg_uf", known), ["sg_uf"])))


@query("metrics_rollup")
def q_metrics_rollup(spark, sf_dir):
    return M.metrics_rollup(fact(spark, sf_dir, ["sg_uf"]), "sg_uf")


@query("daily_cases")
def q_daily_cases(spark, sf_dir):
    return TS.daily_cases(fact(spark, sf_dir), 30)


@query("daily_cases_by_uf")
def q_daily_cases_by_uf(spark, sf_dir):
    return TS.daily_cases(fact(spark, sf_dir, ["sg_uf"]), 30, ["sg_uf"])


@query("monthly_cases")
def q_monthly_cases(spark, sf_dir):
    return TS.monthly_cases(daily(spark, sf_dir), 6)


@query("monthly_cases_calendar")
def q_monthly_cases_calendar(spark, sf_dir):
    return TS.monthly_cases_calendar(fact(spark, sf_dir), 6)


@query("chart_series_by_uf")
def q_chart_series_by_uf(spark, sf_dir):
    return TS.chart_series(fact(spark, sf_dir, ["sg_uf"]), ["sg_uf"], 30, 12)


# ------------------------------------------------------ risk, reports, checks

REPORT_TIME = dt.datetime(2026, 1, 1, 12, 0)


def metrics_by_uf(spark, sf_dir):
    return M.all_metrics(fact(spark, sf_dir, ["sg_uf"]), keys=["sg_uf"])


def uf_execution_id():
    return F.concat(F.lit("exec-"), F.col("sg_uf"))


@query("findings_by_uf")
def q_findings_by_uf(spark, sf_dir):
    return R.findings(metrics_by_uf(spark, sf_dir), ["sg_uf"])


@query("risk_by_uf")
def q_risk_by_uf(spark, sf_dir):
    return R.risk_levels(metrics_by_uf(spark, sf_dir), ["sg_uf"])


@query("recommendations_by_uf")
def q_recommendations_by_uf(spark, sf_dir):
    return REP.recommendations_rows(metrics_by_uf(spark, sf_dir), ["sg_uf"])


@query("report_by_uf")
def q_report_by_uf(spark, sf_dir):
    return REP.render_report(metrics_by_uf(spark, sf_dir), uf_execution_id(), REPORT_TIME,
                             keys=["sg_uf"])


@query("report_legacy_by_uf")
def q_report_legacy_by_uf(spark, sf_dir):
    return REP.render_report(metrics_by_uf(spark, sf_dir), uf_execution_id(), REPORT_TIME,
                             layout="legacy", keys=["sg_uf"])


@query("report_checks")
def q_report_checks(spark, sf_dir):
    reports = REP.render_report(metrics_by_uf(spark, sf_dir), uf_execution_id(), REPORT_TIME,
                                keys=["sg_uf"])
    return CH.validate_report(reports, "report", ["sg_uf"])


@query("metric_checks")
def q_metric_checks(spark, sf_dir):
    return CH.validate_metrics(metrics_by_uf(spark, sf_dir), ["sg_uf"])


@query("metric_checks_failing")
def q_metric_checks_failing(spark, sf_dir):
    """GRD-3 on the metrics of regions as they are and spoilt in eight ways, each breaking one rule."""
    m = metrics_by_uf(spark, sf_dir)
    names = CH.REQUIRED_METRICS
    spoilt = F.array(F.struct(F.lit(0).alias("case"), *[F.col(n).alias(n) for n in names]), *[
        F.struct(F.lit(k + 1).alias("case"), *[(F.lit(None).cast("double") if n == name else F.col(n)).alias(n) for n in names])
        for k, name in enumerate(names)], *[
        F.struct(F.lit(k + 5).alias("case"), *[((F.col(n) + 1e6) * (-1) ** k if n == name else F.col(n)).alias(n) for n in names])
        for k, name in enumerate(names)])
    return CH.validate_metrics(m.select("sg_uf", F.inline(spoilt)), ["sg_uf", "case"])


@query("report_checks_failing")
def q_report_checks_failing(spark, sf_dir):
    """GRD-4 on the reports of regions as they are, cut short, missing, and without each required section."""
    reports = REP.render_report(metrics_by_uf(spark, sf_dir), uf_execution_id(), REPORT_TIME, keys=["sg_uf"])
    whole = F.col("report")
    spoilt = [whole, F.substring(whole, 1, 99), F.lit(None).cast("string"), *[F.replace(whole, F.lit(x), F.lit("-")) for x in CH.REQUIRED_SECTIONS]]
    rows = reports.select("sg_uf", F.posexplode(F.array(*spoilt)).alias("case", "report"))
    return CH.validate_report(rows, "report", ["sg_uf", "case"])


# ------------------------------------------------------------ text and privacy

@query("detect_pii")
def q_detect_pii(spark, sf_dir):
    out = PV.detect_pii(FX.pii_texts(spark, sf_dir), "text", ["doc_id"])
    return out.select("doc_id", "has_pii", F.concat_ws(",", "pii_types").alias("pii_types"))


@query("anonymize_documents")
def q_anonymize_documents(spark, sf_dir):
    out = PV.scrub_texts(FX.pii_texts(spark, sf_dir), "text")
    return out.select("doc_id", "pii_detected", F.concat_ws(",", "pii_types").alias("pii_types"),
                      F.col("text").alias("scrubbed"))


@query("sanitize_text")
def q_sanitize_text(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents").select("doc_id", "text")
    return CH.sanitize(docs, "text").select("doc_id", "sanitized")


@query("clean_html")
def q_clean_html(spark, sf_dir):
    pages = FX.table(spark, sf_dir, "pages").select("page_id", "html")
    out = TX.with_clean_summary(pages, "html", "summary", 320, text_out="_text")
    return out.select("page_id", "summary", F.length("_text").alias("text_chars"))


# ------------------------------------------------------------------------ news

# Terms for the synthetic pages: the default surveillance terms barely occur there.
PAGE_TERMS = ("the", "und", "les", "que", "tion", "ein", "ou", "uti", "gripe")


def page_news(spark, sf_dir):
    return N.prepare_items(FX.news_items(spark, sf_dir))


@query("relevance_scores")
def q_relevance_scores(spark, sf_dir):
    items = page_news(spark, sf_dir)
    return items.select("item_pos", N.relevance_score(F.col("title"), F.col("summary"),
                                                      PAGE_TERMS).alias("score"))


@query("dedupe_titles")
def q_dedupe_titles(spark, sf_dir):
    return N.dedupe_titles(page_news(spark, sf_dir)).select(
        "feed_pos", "item_pos", "source", "title", "date")


@query("rank_news")
def q_rank_news(spark, sf_dir):
    return N.rank_news(page_news(spark, sf_dir), 5, PAGE_TERMS).select(
        "rank", "title", "source", "date", "url", "score", "summary")


@query("report_with_news")
def q_report_with_news(spark, sf_dir):
    news = N.ranked_news_text(N.rank_news(page_news(spark, sf_dir), 5, PAGE_TERMS))
    return REP.render_report(M.all_metrics(fact(spark, sf_dir)), F.lit("exec-national"),
                             REPORT_TIME, news_text=news)


# -------------------------------------------------------- job ledger and audit

def jobs(spark, sf_dir):
    return OPS.latest_job_state(FX.job_changes(spark, sf_dir))


@query("latest_job_state")
def q_latest_job_state(spark, sf_dir):
    return dates_as_text(jobs(spark, sf_dir).drop(*OPS.RESULT_COLUMNS))


@query("job_results")
def q_job_results(spark, sf_dir):
    """OPS-4 + OPS-8: the columns that a success sets, folded from the change log and decoded."""
    out = OPS.decode_json_columns(jobs(spark, sf_dir))
    return out.select("job_id", F.coalesce(F.col("pii_detected").cast("string"), F.lit("")).alias("pii_detected"),
                      F.concat_ws(",", "pii_types").alias("pii_types"),
                      F.coalesce(F.col("summary")["event"], F.lit("")).alias("summary_event"))


@query("status_counts")
def q_status_counts(spark, sf_dir):
    return OPS.status_counts(jobs(spark, sf_dir))


@query("recent_jobs")
def q_recent_jobs(spark, sf_dir):
    return dates_as_text(OPS.recent_jobs(jobs(spark, sf_dir), 20).select(
        "job_id", "status", "created_at", "execution_id"))


@query("recent_failures")
def q_recent_failures(spark, sf_dir):
    return dates_as_text(OPS.recent_jobs(jobs(spark, sf_dir), 5, "failed").select(
        "job_id", "status", "created_at", "error"))


@query("backlog_head")
def q_backlog_head(spark, sf_dir):
    return dates_as_text(OPS.backlog_head(jobs(spark, sf_dir)).select("job_id", "created_at", "payload"))


@query("retry_plan")
def q_retry_plan(spark, sf_dir):
    return OPS.retry_plan(jobs(spark, sf_dir))


def audit(spark, sf_dir):
    return OPS.flatten_events(FX.audit_events(spark, sf_dir))


@query("flatten_events")
def q_flatten_events(spark, sf_dir):
    return codes_as_text(dates_as_text(audit(spark, sf_dir).select(
        "event_id", "event_type", "execution_id", "ts", "decision", "tool_name", "duration_ms",
        "validation_type", "valid", "message", "error_type", "error_message")), ["valid"])


@query("execution_summary")
def q_execution_summary(spark, sf_dir):
    return OPS.execution_summary(audit(spark, sf_dir))


# Rate-limit fixture: one key per user, K = 2 calls per 6 hours.
RATE_K, RATE_WINDOW_S = 2, 6 * 3600


@query("rate_limit")
def q_rate_limit(spark, sf_dir):
    calls = FX.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    out = RL.rate_limit(calls, "user_id", "ts", "event_id", RATE_K, RATE_WINDOW_S)
    return out.select("event_id", "user_id", "admitted")


@query("rate_limit_summary")
def q_rate_limit_summary(spark, sf_dir):
    calls = FX.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    out = RL.rate_limit(calls, "user_id", "ts", "event_id", RATE_K, RATE_WINDOW_S)
    return out.groupBy("admitted").agg(F.count(F.lit(1)).alias("calls"))


@query("parse_feed_dates")
def q_parse_feed_dates(spark, sf_dir):
    from episcope.functions.dates import normalize_date, sort_instant
    stamps = FX.feed_stamps(spark, sf_dir)
    return stamps.select(
        "event_id", "raw_date",
        F.coalesce(normalize_date(F.col("raw_date")), F.lit("")).alias("date"),
        F.date_format(sort_instant(F.col("raw_date")), "yyyy-MM-dd HH:mm:ss").alias("instant"))


# ------------------------------------------------- sources and sinks, round trips

@query("ingest_csv_cases")
def q_ingest_csv_cases(spark, sf_dir):
    """SRC-1 + CLEAN: mapped rows written as ';' Latin-1 CSV in three layouts, read back by name and cleaned."""
    path = shared_dir(spark, "raw-cases")
    FX.land_cases(FX.mapped_cases(spark, sf_dir), path)
    return codes_as_text(dates_as_text(C.clean_cases(SC.read_cases_csv(spark, path), year=FIXTURE_YEAR)))


@query("processed_roundtrip")
def q_processed_roundtrip(spark, sf_dir):
    """SNK-1 + SRC-3: cleaned rows saved as CSV and read back with their types."""
    path = shared_dir(spark, "processed")
    SC.write_processed(cases(spark, sf_dir), path, "csv")
    back = SC.read_processed(spark, path, "csv")
    return codes_as_text(dates_as_text(back))


@query("curated_reload_metrics")
def q_curated_reload_metrics(spark, sf_dir):
    """SNK-3 + year-partition pruning: atomic reload, then the flagship metrics."""
    root = shared_dir(spark, "curated")
    SC.replace_curated(cases(spark, sf_dir), root)
    curated = SC.read_curated(spark, root, year=FIXTURE_YEAR)
    return M.all_metrics(materialize(M.daily_fact(curated)))


def _per_year_and_region(curated):
    return (curated.groupBy(F.year("dt_notific").alias("year"), "sg_uf")
            .agg(F.count(F.lit(1)).alias("cases"), F.sum("obito").cast("bigint").alias("deaths")))


@query("curated_append")
def q_curated_append(spark, sf_dir):
    """SNK-2: three appends, by region, to the table that readers see; cases of all years."""
    root = shared_dir(spark, "curated-append")
    curated = materialize(C.clean_cases(FX.mapped_cases(spark, sf_dir), year=None))
    for k in range(3):
        SC.load_curated(curated.where(F.coalesce(F.crc32("sg_uf") % 3, F.lit(0)) == k), root)
    return _per_year_and_region(SC.read_curated(spark, root))


@query("curated_partial_reload")
def q_curated_partial_reload(spark, sf_dir):
    """SNK-3 on single years: all years loaded, then one reloaded without men and one emptied."""
    root = shared_dir(spark, "curated-partial")
    curated = materialize(C.clean_cases(FX.mapped_cases(spark, sf_dir), year=None))
    SC.replace_curated(curated, root)
    # Rows of years that are not reloaded are left out, however many the new data holds.
    SC.replace_curated(curated.where((F.col("cs_sexo") == 1) & (F.year("dt_notific") != 1997)), root, years=[FIXTURE_YEAR, 1997])
    return _per_year_and_region(SC.read_curated(spark, root))


@query("feed_items")
def q_feed_items(spark, sf_dir):
    """SRC-4: one RSS document per page (one per line), parsed back into items."""
    path = shared_dir(spark, "feeds")
    pages = FX.table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    title = F.trim(TX.unescape_entities(TX.extract_title(F.col("html"))))
    item = F.concat(
        F.lit("<item><title>"), SF.xml_escape(title), F.lit("</title><link>"), SF.xml_escape(F.col("url")),
        F.lit("</link><dc:date>"), F.date_format(F.timestamp_add("DAY", (pid % 40).cast("int"),
                                                                 F.lit("2026-01-01").cast("timestamp")),
                                                 "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("</dc:date></item>"))
    doc = F.concat(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>page-'),
        pid.cast("string"), F.lit("</title><item><title>nav. menu</title></item>"), item,
        # every 50th document is cut short: a broken feed must yield no items
        F.when(pid % 50 == 7, F.lit("")).otherwise(F.lit("</channel></rss>")))
    pages.select(doc.alias("value")).write.mode("overwrite").text(path)
    items = SF.parse_feed_documents(spark.read.text(path))
    items = N.drop_navigation(items)
    return items.select(
        F.regexp_extract("channel_title", r"page-(\d+)", 1).cast("bigint").alias("page_id"),
        "item_pos", "title", "url",
        F.coalesce(DT.normalize_date(F.col("raw_date")), F.lit("")).alias("date"))


@query("feed_files")
def q_feed_files(spark, sf_dir):
    """SRC-4 on whole files: feeds with descriptions written from pages, read by ``read_feed_items``."""
    path = shared_dir(spark, "feed-files")
    pages = FX.table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    title = F.trim(TX.unescape_entities(TX.extract_title(F.col("html"))))
    stamp = F.date_format(F.timestamp_add("DAY", (pid % 40).cast("int"), F.lit("2026-01-01").cast("timestamp")), "d MMMM yy")
    # A second title and link do not count; every other item stands one level deeper.
    item = F.concat(
        F.lit("<item><title>"), SF.xml_escape(title), F.lit("</title><title>other</title><link>"), SF.xml_escape(F.col("url")),
        F.lit("</link><link>other</link><description>page "), pid.cast("string"), F.lit(" &lt;b&gt;at&lt;/b&gt; "),
        SF.xml_escape(F.col("url")), F.lit("</description><pubDate>"), stamp, F.lit(" 10:00 +0000 (UTC)</pubDate></item>"))
    item = F.when(pid % 2 == 0, item).otherwise(F.concat(F.lit("<section>"), item, F.lit("</section>")))
    # 50 pages a feed, one line each; Spark writes one file per feed, between a first and a last line.
    lines = pages.select(F.floor(pid / 50).alias("feed"), pid.alias("at"), item.alias("value"))
    feeds = lines.select("feed").distinct()
    ends = (feeds.select("feed", F.lit(-1).cast("bigint").alias("at"), F.lit("<rss><channel><title>feed</title>").alias("value"))
            .union(feeds.select("feed", F.lit(2 ** 62).cast("bigint").alias("at"), F.lit("</channel></rss>").alias("value"))))
    (lines.union(ends).repartition("feed").sortWithinPartitions("feed", "at").select("feed", "value")
     .write.partitionBy("feed").text(path))
    items = N.drop_navigation(SF.read_feed_items(spark, f"{path}/*"))
    return items.select("title", "url", "description", DT.normalize_date(F.col("raw_date")).alias("date"))


# The registry of the fixture's feeds, in order; nothing landed for the third, and the last is cut short.
FEED_REGISTRY = ((0, "Agência Sul", "sul"), (1, "Boletim Norte", "norte"), (2, "Sem Arquivo", "falta"), (3, "Quebrado", "quebrado"))


@query("feed_report")
def q_feed_report(spark, sf_dir):
    """NEWS-U, end to end: documents written as feed files, those of one feed broken, read in registry
    order, united, ranked by the default terms, and set into the national report."""
    path = shared_dir(spark, "feed-report")
    did = F.col("doc_id")
    docs = FX.table(spark, sf_dir, "documents").select("doc_id").where(did % 3 != 2)
    topic = F.get(F.array(*[F.lit(t) for t in FX.FEED_TOPICS]), (did % len(FX.FEED_TOPICS)).cast("int"))
    stamp = F.date_format(F.timestamp_add("MINUTE", did.cast("int"), F.lit("2026-01-01").cast("timestamp")), "d MMM yyyy HH:mm")
    note = F.concat(F.lit("<p>Nota "), did.cast("string"), F.lit(" &amp; mais</p>"))
    item = F.concat(F.lit("<item><title>"), topic, F.lit(" "), did.cast("string"), F.lit("</title><link>https://example.org/"), did.cast("string"),
                    F.lit("</link><description>"), SF.xml_escape(note), F.lit("</description><pubDate>"), stamp, F.lit(" GMT</pubDate></item>"))
    # Each feed comes in files of at most 100 items; the broken one repeats the first feed's items.
    feeds = F.when(did % 3 == 0, F.array(F.lit("sul"), F.lit("quebrado"))).otherwise(F.array(F.lit("norte")))
    lines = docs.select(F.explode(feeds).alias("feed"), F.floor(did / 300).alias("part"), did.alias("at"), item.alias("value"))
    parts = lines.select("feed", "part").distinct()
    ends = (parts.select("feed", "part", F.lit(-1).cast("bigint").alias("at"), F.lit("<rss><channel><title>f</title>").alias("value"))
            .union(parts.where("feed <> 'quebrado'").select("feed", "part", F.lit(2 ** 62).cast("bigint").alias("at"), F.lit("</channel></rss>").alias("value"))))
    (lines.union(ends).repartition("feed", "part").sortWithinPartitions("feed", "part", "at").select("feed", "part", "value")
     .write.partitionBy("feed", "part").text(path))
    registry = spark.createDataFrame(FEED_REGISTRY, "feed_pos INT, name STRING, file STRING")
    landed = SF.read_feed_items(spark, f"{path}/*/*", registry, file_of=F.regexp_extract("path", "feed=([^/]*)/", 1))
    united = N.union_feeds(*[N.prepare_items(landed.where(F.col("feed_pos") == k)) for k, _, _ in FEED_REGISTRY])
    news = N.ranked_news_text(N.rank_news(united, 5))
    return REP.render_report(M.all_metrics(fact(spark, sf_dir)), F.lit("exec-national"), REPORT_TIME, news_text=news)


@query("audit_log_roundtrip")
def q_audit_log_roundtrip(spark, sf_dir):
    """SNK-5 + SRC-5: audit rows appended as daily JSONL in two batches, one of them twice, read back, summarised."""
    path = shared_dir(spark, "audit")
    events = FX.audit_events(spark, sf_dir)
    errors = F.col("event_type") == "error"
    SA.append_audit(events.where(errors), path, "errors")
    SA.append_audit(events.where(errors), path, "errors")
    SA.append_audit(events.where(~errors), path)
    return OPS.execution_summary(OPS.flatten_events(SA.read_audit_log(spark, path)))


@query("report_files")
def q_report_files(spark, sf_dir):
    """SNK-6: one Markdown file per execution, read back whole."""
    path = shared_dir(spark, "reports")
    reports = REP.render_report(metrics_by_uf(spark, sf_dir), uf_execution_id(), REPORT_TIME,
                                keys=["sg_uf"]).select(uf_execution_id().alias("execution_id"), "report")
    SA.write_reports(reports, path)
    return SA.read_reports(spark, path)


# ------------------------------------------------------------------ streaming

def _stream_dirs(spark, name):
    base = shared_dir(spark, name)
    return f"{base}/in", f"{base}/out", f"{base}/checkpoint"


@query("stream_ingest_cases")
def q_stream_ingest_cases(spark, sf_dir):
    """STR-1: raw CSV of two layouts, then of a third, landed → streaming CLEAN → curated Parquet, read back."""
    src, out, ckpt = _stream_dirs(spark, "stream-ingest")
    raw = materialize(FX.mapped_cases(spark, sf_dir))
    for landing in ((0, 2), (1,)):
        FX.land_cases(raw, src, landing)
        ST.stream_ingest(spark, src, out, ckpt, year=FIXTURE_YEAR)
    return codes_as_text(dates_as_text(spark.read.parquet(out).drop("batch", "year")))


@query("stream_daily_cases")
def q_stream_daily_cases(spark, sf_dir):
    """STR-2: curated cases landed as files, counted per day by a watermarked stream."""
    src, out, ckpt = _stream_dirs(spark, "stream-daily")
    curated = cases(spark, sf_dir)
    curated.write.mode("overwrite").parquet(src)
    ST.stream_daily_cases(spark, src, curated.schema, out, ckpt)
    return ST.read_upsert_log(spark, out, ["date"])


@query("stream_execution_summary")
def q_stream_execution_summary(spark, sf_dir):
    """STR-3: audit JSON lines that land in two batches, replayed through the streaming execution summary."""
    src, out, ckpt = _stream_dirs(spark, "stream-audit")
    events = FX.audit_events(spark, sf_dir)
    for k in range(2):
        # Every execution has events in both; the span of a whole table may be out of order.
        SA.append_audit(events.where(F.crc32("event_id") % 2 == k), src)
        ST.stream_execution_summary(spark, src, out, ckpt, watermark="5000 days")
        ST.compact_upsert_log(spark, out, ST.EXECUTION_KEYS)
    return ST.read_execution_summary(spark, out)


@query("stream_rate_limit")
def q_stream_rate_limit(spark, sf_dir):
    """STR-4: call files replayed through the stateful streaming rate limiter, odd ones after even ones."""
    src, out, ckpt = _stream_dirs(spark, "stream-rate")
    calls = FX.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    for k in range(2):
        calls.where(F.col("event_id") % 2 == k).write.mode("append").parquet(src)
        ST.stream_rate_limit(spark, src, calls.schema, "user_id", "ts", "event_id", out, ckpt,
                             RATE_K, RATE_WINDOW_S, watermark="5000 days")
    return ST.read_upsert_log(spark, out, ["user_id", "event_id"]).select("event_id", "user_id", "admitted")


SOURCE_URL = "https://example.org/srag-2000.csv"


def _loaded(spark, sf_dir):
    """Raw files of three layouts ingested; the table's root and the load history."""
    base = shared_dir(spark, "ingest")
    raw, table_root, history = f"{base}/raw", f"{base}/table", f"{base}/history"
    FX.land_cases(FX.mapped_cases(spark, sf_dir), raw)
    SC.ingest(spark, raw, table_root, year=FIXTURE_YEAR, metadata_path=history, source_url=SOURCE_URL)
    return table_root, spark.read.schema(SC.LOAD_HISTORY_SCHEMA).json(history)


@query("load_history_latest")
def q_load_history_latest(spark, sf_dir):
    """SRC-1 → CLEAN → SNK-3 → SNK-4, then REP-5: the newest load-history row and its five fields."""
    root, history = _loaded(spark, sf_dir)
    return REP.source_metadata(history, "rows_processed").select(
        "provider", "source_type", F.replace("db_path", F.lit(root), F.lit("table")).alias("db_path"),
        F.try_to_timestamp("updated_at").isNotNull().alias("updated"), "source_url", "rows_processed")


@query("report_with_source")
def q_report_with_source(spark, sf_dir):
    """REP-3 + REP-5: the national report from the loaded table, section 5 filled from the load history."""
    root, history = _loaded(spark, sf_dir)
    metrics = M.all_metrics(materialize(M.daily_fact(SC.read_curated(spark, root))))
    report = REP.render_report(metrics, F.lit("exec-national"), REPORT_TIME, source=REP.source_scalar(history))
    # The time of the load is the one thing that differs from run to run.
    return report.select(F.regexp_replace("report", r"(local: )\d{4}-\d\d-\d\dT[^\n]*", "$1load time").alias("report"))


def _maintained(spark, sf_dir):
    """All years loaded and their fact computed, then one year reloaded without men and its fact alone computed anew."""
    base = shared_dir(spark, "maintained")
    curated = materialize(C.clean_cases(FX.mapped_cases(spark, sf_dir), year=None))
    SC.replace_curated(curated, f"{base}/cases")
    SFA.refresh_daily_fact(spark, f"{base}/cases", f"{base}/fact")
    SC.replace_curated(curated.where(F.col("cs_sexo") == 1), f"{base}/cases", years=[FIXTURE_YEAR])
    SFA.refresh_daily_fact(spark, f"{base}/cases", f"{base}/fact")
    return base


@query("maintained_fact_metrics")
def q_maintained_fact_metrics(spark, sf_dir):
    """AGG-6 by region over all years from the maintained fact: no case is read."""
    return M.all_metrics(SFA.read_daily_fact(spark, f"{_maintained(spark, sf_dir)}/fact"), keys=["sg_uf"])


@query("describe_by_uf")
def q_describe_by_uf(spark, sf_dir):
    """AGG-7 by region with the exact median; the maintained fact's sketch lies within its stated error of it."""
    base = _maintained(spark, sf_dir)
    curated = SC.read_curated(spark, f"{base}/cases", year=FIXTURE_YEAR)
    exact = M.describe_cases(curated, keys=["sg_uf"])
    merged = SFA.describe_fact(SFA.read_daily_fact(spark, f"{base}/fact", FIXTURE_YEAR), ["sg_uf"]).select(
        F.col("sg_uf").alias("of"), F.col("idade_mediana").alias("near"), F.col("idade_media").alias("mean"))
    # The share of ages below and up to the sketch's median must hold the middle, but for the error.
    ages = curated.join(merged, F.col("sg_uf").eqNullSafe(F.col("of"))).groupBy("of").agg(
        (F.count_if(F.col("idade_anos") < F.col("near")) / F.count("idade_anos")).alias("below"),
        (F.count_if(F.col("idade_anos") <= F.col("near")) / F.count("idade_anos")).alias("upto"), F.first("mean").alias("mean"))
    slack = SFA.RANK_ERROR
    return exact.join(ages, F.col("sg_uf").eqNullSafe(F.col("of"))).select(
        *exact.columns, ((F.col("below") <= 0.5 + slack) & (F.col("upto") >= 0.5 - slack)).alias("sketch_in_error"),
        (F.abs(F.col("mean") - F.col("idade_media")) < 1e-5).alias("same_mean"))


@query("cases_half_open_range")
def q_cases_half_open_range(spark, sf_dir):
    """FIL-4: cases with ``2000-03-01 <= dt_notific < 2000-04-01``, per region."""
    rows = C.half_open_range(cases(spark, sf_dir), "dt_notific",
                             dt.date(2000, 3, 1), dt.date(2000, 4, 1))
    return rows.groupBy("sg_uf").agg(F.count(F.lit(1)).alias("cases"))


@query("cases_last_30_days")
def q_cases_last_30_days(spark, sf_dir):
    """FIL-3 on case rows: the last 31 calendar days before the newest case, per region."""
    rows = C.last_n_days(cases(spark, sf_dir), 30)
    return rows.groupBy("sg_uf").agg(F.count(F.lit(1)).alias("cases"),
                                     F.sum("obito").cast("bigint").alias("deaths"))


@query("decode_job_columns")
def q_decode_job_columns(spark, sf_dir):
    """OPS-8: JSON text columns of the job rows decoded (NULL pii_types → [], payload struct)."""
    n = F.length("job_id") + F.length("payload")
    js = jobs(spark, sf_dir).withColumns({
        "pii_types": F.when(n % 3 == 0, F.lit('["CPF", "E-mail"]')).when(n % 3 == 1, F.lit("")),
        "summary": F.when(F.col("status") == "failed", F.to_json(F.struct("status", "job_id")))})
    out = OPS.decode_json_columns(js)
    return out.select("job_id", F.col("payload")["k"].cast("int").alias("k"),
                      F.concat_ws(",", "pii_types").alias("pii_types"),
                      F.coalesce(F.col("summary")["status"], F.lit("")).alias("summary_status"))


@query("job_snapshots_merged")
def q_job_snapshots_merged(spark, sf_dir):
    """OPS-9: an old snapshot without ``payload`` and a new one with it, read together."""
    base = shared_dir(spark, "job-snapshots")
    js = jobs(spark, sf_dir).select("job_id", "status", "payload")
    js.where(F.col("status").eqNullSafe("failed")).drop("payload").write.parquet(f"{base}/old")
    js.where(~F.col("status").eqNullSafe("failed")).write.parquet(f"{base}/new")
    merged = spark.read.option("mergeSchema", True).parquet(f"{base}/old", f"{base}/new")
    return OPS.evolve_schema(merged).select("job_id", "status", "payload")
