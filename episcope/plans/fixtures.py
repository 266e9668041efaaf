"""Derive the surveillance inputs from the driver's test tables.

The test tables are TPC-H-like, so each surveillance input is a declared
mapping over them (see FIXTURES.md §2):

* ``mapped_cases``  lineitem ⋈ orders ⋈ customer ⋈ nation → raw case rows (all text)
* ``news_items``    pages → news items with feed/item positions and an instant
* ``job_changes``   events → job state changes
* ``audit_events``  events → audit log rows with a JSON payload
* ``pii_texts``     documents ∪ texts built from customer keys

Joins: lineitem and orders are both fact-sized, so they meet in a shuffle
join on the order key (AQE splits a hot key). customer joins orders on the
customer key and nation the same way; Spark broadcasts a side by its measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope import schema as S
from episcope.functions.memo import columns_once

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver test table; the (immutable) scan is listed and resolved once per context."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    session = spark._jsparkSession.hashCode()
    return columns_once(("table", session, path), lambda: spark.read.parquet(path))


def _ymd(c):
    # DATE -> text is 'yyyy-MM-dd' without a formatter.
    return F.to_date(c).cast("string")


def mapped_cases(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Raw case rows (24 text columns) built from the order tables.

    ``year``: the cleaning step will keep only that notification year. A valid
    notification date is the ship date itself, so the same cut is stated on
    ``l_shipdate`` with timestamp-without-zone literals: Catalyst cannot derive it
    through the text round trip, but stated here it reaches the Parquet scan
    (row-group min/max skipping) and drops other years before any string work.
    The kept rows are exactly those the cleaning filter keeps.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    if year is not None:
        lo = F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")
        hi = F.lit(f"{year + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
        li = li.where((F.col("l_shipdate") >= lo) & (F.col("l_shipdate") < hi))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey)
    rows = li.join(oc, li.l_orderkey == oc.o_orderkey)

    return rows.select(*columns_once("mapped_cases", _mapping_exprs))


def _mapping_exprs() -> list:
    ok = F.col("l_orderkey")
    mapped = {
        "DT_NOTIFIC": (F.when(ok % 97 == 0, F.lit("invalid"))
                       .when(ok % 89 == 0, F.lit(None).cast("string"))
                       .when((F.year("l_shipdate") == 2000) & (F.month("l_shipdate") == 7),
                             F.lit(None).cast("string"))
                       .otherwise(_ymd("l_shipdate"))),
        "DT_SIN_PRI": _ymd("o_orderdate"),
        "SG_UF": F.col("n_name"),
        "CO_MUN_RES": F.col("o_custkey").cast("string"),
        "CS_SEXO": (F.col("l_linenumber") % 2 + 1).cast("int"),
        "NU_IDADE_N": F.col("l_quantity").cast("int"),
        "TP_IDADE": F.when(F.col("l_suppkey") % 11 == 0, F.lit(None)).otherwise(
            (F.col("l_partkey") % 6).cast("int")),
        "EVOLUCAO": (F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1)
                     .when(F.col("l_suppkey") % 2 == 0, 3)),
        "UTI": (F.when((F.col("l_linestatus") == "O") & (F.col("l_partkey") % 3 == 0), 1)
                .when(F.col("l_suppkey") % 7 == 0, F.lit(None)).otherwise(2)),
        "VACINA": (F.when(F.col("o_orderpriority") == "1-URGENT", 1)
                   .when(F.col("o_orderpriority") == "2-HIGH", 2)),
        "VACINA_COV": (F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 1)
                       .when(F.col("c_mktsegment") == "HOUSEHOLD", 9).otherwise(2)),
        "HOSPITAL": F.when(F.col("l_discount") >= 0.05, 1).otherwise(2),
    }
    return [(mapped[c] if c in mapped else F.lit(None)).cast("string").alias(c) for c in S.RAW_COLUMNS]


def land_cases(rows: DataFrame, path: str, layouts: tuple[int, ...] = (0, 1, 2)) -> None:
    """Raw case rows as ``;`` Latin-1 CSV files in ``path``, dealt to three yearly layouts by region.

    0: the relevant columns in order, 1: in reverse order behind a column of no interest,
    2: in alphabetical order with columns of no interest between them.
    """
    names = list(S.RAW_COLUMNS)
    odd = [F.lit("x;y").alias(f"OUTRA_{k}") for k in range(3)]
    columns = {0: names, 1: [odd[0], *names[::-1]], 2: [odd[1], *sorted(names)[:9], odd[2], *sorted(names)[9:]]}
    for k in layouts:
        (rows.where(F.coalesce(F.crc32("SG_UF") % 3, F.lit(0)) == k).select(*columns[k])
         .write.mode("append").options(sep=";", encoding="ISO-8859-1", header=True, escape='"').csv(path))


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as news items: title from ``<title>``, summary from the page HTML."""
    from episcope.functions.text import extract_title, unescape_entities
    pages = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    instant = F.when(pid % 11 == 0, F.lit(None).cast("timestamp")).otherwise(
        F.timestamp_add("DAY", (pid % 40).cast("int"), F.lit("2026-01-01 00:00:00").cast("timestamp")))
    # The raw title is staged as a column so its regex runs once per page.
    titled = pages.withColumn("_title_raw", extract_title(F.col("html")))
    return titled.select(
        (pid % 3).cast("int").alias("feed_pos"),
        pid.alias("item_pos"),
        F.concat(F.lit("feed-"), (pid % 3).cast("string")).alias("source"),
        F.trim(unescape_entities(F.col("_title_raw"))).alias("title"),
        F.col("html").alias("description"),
        F.col("url"),
        instant.alias("instant"),
    )


# --- fixed values: event type -> job status mapping of the job-ledger fixture ---
JOB_STATUS_BY_EVENT = {"click": "queued", "view": "running", "purchase": "succeeded", "error": "failed"}


def job_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job state changes: one job per user, ordered by (ts, event_id)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    et = F.col("event_type")
    status = F.lit(None).cast("string")
    for k, v in JOB_STATUS_BY_EVENT.items():
        status = F.when(et == k, F.lit(v)).otherwise(status)
    eid = F.col("event_id").cast("string")
    return ev.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        "event_id", "ts",
        status.alias("status"),
        F.when(et == "signup", F.concat(F.lit("exec-"), eid)).alias("execution_id"),
        F.when(et == "purchase", F.concat(F.lit("reports/"), eid, F.lit(".md"))).alias("report_path"),
        F.when(et == "purchase", F.col("value") * 100).alias("duration_ms"),
        F.when(et == "error", F.concat(F.lit("error at event "), eid)).alias("error"),
        F.col("props").alias("payload"),
        F.when(et == "purchase", (F.col("event_id") % 3 == 0).cast("int")).alias("pii_detected"),
        F.when(et == "purchase", F.when(F.col("event_id") % 3 == 0, F.lit('["CPF", "E-mail"]')).otherwise(F.lit("[]"))).alias("pii_types"),
        F.when(et == "purchase", F.concat(F.lit('{"event": "'), eid, F.lit('"}'))).alias("summary"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit rows: click→tool_call, view→validation, error→error, else decision."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    kind = (F.when(et == "click", "tool_call").when(et == "view", "validation")
            .when(et == "error", "error").otherwise("agent_decision"))
    eid = F.col("event_id").cast("string")
    data = (
        F.when(et == "click", F.to_json(F.struct(
            F.lit("database_query").alias("tool_name"),
            F.struct(F.col("value").alias("value")).alias("inputs"),
            F.struct(F.lit("ok").alias("status")).alias("outputs"),
            F.col("value").alias("duration_ms"))))
        .when(et == "view", F.to_json(F.struct(
            F.lit("metrics").alias("validation_type"),
            (F.col("value") < 50).alias("valid"),
            F.when(F.col("value") < 50, F.lit("OK")).otherwise(F.lit("out of range")).alias("message"))))
        .when(et == "error", F.to_json(F.struct(
            F.lit("RuntimeError").alias("error_type"),
            F.concat(F.lit("failure "), eid).alias("error_message"))))
        .otherwise(F.to_json(F.struct(
            et.alias("decision"),
            F.concat(F.lit("event "), eid).alias("reasoning"))))
    )
    return ev.select(
        eid.alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        kind.alias("event_type"),
        F.concat(F.lit("exec-"), F.col("user_id").cast("string")).alias("execution_id"),
        data.alias("data"),
    )


# Titles of the feed fixture: more or fewer of the default terms, and a navigation item.
FEED_TOPICS = ("Casos de SRAG e gripe em alta", "Vacina contra gripe chega ao SUS", "Nav. mapa", "Jogo de domingo", "UTI lotada por SRAG", "Menu principal",
               "Feira de livros")


def built_pii_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with CPF / RG / phone / e-mail shapes built from customer keys."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")

    def digits(expr, n):
        return F.lpad((expr).cast("string"), n, "0")

    cpf = F.concat(digits(k % 1000, 3), F.lit("."), digits((k * 7) % 1000, 3), F.lit("."),
                   digits((k * 13) % 1000, 3), F.lit("-"), digits(k % 100, 2))
    rg = F.concat(digits(k % 100, 2), F.lit("."), digits((k * 3) % 1000, 3), F.lit("."),
                  digits((k * 11) % 1000, 3), F.lit("-"), (k % 10).cast("string"))
    phone = F.concat(F.lit("("), digits(k % 90 + 10, 2), F.lit(") 9"), digits(k % 10000, 4),
                     F.lit("-"), digits((k * 17) % 10000, 4))
    email = F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@example.com"))
    text = (F.when(k % 4 == 0, F.concat(F.lit("Paciente "), F.col("c_name"), F.lit(", CPF "), cpf,
                                        F.lit(", telefone "), phone))
            .when(k % 4 == 1, F.concat(F.lit("Documento RG "), rg, F.lit(" do paciente "), F.col("c_name")))
            .when(k % 4 == 2, F.concat(F.lit("Contato: "), email, F.lit(" ou "), phone))
            .otherwise(F.concat(F.lit("Registro sem dados pessoais de "), F.col("c_name"))))
    return c.select((-k).alias("doc_id"), text.alias("text"))


def pii_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents plus the built texts (negative ids)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.unionByName(built_pii_texts(spark, sf_dir))


def feed_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed date strings in five shapes built from ``events.ts``.

    0: RFC 822 with weekday and a numeric zone, 1: RFC 822 without weekday in
    GMT, 2: ISO 8601 with ``Z``, 3: ISO 8601 with an offset, 4: no date.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    shape = F.col("event_id") % 5
    raw = (F.when(shape == 0, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0300")))
           .when(shape == 1, F.concat(F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
           .when(shape == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
           .when(shape == 3, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
           .otherwise(F.lit("sem data")))
    return ev.select("event_id", raw.alias("raw_date"))
