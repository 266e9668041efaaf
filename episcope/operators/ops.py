"""Job-ledger and audit-log analytics (OPS-1..9) over append-only change tables.

The source mutates job rows in place; here a job's state is a *fold* of its
change events. Every fold is a ``groupBy(job_id)`` with ``max_by``/``min_by``
aggregates, which Spark combines map-side: a job with a third of all events
still reaches the shuffle as one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope import schema as S

# Order of changes within a job: event time, then a sequence number.
ORDER_COLUMNS = ("ts", "event_id")


def _ord(*cols: str) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def _last_set(column: str, order: Column) -> Column:
    """Value from the last change that set ``column`` (NULL-ordered rows are skipped)."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order))

# Columns that a success sets besides the report; NULL in change logs written without them.
RESULT_COLUMNS = {"pii_detected": "int", "pii_types": "string", "summary": "string"}


def latest_job_state(changes: DataFrame, order_cols: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """OPS-4: fold state changes into one row per job.

    ``status`` is the last status set; ``execution_id``, ``report_path``,
    ``duration_ms``, ``pii_detected``, ``pii_types`` and ``summary`` (JSON text)
    come from the last change that set them; ``error`` is the
    last failure's message unless a later success cleared it; ``payload`` is
    the creation payload.
    """
    order = _ord(*order_cols)
    ends = F.col("status").isin("failed", "succeeded")
    return changes.groupBy("job_id").agg(
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        _last_set("status", order).alias("status"),
        _last_set("execution_id", order).alias("execution_id"),
        _last_set("report_path", order).alias("report_path"),
        _last_set("duration_ms", order).alias("duration_ms"),
        F.max_by(F.col("error"), F.when(ends, order)).alias("error"),
        F.min_by(F.col("payload"), order).alias("payload"),
        *[(_last_set(c, order) if c in changes.columns else F.lit(None).cast(kind)).alias(c)
          for c, kind in RESULT_COLUMNS.items()],
    )


def status_counts(jobs: DataFrame) -> DataFrame:
    """OPS-1: jobs per status, zero-filled over the four statuses, with the total.

    Counts are taken over the four known statuses only, so the broadcast side
    has at most four rows; the left join and the total window are constant-sized.
    """
    spark: SparkSession = jobs.sparkSession
    dim = spark.createDataFrame([(i, s) for i, s in enumerate(S.JOB_STATUSES)],
                                "pos INT, status STRING")
    counts = (jobs.where(F.col("status").isin(*S.JOB_STATUSES))
              .groupBy("status").agg(F.count(F.lit(1)).alias("n")))
    joined = dim.join(F.broadcast(counts), "status", "left")
    from pyspark.sql import Window
    return joined.select(
        "status", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("jobs"),
        F.sum(F.coalesce(F.col("n"), F.lit(0))).over(Window.partitionBy()).cast("bigint")
        .alias("total_jobs"),
    )


def clamp_limit(limit: int) -> int:
    return max(1, min(int(limit), 100))


def recent_jobs(jobs: DataFrame, limit: int = 20, status: str | None = None) -> DataFrame:
    """OPS-2: newest first (``job_id`` breaks ties), optional status filter, limit in [1, 100]."""
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(clamp_limit(limit))


def backlog_head(jobs: DataFrame) -> DataFrame:
    """OPS-3: the oldest queued job (the read half of a claim)."""
    return jobs.where(F.col("status") == "queued").orderBy("created_at", "job_id").limit(1)


# A payload is any JSON object: its values keep their own types.
PAYLOAD_SCHEMA = "MAP<STRING, VARIANT>"


def _payload(schema: str = PAYLOAD_SCHEMA) -> Column:
    return F.from_json(F.coalesce(F.nullif(F.col("payload"), F.lit("")), F.lit("{}")), schema)


def retry_plan(jobs: DataFrame) -> DataFrame:
    """OPS-7: failed jobs → retry payload = original payload, with ``execution_id`` when set.

    Every key of the payload stays, nested values and explicit NULLs too. A payload that
    is no JSON object counts as empty.
    """
    failed = jobs.where(F.col("status") == "failed").select("job_id", "execution_id", _payload().alias("p"))
    empty = F.expr("CAST(map() AS MAP<STRING, VARIANT>)")
    own = F.map_filter(F.coalesce("p", empty), lambda k, v: (k != "execution_id") | F.col("execution_id").isNull())
    added = F.when(F.col("execution_id").isNull(), empty).otherwise(F.expr("map('execution_id', CAST(execution_id AS VARIANT))"))
    return failed.select("job_id", F.to_json(F.map_concat(own, added)).alias("retry_payload"))


def decode_json_columns(jobs: DataFrame, payload_schema: str = PAYLOAD_SCHEMA,
                        summary_schema: str = "MAP<STRING, STRING>") -> DataFrame:
    """OPS-8: ``pii_types`` NULL/empty → [], ``payload`` → {}, ``summary`` empty → NULL."""
    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")
    return jobs.withColumns({
        "pii_types": F.from_json(F.when(blank("pii_types"), F.lit("[]")).otherwise(F.col("pii_types")),
                                 "ARRAY<STRING>"),
        "payload": F.from_json(F.when(blank("payload"), F.lit("{}")).otherwise(F.col("payload")),
                               payload_schema),
        "summary": F.when(~blank("summary"), F.from_json(F.col("summary"), summary_schema)),
    })


def evolve_schema(jobs: DataFrame) -> DataFrame:
    """OPS-9: a snapshot written before ``payload`` existed reads with ``'{}'``."""
    if "payload" not in jobs.columns:
        return jobs.withColumn("payload", F.lit("{}"))
    return jobs.withColumn("payload", F.coalesce(F.col("payload"), F.lit("{}")))


# ------------------------------------------------------------------ audit log

AUDIT_DATA_SCHEMA = T.StructType([
    T.StructField("decision", T.StringType()), T.StructField("reasoning", T.StringType()),
    T.StructField("tool_name", T.StringType()), T.StructField("duration_ms", T.DoubleType()),
    T.StructField("validation_type", T.StringType()), T.StructField("valid", T.BooleanType()),
    T.StructField("message", T.StringType()), T.StructField("error_type", T.StringType()),
    T.StructField("error_message", T.StringType()), T.StructField("news_count", T.LongType()),
    T.StructField("charts_generated", T.LongType()), T.StructField("report_path", T.StringType()),
    # Values of any shape stay JSON text.
    T.StructField("metadata", T.StringType()), T.StructField("inputs", T.StringType()),
    T.StructField("outputs", T.StringType()), T.StructField("stack_trace", T.StringType()),
    T.StructField("metrics", T.StringType()),
])


def flatten_events(audit: DataFrame) -> DataFrame:
    """OPS-6: one column per payload field of the five event shapes (NULL where absent)."""
    d = F.from_json(F.col("data"), AUDIT_DATA_SCHEMA)
    return audit.select(
        "event_id", "event_type", "execution_id",
        F.try_to_timestamp("timestamp").alias("ts"),
        *[d.getField(f.name).alias(f.name) for f in AUDIT_DATA_SCHEMA.fields])


def execution_counts(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """What each event adds to its execution: its instant in microseconds and one count of its kind; ``keep`` stays, too."""
    et = F.col("event_type")
    at = F.unix_micros("ts")
    one = lambda test: test.cast("bigint")
    return events.select(
        "execution_id", *keep, at.alias("first_us"), at.alias("last_us"),
        one(et.eqNullSafe("tool_call")).alias("total_tool_calls"), one(et.eqNullSafe("validation")).alias("total_validations"),
        one(et.eqNullSafe("validation") & ~F.coalesce(F.col("valid"), F.lit(False))).alias("failed_validations"),
        one(et.eqNullSafe("error")).alias("total_errors"))


def execution_record(counts: DataFrame) -> DataFrame:
    """The summary of executions from their summed counts and first and last instants."""
    return counts.select(
        "execution_id", ((F.col("last_us") - F.col("first_us")) / 1000.0).alias("duration_ms"), "total_tool_calls",
        "total_validations", "failed_validations", "total_errors", (F.col("total_errors") == 0).alias("success"))


def execution_summary(events: DataFrame) -> DataFrame:
    """OPS-5: per execution — duration, tool calls, validations, failures, errors, success.

    Events without an execution id belong to no execution.
    """
    sums = ("total_tool_calls", "total_validations", "failed_validations", "total_errors")
    counted = execution_counts(events.where(F.col("execution_id").isNotNull()))
    return execution_record(counted.groupBy("execution_id").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *[F.sum(c).alias(c) for c in sums]))
