"""Audit log and report files (SRC-5, SNK-5, SNK-6).

The audit log is append-only JSON lines, one folder per batch of events and day; ``data``
is a JSON object in the file, whatever its shape (it depends on the event type). A batch
counts once its marker is there: readers skip batches without one, and a batch that is
written again under its id replaces its own files and nothing else, so a retry never
doubles events. In tables ``data`` is JSON text; ``operators.ops.flatten_events`` reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope import schema as S
from episcope.sources import versions

# ``data`` as it stands in the files: any JSON value.
_FILE_SCHEMA = ", ".join(f"{f.name} {'VARIANT' if f.name == 'data' else f.dataType.simpleString()}" for f in S.AUDIT_SCHEMA.fields)


def append_audit(events: DataFrame, path: str, batch_id: str | None = None) -> str:
    """SNK-5: append events as JSON lines, partitioned by day, and return the batch's id.

    Give a retry the ``batch_id`` of the first attempt: the events are then there once,
    whether or not the first attempt was finished. Text in ``data`` that is no JSON becomes a JSON string.
    """
    batch = batch_id or versions.fresh()
    root = path.rstrip("/")
    data = F.coalesce(F.try_parse_json("data"), F.expr("CAST(data AS VARIANT)")).alias("data")
    columns = [data if f.name == "data" else F.col(f.name) for f in S.AUDIT_SCHEMA.fields]
    (events.select(*columns, F.substring("timestamp", 1, 10).alias("day"))
     .write.mode("overwrite").partitionBy("day").json(f"{root}/batch={batch}"))
    versions.create(events.sparkSession, f"{root}/_committed/{batch}", batch)
    return batch


def _as_text(events: DataFrame) -> DataFrame:
    return events.select(*[F.to_json("data").alias("data") if f.name == "data" else F.col(f.name) for f in S.AUDIT_SCHEMA.fields])


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: the events of all finished batches (``data`` as JSON text); a folder without batches is read as plain JSON lines."""
    root = path.rstrip("/")
    folders = versions.names(spark, root)
    reader = spark.read.schema(_FILE_SCHEMA).option("recursiveFileLookup", True)
    if not any(n.startswith("batch=") for n in folders):
        return _as_text(reader.json(root))
    finished = [f"{root}/batch={b}" for b in sorted(versions.names(spark, f"{root}/_committed")) if f"batch={b}" in folders]
    return _as_text(reader.json(finished)) if finished else spark.createDataFrame([], S.AUDIT_SCHEMA)


def audit_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The events that arrive under ``path``, as a stream.

    Files appear whole, so a batch need not be finished. The files of a batch that is
    written again are new to a stream that has read the first ones.
    """
    reader = spark.readStream.schema(_FILE_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _as_text(reader.json(path))


def write_reports(reports: DataFrame, path: str, key: str = "execution_id",
                  column: str = "report") -> None:
    """SNK-6: one Markdown text per execution, in a folder per execution id.

    Only the folders of the executions written are replaced; earlier reports stay.
    """
    (reports.select(key, column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).text(path))


def read_reports(spark: SparkSession, path: str, key: str = "execution_id") -> DataFrame:
    """Reports written by ``write_reports`` (whole files, newlines kept)."""
    # The text writer ends each row with a newline; drop exactly that one.
    v = F.col("value")
    body = F.when(v.endswith("\n"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(v)
    return spark.read.schema(f"value STRING, `{key}` STRING").text(path, wholetext=True).select(key, body.alias("report"))
