"""Case files in, curated tables out (SRC-1..3, SNK-1..4).

* Raw notification files are ``;``-separated Latin-1 CSV; every column is read
  as text (never ``inferSchema``: a full extra pass, and it guesses) and typed
  in ``operators.clean``. Yearly layouts differ in columns and their order: tasks
  read the first line of every file, and files of one header are read by one scan.
* The curated table is Parquet partitioned by notification year, so the year
  filter of every indicator prunes whole directories. Appends, full reloads and
  reloads of single years each become visible at once (``sources.versions``), so
  a failed load never leaves readers with an empty or half-written table (the
  source deletes first and loads after).
"""

from __future__ import annotations

import csv
import datetime as dt
import re
import time
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope import schema as S
from episcope.operators.clean import clean_cases, prune_columns
from episcope.sources import versions

_BLOCK = 1 << 16  # bytes of a file read at a time until its first line ends


def read_cases_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """SRC-1: the 24 relevant columns of the raw files under ``path``; a missing column raises.

    Files may differ in columns and their order: they are matched by name.
    """
    return cases_of_files(spark.read.format("binaryFile").load(path), sep, encoding)


def cases_of_files(files: DataFrame, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """The relevant columns of the CSV files listed in ``files`` (column ``path``), whatever their layouts.

    One pass of tasks reads headers; then there is one scan for each layout, so the number
    of jobs does not grow with the files. Empty files hold no rows.
    """
    spark = files.sparkSession
    parts = [prune_columns(_csv_reader(spark.read, sep, encoding).schema(text_schema(header)).csv(names))
             for header, names in file_layouts(files, sep, encoding)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], S.RAW_SCHEMA)


def file_layouts(files: DataFrame, sep: str = ";", encoding: str = "ISO-8859-1") -> list[tuple[list[str], list[str]]]:
    """``(header, file names)`` for each layout among the CSV files listed in ``files``; files without a header are left out.

    Tasks open the files and read no more than their first blocks; the driver gets a row for
    each layout. For files in a store that only Spark can open, Spark looks through their
    lines for the one that holds all the names of required columns.
    """
    def peek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_first_line(p, encoding) for p in batch.column(0).to_pylist()]
            header = [None if line is None else next(csv.reader([line], delimiter=sep), []) for line in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(header, pa.list_(pa.string()))], names=["path", "header"])

    headers = files.select("path").mapInArrow(peek, "path string, header array<string>")
    layouts = {None if r[0] is None else tuple(r[0]): r[1] for r in _by_header(headers)}
    closed = layouts.pop(None, None)
    if closed:
        for r in _by_header(_headers_by_spark(files.sparkSession, closed, sep, encoding)):
            layouts.setdefault(tuple(r[0]), []).extend(r[1])
    layouts.pop((), None)
    return [(list(header), sorted(names)) for header, names in sorted(layouts.items())]


def _by_header(headers: DataFrame) -> list:
    return headers.groupBy("header").agg(F.collect_list("path")).collect()


def _headers_by_spark(spark: SparkSession, names: list[str], sep: str, encoding: str) -> DataFrame:
    needed = [c for c in S.RAW_COLUMNS if c not in S.OPTIONAL_COLUMNS]
    lines = spark.read.text(names).select(F.col("_metadata.file_path").alias("uri"), F.decode(F.col("value").cast("binary"), encoding).alias("line"))
    headers = lines.where(reduce(lambda a, b: a & b, [F.contains("line", F.lit(c)) for c in needed]))
    split = F.transform(F.split("line", re.escape(sep)), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    listed = spark.read.format("binaryFile").load(names).select("path", F.col("_metadata.file_path").alias("of"))
    return listed.join(headers, F.col("of") == F.col("uri")).groupBy("path").agg(F.first(split).alias("header"))


def _first_line(path: str, encoding: str) -> str | None:
    """A file's first line that is not blank; empty if there is none, None if the file cannot be opened from here."""
    from pyarrow import fs

    try:
        if path.startswith("file:") or path.startswith("/"):
            store, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_stream(inner, compression="detect") as stream:
            held = b""
            while True:
                block = stream.read(_BLOCK)
                held += block
                whole = held if not block else held[:held.rfind(b"\n") + 1]
                for line in whole.splitlines():
                    if line.strip():
                        return line.decode(encoding).removeprefix("\ufeff")
                if not block:
                    return ""
    except (OSError, ValueError, NotImplementedError):
        return None


def text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _csv_reader(reader, sep: str, encoding: str):
    # A backslash is ordinary text; ``enforceSchema`` off makes a file whose header differs fail.
    return reader.options(sep=sep, encoding=encoding, header=True, inferSchema=False, escape='"', enforceSchema=False)


def sample_rows(raw: DataFrame, n: int | None, order: Sequence[str] = ()) -> DataFrame:
    """SRC-2: the first ``n`` raw rows (before cleaning); ``None`` keeps all.

    Row order is only defined within one file, as with any split file read; with ``order``
    the rows are the first in order of these columns, NULLs first, the same on every run.
    """
    if n is None:
        return raw
    return raw.orderBy(*order).limit(n) if order else raw.limit(n)


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-1: save the processed frame (overwrite); ``fmt='csv'`` writes a header."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-3: re-read a processed table; CSV columns get back the types that cleaning gave them.

    Dates are DATE, coded answers and flags INT, the age DOUBLE, codes of places text; a value
    that does not fit is NULL. Columns that cleaning does not know stay text.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = spark.read.options(header=True, escape='"').csv(path)
    kinds = S.PROCESSED_TYPES
    return df.select(*[F.col(c).try_cast(kinds[c.lower()]).alias(c) if c.lower() in kinds else F.col(c) for c in df.columns])


def _curated_with_year(curated: DataFrame) -> DataFrame:
    return curated.withColumn("year", F.year("dt_notific"))


def load_curated(curated: DataFrame, table_root: str) -> versions.Manifest:
    """SNK-2: append curated rows, by notification year; readers see all of them or none."""
    return versions.append(_curated_with_year(curated), table_root, "year")


def replace_curated(curated: DataFrame, table_root: str, years: Iterable[int] | None = None) -> versions.Manifest:
    """SNK-3: atomic reload of the whole table, or of ``years`` only; rows of other years are then left out."""
    return versions.replace(_curated_with_year(curated), table_root, "year", None if years is None else list(years))


def read_curated(spark: SparkSession, table_root: str, year: int | None = None) -> DataFrame:
    """The curated table as its loads and reloads have left it; ``year`` reads that year's folders only."""
    return versions.read(spark, table_root, None if year is None else [year])


def ingest(spark: SparkSession, raw_path: str, table_root: str, year: int | None = 2024,
           source_url: str | None = None, metadata_path: str | None = None,
           provider: str = "DATASUS/SIVEP-Gripe") -> dict:
    """SRC-1 → CLEAN → SNK-3, then SNK-4: one load-history row (appended as JSON).

    The kept-row count is observed while the table is written (``observe``),
    so there is no second pass over the data to count it.
    """
    t0 = time.time()
    obs = Observation("ingest")
    curated = clean_cases(read_cases_csv(spark, raw_path), year=year).observe(
        obs, F.count(F.lit(1)).alias("rows"))
    state = replace_curated(curated, table_root)
    meta = {
        "provider": provider,
        "source_type": "parquet_table",
        "source_url": source_url,
        "raw_path": raw_path,
        "table_path": f"{table_root.rstrip('/')}#{state.number}",
        "rows_processed": int(obs.get["rows"]),
        "duration_ms": round((time.time() - t0) * 1000, 2),
        "ingested_at": dt.datetime.now(dt.timezone.utc).isoformat(),
    }
    if metadata_path:
        write_load_metadata(spark, meta, metadata_path)
    return meta


LOAD_HISTORY_SCHEMA = T.StructType([
    T.StructField("provider", T.StringType()), T.StructField("source_type", T.StringType()),
    T.StructField("source_url", T.StringType()), T.StructField("raw_path", T.StringType()),
    T.StructField("table_path", T.StringType()), T.StructField("rows_processed", T.LongType()),
    T.StructField("duration_ms", T.DoubleType()), T.StructField("ingested_at", T.StringType()),
])


def write_load_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """SNK-4: append one metadata row to the load history (JSON lines)."""
    row = tuple(meta.get(f.name) for f in LOAD_HISTORY_SCHEMA.fields)
    spark.createDataFrame([row], LOAD_HISTORY_SCHEMA).coalesce(1).write.mode("append").json(path)
