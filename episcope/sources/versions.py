"""Partitioned Parquet tables whose readers see one whole state at a time.

Every load writes its files to a folder of its own, ``data/load=<id>/<column>=<value>``. A
*manifest* then lists, for each partition value, the loads that make it up; appends add a
load, reloads put one in the place of others, for all partitions or for some. Manifests are
numbered. A writer adds the next number only if nobody has taken it, and otherwise starts
again from the newer state, so two writers at once lose nothing; readers take the highest
number. Files of a failed load are in no manifest, so no reader sees them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
Parts = dict[str, list[str]]


@dataclass(frozen=True)
class Manifest:
    """One state of a table: the loads of every partition value, its schema, and notes of the writer for each partition."""

    number: int = -1
    column: str = ""
    schema: str = ""
    parts: Parts = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


def _folder(spark: SparkSession, path: str):
    """The store's file context and path: names and small files only, never table data."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop_path


def names(spark: SparkSession, path: str) -> list[str]:
    _, store, at = _folder(spark, path)
    return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole; False if there is one of that name already."""
    jvm, store, target = _folder(spark, path)
    scratch = jvm.org.apache.hadoop.fs.Path(f"{path}.{fresh()}")
    out = store.create(scratch, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), store.getConf())
    try:
        files.rename(store.makeQualified(scratch), store.makeQualified(target), _no_options(spark))
    except Exception as e:  # noqa: BLE001 - told apart by the Java class below
        store.delete(scratch, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file that ``create`` wrote."""
    return spark.read.text(path, wholetext=True).first()[0]


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete files or folders that nothing refers to any more."""
    for path in paths:
        _, store, at = _folder(spark, path)
        store.delete(at, True)


def fresh() -> str:
    """A name that nobody else uses."""
    return uuid.uuid4().hex


def _no_options(spark: SparkSession):
    return spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)


def head(spark: SparkSession, root: str) -> Manifest:
    """The newest state; an empty one if nothing was loaded."""
    folder = f"{root.rstrip('/')}/_manifests"
    numbers = [int(n[:-5]) for n in names(spark, folder) if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return Manifest()
    return Manifest(**json.loads(read_small(spark, f"{folder}/{max(numbers):012d}.json")))


def commit(spark: SparkSession, root: str, change: Callable[[Manifest], tuple[Parts, dict[str, str]]], column: str, schema: str) -> Manifest:
    """Add the state that ``change`` makes of the newest one; begins again whenever another writer was first."""
    while True:
        now = head(spark, root)
        parts, notes = change(now)
        state = Manifest(now.number + 1, column, schema, {p: loads for p, loads in parts.items() if loads}, notes)
        if create(spark, f"{root.rstrip('/')}/_manifests/{state.number:012d}.json", json.dumps(state.__dict__)):
            return state


def write_load(df: DataFrame, root: str, column: str) -> tuple[str, list[str]]:
    """Write the files of a load; returns its id and the values of ``column`` that it holds. No reader sees it yet."""
    load = fresh()
    path = f"{root.rstrip('/')}/data/load={load}"
    df.write.partitionBy(column).parquet(path)
    prefix = f"{column}="
    return load, sorted(n[len(prefix):] for n in names(df.sparkSession, path) if n.startswith(prefix))


def append(df: DataFrame, root: str, column: str) -> Manifest:
    """Add rows to the table."""
    load, values = write_load(df, root, column)
    return commit(df.sparkSession, root, lambda now: (now.parts | {v: [*now.parts.get(v, []), load] for v in values}, now.notes),
                  column, df.schema.json())


def replace(df: DataFrame, root: str, column: str, only: Iterable | None = None, notes: dict[str, str] | None = None) -> Manifest:
    """Put ``df`` in the place of the whole table, or of the partitions ``only``, rows of other partitions left out.

    A partition of ``only`` without rows in ``df`` is emptied. ``notes`` are kept for the partitions replaced.
    """
    values = None if only is None else {NULL_PARTITION if v is None else str(v) for v in only}
    if only is not None:
        kept = [v for v in only if v is not None]
        own = F.col(column).isin(kept) if kept else F.lit(False)
        df = df.where(own | F.col(column).isNull() if None in only else own)
    load, held = write_load(df, root, column)

    def change(now: Manifest) -> tuple[Parts, dict[str, str]]:
        stay = {} if values is None else {p: loads for p, loads in now.parts.items() if p not in values}
        old_notes = {p: n for p, n in now.notes.items() if p in stay}
        return stay | {v: [load] for v in held}, old_notes | (notes or {})

    return commit(df.sparkSession, root, change, column, df.schema.json())


def read(spark: SparkSession, root: str, values: Iterable | None = None, state: Manifest | None = None) -> DataFrame:
    """The newest state of the table, or ``state``; with ``values`` only the folders of those partitions."""
    state = state or head(spark, root)
    if state.number < 0:
        raise FileNotFoundError(f"nothing was loaded to {root}")
    schema = T.StructType.fromJson(json.loads(state.schema))
    wanted = state.parts if values is None else [p for p in ({NULL_PARTITION if v is None else str(v) for v in values}) if p in state.parts]
    data = f"{root.rstrip('/')}/data"
    folders = [f"{data}/load={load}/{state.column}={p}" for p in sorted(wanted) for load in state.parts[p]]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", data).parquet(*folders).select(*[f"`{c}`" for c in schema.names])
