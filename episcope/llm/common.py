"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.session import checkpoint_root, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; ``sf_dir`` may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Folders made since the innermost ``scratch`` began, one list for each that is open.
_MADE: list[list[str]] = []


def _noted(path: str) -> str:
    if _MADE:
        _MADE[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint, but columnar: later branches read
    only the columns they use, and the files outlive any executor. Inside ``scratch`` they
    go at its end.
    """
    path = _noted(shared_dir(df.sparkSession, name))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete, at the end, the folders that ``written`` and ``shared_folder`` have made in between, in that order.

    A frame that still reads them is of no use then: take the folder of a result out of the list.
    """
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.pop()
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder with all its files."""
    store, at = _store(spark, path)
    store.delete(at, True)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder in ``spark.checkpoint.dir`` for files that tasks write.

    A folder without a scheme lies in the session's default file system, as it does for Spark's own writers.
    """
    checkpoint_root(spark)
    store, at = _store(spark, shared_dir(spark, name))
    # Local paths come back as ``file:/x``; the writers of tasks want ``file:///x``.
    return _noted(re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/(?!/)", r"\1:///", store.makeQualified(at).toString()))


def write_file(uri: str, data: bytes, attempt: str) -> None:
    """Write one file whole under its final name, from a task.

    The bytes go to a name of this attempt first and are then moved: a task that is
    run again, or twice at once, leaves the same complete file.
    """
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    scratch = f"{path}.{attempt}"
    with store.open_output_stream(scratch) as out:
        out.write(data)
    store.move(scratch, path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is.

    Spark's ``lower`` has a byte-wise path for pure ASCII text; text with other
    characters goes through ``translate``, which leaves them alone.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def row_groups(values: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Cut a string or binary array into row ranges of about ``max_bytes`` each."""
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > max_bytes:
            yield lo, i
            lo, held = i, 0
        held += int(n)
    if lo < len(lengths):
        yield lo, len(lengths)


def unused_name(names: list[str], name: str) -> str:
    """``name``, underscored until no column has it."""
    while name in names:
        name = f"_{name}"
    return name


def struct_of(df: DataFrame, alias: str) -> Column:
    """All columns of ``df`` as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(alias)
