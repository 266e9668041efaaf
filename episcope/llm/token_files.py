"""Token-ID output: documents in ascending id order as shards of directly addressable codes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episcope.llm import dac
from episcope.llm.common import row_groups, shared_folder, write_file, written
from episcope.llm.encoding import encoder, read_tokenizer

SHARD_TOKENS = 1 << 21  # some 4 MB a file; a task holds one shard
PART_DIGITS = 6


def in_id_order(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, text)`` dealt by ranges of the id and sorted in each: NULL ids first, ties by text.

    Rows that share an id are spread by a hash of their text and their place in the input,
    so one id that many rows carry does not land in one task.
    """
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    return rows.repartitionByRange("id", "tie", "place").sortWithinPartitions("id", "tie", "place").select("id", "text")


def write_token_shards(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text: str = "text",
                       end_id: int = 0, special_as_text: bool = False, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards ``<part>-<seq>.dac`` to ``folder``.

    Shards in order of their names hold all documents in ascending id order; a shard ends
    after the document that fills it. NULL text counts as empty: only the end id. Returns
    the manifest, already written: ``part``, ``seq``, ``file``, ``n_docs``, ``n_tokens``.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("shards hold integer ids")
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, seq = context.partitionId(), 0
        encode = encoder(vocabulary.value, special_as_text).encode
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            name = f"{part:0{PART_DIGITS}d}-{seq:0{PART_DIGITS}d}.dac"
            data = dac.encode_shard(doc_ids, np.concatenate(ids), np.concatenate(lengths))
            write_file(f"{folder}/{name}", data, f"attempt-{context.taskAttemptId()}")
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": len(doc_ids), "n_tokens": held}])

        for batch in batches:
            for lo, hi in row_groups(batch.column(1), 1 << 21):
                flat, counts = encode(batch.column(1).slice(lo, hi - lo))
                flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
                names, counts = batch.column(0).slice(lo, hi - lo).to_pylist(), counts + 1
                ends = np.concatenate(([0], np.cumsum(counts)))
                at = 0
                while at < len(names):
                    # Up to and with the document that fills the shard.
                    until = min(int(np.searchsorted(ends, ends[at] + shard_tokens - held)), len(names))
                    doc_ids += names[at:until]
                    ids.append(flat[ends[at]:ends[until]])
                    lengths.append(counts[at:until])
                    held, at = held + len(ids[-1]), until
                    if held >= shard_tokens:
                        yield shard()
                        doc_ids, ids, lengths, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield shard()

    return written(in_id_order(docs, id_col, text).mapInArrow(run, "part long, seq long, file string, n_docs long, n_tokens long"), "shards")


def with_starts(manifest: DataFrame, *sums: str) -> DataFrame:
    """Add ``<sum>_start``: the sum over all files before, in order of ``part`` and ``seq``.

    A prefix scan in two levels: over the totals of the parts (as many as there were tasks)
    and over the files of each part.
    """
    totals = manifest.groupBy("part").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select(F.col("part").alias("of_part"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_part") for c in sums])
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_within") for c in sums])
    joined = files.join(parts, F.col("part") == F.col("of_part"))
    return joined.select(*manifest.columns, *[(F.col(f"{c}_part") + F.col(f"{c}_within")).alias(f"{c}_start") for c in sums])


def read_token_shards(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Read every shard of ``folder`` back: per document ``id``, ``start``, ``n_tokens`` and ``ids_crc32``.

    ``start`` counts the ids of all documents before it; the checksum is the unsigned CRC-32
    of its ids, end id included, as little-endian unsigned 32-bit integers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                shard = dac.ShardReader(data.as_buffer())
                ends = shard.doc_ends.tolist()
                starts = [0, *ends[:-1]]
                ids = memoryview(shard.tokens(0, shard.n_tokens).astype("<u4").tobytes())
                sums = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(ends), pa.string()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(sums, pa.int64())],
                    names=["file", "id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    docs = files.select(name, "content").mapInArrow(run, "file string, id long, at long, n_tokens long, ids_crc32 long")
    starts = with_starts(manifest, "n_tokens").select(F.col("file").alias("of"), "n_tokens_start")
    return docs.join(starts, F.col("file") == F.col("of")).select(
        F.col("id").cast(id_type).alias("id"), (F.col("n_tokens_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards of ``docs`` to a fresh shared folder and return what they hold, one row per input row."""
    folder = shared_folder(docs.sparkSession, "token-shards")
    manifest = write_token_shards(docs, tokenizer_path, folder, id_col, text)
    if manifest.isEmpty():
        return docs.sparkSession.range(0).selectExpr("id", "0L AS start", "0L AS n_tokens", "0L AS ids_crc32")
    return read_token_shards(docs.sparkSession, folder, manifest)
