"""Token counts by separator scan over flat token files without an index.

A flat file is nothing but token ids, little-endian and of one width; documents end with an
end-of-document id and may run on from one file into the next. Each task searches its
blocks for that id; a prefix scan over the blocks (tokens so far, documents so far, place
of the last separator) then stitches documents together across block and file borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episcope.llm.common import row_groups, shared_folder, write_file, written
from episcope.llm.encoding import encoder, read_tokenizer
from episcope.llm.token_files import PART_DIGITS, with_starts

FILE_TOKENS = 1 << 20
BLOCK_TOKENS = 1 << 16


def write_flat_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text: str = "text",
                     width: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write whole texts as they are read, as flat files ``<part>-<seq>.tok`` of ``file_tokens`` ids each.

    Every document ends with ``end_id``, which no text can produce: special tokens in a
    text are encoded as text. Ids take ``width`` bytes; files are cut at a token count,
    wherever documents end. Nothing is shuffled. Returns, already written, the order of
    the documents in the files: ``part``, ``place`` and ``id``; it says nothing of where they lie.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encode = encoder(vocabulary.value, True).encode
        part, held, seq, place = context.partitionId(), np.zeros(0, kind), 0, 0

        def store(ids: np.ndarray) -> None:
            name = f"{part:0{PART_DIGITS}d}-{seq:0{PART_DIGITS}d}.tok"
            write_file(f"{folder}/{name}", ids.tobytes(), f"attempt-{context.taskAttemptId()}")

        for batch in batches:
            for lo, hi in row_groups(batch.column(1), 1 << 21):
                flat, counts = encode(batch.column(1).slice(lo, hi - lo))
                if len(flat) and int(flat.max()) > np.iinfo(kind).max:
                    raise ValueError(f"ids do not fit in {width} bytes")
                held = np.concatenate([held, np.insert(flat, np.cumsum(counts), np.uint32(end_id)).astype(kind)])
                while len(held) >= file_tokens:
                    store(held[:file_tokens])
                    held, seq = held[file_tokens:], seq + 1
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), batch.column(0).slice(lo, n)],
                    names=["part", "place", "id"])
                place += n
        if len(held):
            store(held)

    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"part long, place long, id {id_type}"), "document-order")


def separator_scan(spark: SparkSession, folder: str, end_id: int, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """Count the tokens of every document in the flat files of ``folder``, taken in order of their names.

    Returns ``doc_no`` (0, 1, ... over all files), ``start`` (tokens before it), ``n_tokens``
    (with its separator) and ``ended``; tokens after the last separator form a last document
    with ``ended`` false. A file whose size is no multiple of ``width`` is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}")
                for seq, lo in enumerate(range(0, len(ids), block_tokens)):
                    block = ids[lo:lo + block_tokens]
                    at = np.flatnonzero(block == end_id)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()]), pa.array([seq], pa.int64()), pa.array([len(block)], pa.int64()),
                         pa.array([len(at)], pa.int64()), pa.array([at.astype(np.int32)], pa.list_(pa.int32()))],
                        names=["part", "seq", "n_tokens", "n_ends", "at"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1), "content").mapInArrow(
        run, "part string, seq long, n_tokens long, n_ends long, at array<int>")
    blocks = written(found, "separators")
    # Files, not blocks, are scanned in one sequence; the blocks of a file follow in another.
    placed = with_starts(blocks, "n_tokens", "n_ends")
    ends = placed.select(
        (F.col("n_tokens_start") + F.try_element_at("at", F.lit(-1))).alias("last"), "n_tokens", "n_ends", "n_tokens_start", "n_ends_start", "at", "part", "seq")
    # What a block's first document begins with: the token after the last separator before the block.
    file_last = ends.groupBy("part").agg(F.max("last").alias("last"))
    before_file = file_last.select(F.col("part").alias("of_part"), F.max("last").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    carried = (ends.withColumn("near", F.max("last").over(within)).join(before_file, F.col("part") == F.col("of_part"))
               .withColumn("carry", F.coalesce("near", "earlier", F.lit(-1).cast("long"))))
    one = carried.select("n_tokens_start", "n_ends_start", "carry", "at", F.posexplode("at").alias("i", "pos")).select(
        (F.col("n_ends_start") + F.col("i")).alias("doc_no"),
        (F.when(F.col("i") == 0, F.col("carry")).otherwise(F.col("n_tokens_start") + F.get("at", F.col("i") - 1)) + 1).alias("start"),
        (F.col("n_tokens_start") + F.col("pos") + 1).alias("until"))
    docs = one.select("doc_no", "start", (F.col("until") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = ends.agg(F.sum("n_tokens").alias("all"), F.sum("n_ends").alias("doc_no"),
                     (F.coalesce(F.max("last"), F.lit(-1).cast("long")) + 1).alias("start"))
    open_end = whole.where(F.col("all") > F.col("start")).select(
        "doc_no", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.union(open_end)


def numbered(order: DataFrame) -> DataFrame:
    """``(id, doc_no)``: the place of every document in the stream of all files."""
    sizes = order.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"))
    return order.join(starts, F.col("part") == F.col("of")).select("id", (F.col("docs_before") + F.col("place")).alias("doc_no"))


def token_counts(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as flat token files, scan them, and give each document's count its id again.

    One row per input row: ``id``, ``doc_no``, ``start`` and ``n_tokens``. The n-th document
    of the scan is the n-th that was written; that order is the one in which Spark read
    the rows, so ``doc_no`` and ``start`` belong to this run's files.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "flat-token-files")
    order = write_flat_files(docs, tokenizer_path, folder, end_id, id_col, text)
    if order.isEmpty():
        return order.select("id", *[F.lit(0).cast("long").alias(c) for c in ("doc_no", "start", "n_tokens")])
    counts = separator_scan(spark, folder, end_id).select(F.col("doc_no").alias("of_doc"), "start", "n_tokens")
    return numbered(order).join(counts, F.col("doc_no") == F.col("of_doc")).select("id", "doc_no", "start", "n_tokens")
