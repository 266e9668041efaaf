"""Exact dedup by content-defined chunk recipes.

A rolling hash over the last 32 bytes cuts each text into chunks, wherever they stand in
it. Chunks are deduplicated across the corpus by digest and content, which verifies that
a digest names one content; a text's recipe is its ordered list of chunk identifiers.
Texts are equal exactly when their recipes are, so everything after the chunk step moves
16 bytes for each chunk instead of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import row_groups, written

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)
REACH = 32  # bytes that the rolling hash sees
MAX_COLLIDED = 1000  # contents of collided digests that a task holds; with more of them, digests are made longer
LONGEST_DIGEST = 64


@dataclass(frozen=True)
class Chunking:
    """Chunk sizes in bytes (the mean is about ``least + 2 ** mean_bits``) and digest length."""

    least: int = 256
    mean_bits: int = 11
    most: int = 16384
    digest_bytes: int = 16


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash of the ``REACH`` bytes that end at each position, by doubling the reach."""
    h = GEAR[data]
    reach = 1
    while reach < REACH:
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = longer, reach * 2
    return h


def cut(texts: list[bytes], p: Chunking) -> list[list[bytes]]:
    """Content-defined chunks of each text; an empty text has none."""
    if p.least < REACH or p.most < p.least:
        raise ValueError(f"least must be at least {REACH} and at most `most`")
    flat = np.frombuffer(b"".join(texts), np.uint8)
    marks = np.flatnonzero(rolling_hash(flat) >> np.uint32(32 - p.mean_bits) == 0) + 1 if len(flat) else flat
    ends = np.cumsum([len(t) for t in texts])
    out, begin = [], 0
    for text, end, lo, hi in zip(texts, ends.tolist(), np.searchsorted(marks, ends - [len(t) for t in texts], "right").tolist(),
                                 np.searchsorted(marks, ends, "left").tolist(), strict=True):
        chunks, start = [], 0
        for mark in (marks[lo:hi] - begin).tolist() if len(text) > p.least else ():
            while mark - start > p.most:
                chunks.append(text[start:start + p.most])
                start += p.most
            if mark - start >= p.least:
                chunks.append(text[start:mark])
                start = mark
        while start < len(text):
            chunks.append(text[start:start + p.most])
            start += p.most
        out.append(chunks)
        begin = end
    return out


def _digest(chunk: bytes, p: Chunking) -> bytes:
    return hashlib.blake2b(chunk, digest_size=p.digest_bytes).digest()


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        values = batch.column(column).cast(pa.binary())
        for lo, hi in row_groups(values, 4 << 20):
            yield batch.slice(lo, hi - lo), [t or b"" for t in values.slice(lo, hi - lo).to_pylist()]


def chunk_contents(docs: DataFrame, text: str, p: Chunking) -> DataFrame:
    """Distinct ``(digest, content)`` over all chunks of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0):
            chunks = list({c for t in cut(texts, p) for c in t})
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(c, p) for c in chunks], pa.binary()), pa.array(chunks, pa.binary())], names=["digest", "content"])

    return docs.select(docs[f"`{text}`"].alias("text")).mapInArrow(run, "digest binary, content binary").distinct()


def collided_chunks(docs: DataFrame, text: str, p: Chunking) -> dict[bytes, dict[bytes, int]] | None:
    """Digests that name several contents, with a number for each content; normally none. None if there are too many.

    Every chunk's content is compared with the others of its digest, by Spark, in the
    grouping of ``chunk_contents``. Only collided contents come to the driver, ``MAX_COLLIDED`` at most.
    """
    contents = chunk_contents(docs, text, p)
    digests = [r["digest"] for r in contents.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
               .select("digest").limit(MAX_COLLIDED + 1).collect()]
    if not digests:
        return {}
    if len(digests) > MAX_COLLIDED:
        return None
    rows = contents.where(F.col("digest").isin(digests)).limit(MAX_COLLIDED + 1).collect()
    if len(rows) > MAX_COLLIDED:
        return None
    found: dict[bytes, dict[bytes, int]] = {}
    for digest, content in sorted((bytes(r["digest"]), bytes(r["content"])) for r in rows):
        numbers = found.setdefault(digest, {})
        numbers[content] = len(numbers)
    return found


def verified_chunking(docs: DataFrame, text: str, p: Chunking) -> tuple[Chunking, dict[bytes, dict[bytes, int]]]:
    """``p`` and its collided chunks; with digests twice as long, and again, while there are too many of these."""
    collided = collided_chunks(docs, text, p)
    while collided is None:
        if p.digest_bytes >= LONGEST_DIGEST:
            raise RuntimeError(f"more than {MAX_COLLIDED} contents share digests of {p.digest_bytes} bytes")
        p = replace(p, digest_bytes=min(2 * p.digest_bytes, LONGEST_DIGEST))
        collided = collided_chunks(docs, text, p)
    return p, collided


def recipes(docs: DataFrame, id_col: str, text: str, p: Chunking) -> DataFrame:
    """One row per input row: ``id``, ``text_sha256`` and ``recipe``, the verified chunk identifiers in order."""
    p, collided = verified_chunking(docs, text, p)

    def identifier(chunk: bytes) -> bytes:
        digest = _digest(chunk, p)
        # A number of fixed length after a collided digest keeps identifiers apart.
        return digest + collided[digest][chunk].to_bytes(4, "big") if digest in collided else digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 1):
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                pa.array([[identifier(c) for c in chunks] for chunks in cut(texts, p)], pa.list_(pa.binary()))],
                names=["id", "text_sha256", "recipe"])

    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text}`"].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, text_sha256 string, recipe array<binary>")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: Chunking = Chunking()) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Rows are equal if their texts are identical; NULL counts as empty. The row of the
    largest id stays (NULL ids come last); of rows that repeat that id and text, one.
    """
    rows = written(recipes(docs, id_col, text, p).groupBy("recipe", "text_sha256", "id").agg(F.count("*").alias("copies")), "recipes")
    groups = rows.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    # Only groups of several rows need the join; written out, it can split a group that many rows share.
    shared = written(groups.where("group_size > 1").withColumnRenamed("recipe", "of"), "recipe-groups")
    found = rows.join(shared, rows["recipe"] == shared["of"], "left").select(
        "id", F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return found.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
