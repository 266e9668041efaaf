"""Target-distribution importance resampling of documents.

A document's features are its runs of one to three words, hashed into buckets. Each bucket
has a gain: the logarithm of its share in the target texts over its share in all documents,
in thousandths. A document's weight is the sum of the gains of its features, read from one
array; with Gumbel noise added, the highest scores are a sample without replacement.

The k-th highest score is found by a distributed quickselect: random pivot keys, an exact
three-way count of the rows above, at and below each of them, and a narrower range of keys
for the next round. Only the winners are then sorted, by ranges in many tasks, and ranked.

NULL and empty texts have no features and weight 0. Repeated rows are rows like any other:
ties go to the smaller id, NULL ids last, then to the place in the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.llm.common import row_groups, written

N_BUCKETS = 10_000
SEED = 42
PIVOTS = 15  # random keys that one counting pass compares with every row still in range
LONG_WORD = 60  # bytes; grams with a longer word are hashed one by one

_KEEP = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_WORD_BYTES = bytes(b if b in _KEEP else 0x20 for b in (bytes([k]).lower()[0] for k in range(256)))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 without its start and end masks is linear; three tables follow from its polynomial.

    ``step[b]``: the register of byte ``b``. ``shift[n, j, b]``: byte ``b`` at place ``j`` of a
    register moved on by ``n`` zero bytes. ``mask[n]``: what the masks add to ``n`` bytes.
    """
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1).astype(np.uint32)
    longest = 2 * LONG_WORD + 2
    shift = np.empty((longest, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, longest):
        shift[n] = step[shift[n - 1] & 0xFF] ^ (shift[n - 1] >> 8)
    mask = np.array([zlib.crc32(bytes(n)) for n in range(3 * LONG_WORD + 3)], np.uint32)
    return step, shift, mask


def _moved(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after ``n`` more zero bytes."""
    shift = _tables()[1]
    out = shift[n, 0, register & 0xFF]
    for j in range(1, 4):
        out ^= shift[n, j, (register >> np.uint32(8 * j)) & 0xFF]
    return out


def feature_buckets(texts: list[bytes], n_buckets: int = N_BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all texts, one text after the other, and each text's number of words.

    A word's features stand together: the run of one, of two and of three words that begins with it.
    """
    step, _, mask = _tables()
    lines = [t.translate(_WORD_BYTES).split() for t in texts]
    n_words = np.fromiter(map(len, lines), np.int64, len(lines))
    line = b" ".join(w for words in lines for w in words)
    n = int(n_words.sum())
    if not n:
        return np.zeros(0, np.uint16), n_words
    data = np.frombuffer(line, np.uint8)
    ends = np.append(np.flatnonzero(data == 0x20), len(data))
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    # Registers of single words: the words still running, longest first, take one byte at a time.
    order = np.argsort(-np.minimum(size, LONG_WORD), kind="stable")
    running = np.searchsorted(-np.minimum(size, LONG_WORD)[order], -np.arange(1, LONG_WORD + 1), side="right")
    one = np.zeros(n, np.uint32)
    for k, upto in enumerate(running.tolist()):
        if not upto:
            break
        at = order[:upto]
        one[at] = step[(one[at] ^ data[starts[at] + k]) & 0xFF] ^ (one[at] >> 8)
    short = np.minimum(size, LONG_WORD)
    spaced = _moved(one, np.ones(n, np.int64)) ^ step[0x20]
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(n)  # words to the end of the text
    grams = np.empty((n, 3), np.uint32)
    grams[:, 0] = one ^ mask[short]
    two = _moved(spaced[:-1], short[1:]) ^ one[1:]
    two_size = short[:-1] + 1 + short[1:]
    grams[:-1, 1] = two ^ mask[two_size]
    grams[:-2, 2] = _moved(spaced[:-2], two_size[1:]) ^ two[1:] ^ mask[short[:-2] + 1 + two_size[1:]]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        for width in (1, 2, 3):
            for a in range(max(i - width + 1, 0), min(i + 1, n - width + 1)):
                grams[a, width - 1] = zlib.crc32(line[starts[a]:ends[a + width - 1]])
    return (grams[left[:, None] > np.arange(3)] % np.uint32(n_buckets)).astype(np.uint16), n_words


def _texts_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the texts of a column, NULL as empty, a bounded number of bytes at a time."""
    for batch in batches:
        values = batch.column(column).cast(pa.binary())
        for lo, hi in row_groups(values, 1 << 18):
            yield batch.slice(lo, hi - lo), [t or b"" for t in values.slice(lo, hi - lo).to_pylist()]


def bucket_counts(docs: DataFrame, text: str = "text", n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; each task counts its own, so a task sends ``n_buckets`` rows at most."""
    if not 0 < n_buckets <= 1 << 16:
        raise ValueError("n_buckets must be 1 to 65536")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for _, texts in _texts_of(batches, 0):
            total += np.bincount(feature_buckets(texts, n_buckets)[0], minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    found = docs.select(f"`{text}`").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(n_buckets, np.int64)
    for row in found:
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(p / q))`` of each bucket, with one added to every count of target and raw."""
    k = len(raw)
    all_raw, all_target = float(raw.sum() + k), float(target.sum() + k)
    return np.array([floor(1000 * log(float(t + 1) * all_raw / (float(s + 1) * all_target)))
                     for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def with_weights(docs: DataFrame, gains: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight`` (the sum of the gains of its features) for ``text``."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts_of(batches, len(rest)):
            flat, n_words = feature_buckets(texts, len(gains))
            n_features = np.maximum(n_words, 0) + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)
            total = np.concatenate(([0], np.cumsum(gains[flat])))
            until = np.cumsum(n_features)
            weights = total[until] - total[until - n_features]
            yield pa.RecordBatch.from_arrays([*part.columns[:len(rest)], pa.array(n_words), pa.array(n_features), pa.array(weights)],
                                             names=[*rest, "n_words", "n_features", "weight"])

    rows = docs.select(*[f"`{c}`" for c in rest], f"`{text}`")
    counts = [F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight")]
    return rows.mapInArrow(run, rows.select(*[f"`{c}`" for c in rest], *counts).schema)


def gumbel(id_text: Column, seed: int = SEED) -> Column:
    """Noise in thousandths: ``floor(-1000 ln(-ln u))``, u from the first 32 bits of SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u)))


def kth_highest(rows: DataFrame, k: int, keys: list[str], pivots: int = PIVOTS) -> tuple | None:
    """The k-th row of ``rows`` in ascending order of ``keys`` (integers, no NULLs, all rows different).

    Each round draws up to ``pivots`` random keys among the rows still in range and counts,
    exactly and in one pass, how many rows lie before and at each; the k-th row is then one
    of them or lies between two of them. None if there is no k-th row.
    """
    if k < 1:
        return None

    def before(a: tuple, strict: bool = True) -> Column:
        """Rows that come before key ``a``, or with it."""
        test = F.lit(not strict)
        for name, value in reversed(list(zip(keys, a, strict=True))):
            test = (F.col(name) < value) | ((F.col(name) == value) & test)
        return test

    left, turn = rows.select(*keys), 0
    while True:
        drawn = left.orderBy(F.xxhash64(*keys, F.lit(turn)), *keys).limit(pivots).collect()
        if not drawn:
            return None
        marks = sorted(tuple(r) for r in drawn)
        tests = [F.count_if(before(m, strict)).alias(f"{kind}{i}") for i, m in enumerate(marks) for kind, strict in (("lt", True), ("le", False))]
        counts = left.agg(*tests).first()
        low, high, passed = None, None, 0
        for i, mark in enumerate(marks):
            if counts[f"lt{i}"] < k <= counts[f"le{i}"]:
                return mark
            if counts[f"le{i}"] < k:
                low, passed = mark, counts[f"le{i}"]
            else:
                high = mark
                break
        if low is None and high is None:
            return None
        k, turn = k - passed, turn + 1
        if low is not None:
            left = left.where(~before(low, strict=False))
        if high is not None:
            left = left.where(before(high))
        if high is None and low is not None and len(marks) < pivots:
            return None


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with their place (1, 2, ...) in order of ``keys``: sorted by ranges, numbered task by task."""
    in_task = (1 << 33) - 1  # monotonically_increasing_id counts a task's rows in its lower 33 bits
    placed = (rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(in_task)).alias("_nth")))
    placed = written(placed, "sorted-winners")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(starts, F.col("_part") == F.col("_of")).select(
        *[f"`{c}`" for c in rows.columns], (F.col("_before") + F.col("_nth") + 1).alias(name))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 5, min_words: int = 20,
             n_buckets: int = N_BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``floor(percent * N / 100)`` of the N documents with at least ``min_words`` words are
    drawn; ``rank`` is 1 for the highest score and NULL for rows that are not drawn. Other
    columns of ``docs`` stay out of the result, so their names cannot clash. Empty tables
    of documents or of targets are allowed.
    """
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.monotonically_increasing_id().alias("place"), docs[f"`{text}`"].alias("text"))
    # Texts are hashed twice, once for the counts and once for the weights: no list of features is kept anywhere.
    goal = target.select(target[f"`{text}`"].alias("text"))
    gains = bucket_gains(bucket_counts(rows, "text", n_buckets), bucket_counts(goal, "text", n_buckets))
    score = F.col("weight") + gumbel(F.coalesce(F.col("id").cast("string"), F.lit("null")), seed)
    scored = written(with_weights(rows, gains).withColumn("score", score), "scored")
    # Ascending integer keys without NULLs: the highest score first, then the smaller id, NULL ids last.
    keyed = scored.select("*", (-F.col("score")).alias("_down"), F.col("id").isNull().cast("int").alias("_no_id"),
                          F.coalesce("id", F.lit(0)).alias("_id"))
    keys = ["_down", "_no_id", "_id", "place"]
    pool = keyed.where(F.col("n_words") >= min_words)
    last = kth_highest(pool, percent * pool.count() // 100, keys)
    drawn = F.lit(False)
    if last is not None:
        drawn = F.lit(True)
        for name, value in reversed(list(zip(keys, last, strict=True))):
            drawn = (F.col(name) < value) | ((F.col(name) == value) & drawn)
        drawn = drawn & (F.col("n_words") >= min_words)
    columns = ["id", "n_words", "n_features", "weight", "score"]
    winners = ranked(keyed.where(drawn).select(*columns, *keys), keys, "rank").select(*columns, "rank")
    return winners.unionByName(keyed.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
