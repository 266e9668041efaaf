"""Sliding-window rate limiting (RATE-1) as a distributed, streaming fold.

A call is admitted iff fewer than ``max_calls`` *admitted* calls of the same
key lie within the window before it (``now - t < window``); denied calls are
not remembered. Admission depends on earlier admissions, so within a key the
rule is a sequential fold and cannot be a window function.

Splitting hot keys: after a gap of at least one window since the key's
previous call, nothing is inside the window, so the fold restarts from an
empty state. A key's timeline therefore splits into independent *segments*.
Segment starts are found without sorting a key's calls:

1. bucket calls by ``floor(t / window)`` and aggregate ``(key, bucket) -> first,
   last`` (partial aggregation, so a hot key costs one row per task and bucket);
2. a bucket starts a segment iff the key's previous non-empty bucket ends at
   least one window before this bucket's first call (``lag`` over the key's
   buckets; only a bucket's first call can follow such a gap);
3. each bucket takes the latest segment start at or before it (a running
   ``last`` over the key's *buckets* — at most span/window rows, not calls).

4. a segment of more than ``chunk_calls`` calls is cut into chunks between buckets, which are
   folded at the same time, each from a guessed state (empty). Then every chunk whose
   guess differs from the end of the one before is folded again from that end, until its
   state meets the one it had in its earlier fold: from there on nothing changes. This is
   repeated until all guesses are right, usually after two or three rounds; traffic that
   is over the limit without a break needs up to one round for each chunk, as the rule
   itself is sequential then.

Calls then hash-partition by (key, segment, chunk), sort within partitions, and one
``mapInPandas`` pass folds each chunk from its right state keeping only the last
``max_calls`` admitted instants (O(max_calls) memory; Spark's sort spills). A hot key
spreads over many tasks, whether it pauses or not.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope.functions.dates import epoch_micros
from episcope.session import checkpoint_root, shared_dir

_KEY, _T, _B, _SEG, _CHUNK = "_rl_key", "_rl_t", "_rl_bucket", "_rl_seg", "_rl_chunk"
_START = "_rl_start"
CHUNK_CALLS = 100_000
BUCKETS_PER_WINDOW = 8  # a bucket is never cut, so a window of a dense key may still be
_CHUNK_ID = [_KEY, _SEG, _CHUNK]


def admit(times, window: deque, max_calls: int, window_us: int) -> list[bool]:
    """Decisions on calls in time order; ``window`` holds the admitted instants before them and is moved on."""
    flags = []
    for t in times:
        while window and t - window[0] >= window_us:
            window.popleft()
        flags.append(len(window) < max_calls)
        if flags[-1]:
            window.append(t)
    return flags


def _groups(columns: list[np.ndarray]) -> list[tuple[int, int]]:
    """Ranges of rows with equal values in all columns."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    cuts = [*np.flatnonzero(change).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _admit_batches(batches: Iterator[pd.DataFrame], max_calls: int, window_us: int) -> Iterator[pd.DataFrame]:
    """Fold chunk by chunk; a row without a time comes first in its chunk and brings the state to start from."""
    current, admitted = None, deque()
    for pdf in batches:
        ids = [pdf[c].to_numpy() for c in _CHUNK_ID]
        times, given = pdf[_T].tolist(), pdf[_START].tolist()
        out = np.zeros(len(pdf), dtype=bool)
        for lo, hi in _groups(ids):
            chunk = tuple(c[lo] for c in ids)
            if chunk != current:
                current, admitted = chunk, deque()
                if given[lo] is not None:
                    admitted.extend(int(t) for t in given[lo])
                    lo += 1
            out[lo:hi] = admit(map(int, times[lo:hi]), admitted, max_calls, window_us)
        calls = np.array([g is None for g in given], bool)
        yield pdf.assign(admitted=out)[calls].drop(columns=[_KEY, _T, _B, _SEG, _CHUNK, _START])


def segments(keyed: DataFrame, window_us: int, chunk_calls: int = CHUNK_CALLS) -> DataFrame:
    """``(key, bucket) -> segment, chunk`` where the segment is its start bucket.

    The first call of a bucket follows the last call of the previous non-empty
    bucket, so ``lag`` over the key's buckets gives its predecessor exactly. A chunk begins
    with the bucket that finds ``chunk_calls`` or more calls of the segment before it.
    """
    buckets = keyed.groupBy(_KEY, _B).agg(F.min(_T).alias("_first"), F.max(_T).alias("_last"), F.count(F.lit(1)).alias("_n"))
    by_bucket = Window.partitionBy(_KEY).orderBy(_B)
    prev_last = F.lag("_last").over(by_bucket)
    starts = buckets.select(
        _KEY, _B, "_n",
        F.when(prev_last.isNull() | (F.col("_first") - prev_last >= window_us), F.col(_B)).alias("_start"))
    running = by_bucket.rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.select(_KEY, _B, "_n", F.last("_start", ignorenulls=True).over(running).alias(_SEG))
    before = F.sum("_n").over(Window.partitionBy(_KEY, _SEG).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(_KEY, _B, _SEG, F.floor(F.coalesce(before, F.lit(0)) / chunk_calls).alias(_CHUNK))


def _fold_chunks(rows: DataFrame, max_calls: int, window_us: int) -> DataFrame:
    """``(chunk id, first, start, end)`` of chunks: the state that each was folded from and the one it ends in.

    ``rows`` are calls (``_T`` alone) and for each chunk one row without a time: ``start``, and
    of an earlier fold ``old_start`` and ``old_end`` (NULL without one).
    """
    ids = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in _CHUNK_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        now: tuple | None = None
        start, old_end, first, met = [], None, None, False
        state, old = deque(), None

        def ended() -> pa.RecordBatch:
            end = old_end if met else list(state)[-max_calls:]
            values = [*now, first, start, [int(t) for t in end]]
            return pa.RecordBatch.from_pylist([dict(zip([*_CHUNK_ID, "first", "start", "end"], values, strict=True))], schema=names)

        for batch in batches:
            if names is None:
                names = pa.schema([*[batch.schema.field(c) for c in _CHUNK_ID], ("first", pa.int64()), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64()))])
            table = batch.to_pydict()
            columns = [np.array(table[c], dtype=object) for c in _CHUNK_ID]
            for lo, hi in _groups(columns):
                chunk = tuple(c[lo] for c in columns)
                if chunk != now:
                    if now is not None:
                        yield ended()
                    now, start, old_end, first, met = chunk, table["start"][lo], table["old_end"][lo], None, False
                    state = deque(start)
                    old = None if old_end is None else deque(table["old_start"][lo])
                    lo += 1
                if lo < hi and first is None:
                    first = table[_T][lo]
                if met:
                    continue  # the rest of the chunk ends as it did before
                # The earlier fold runs alongside; in steps, as the two states are compared after each.
                for at in range(lo, hi, 256):
                    times = table[_T][at:min(at + 256, hi)]
                    admit(times, state, max_calls, window_us)
                    if old is not None:
                        admit(times, old, max_calls, window_us)
                        if state == old:
                            met = True
                            break
        if now is not None:
            yield ended()

    return rows.mapInArrow(run, f"{ids}, first long, start array<long>, end array<long>")


def _kept(df: DataFrame, name: str) -> DataFrame:
    checkpoint_root(df.sparkSession)
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunk_starts(calls: DataFrame, max_calls: int, window_us: int) -> DataFrame:
    """``(chunk id, start)``: the admitted instants before each chunk of ``calls`` (chunk id and time) that still count in it."""
    calls = _kept(calls.select(*_CHUNK_ID, _T), "dense-calls")
    empty = F.array().cast("array<bigint>")

    def folded(states: DataFrame, only: DataFrame | None = None) -> DataFrame:
        own = calls if only is None else calls.join(only.select(*[F.col(c).alias(f"of{c}") for c in _CHUNK_ID]),
                                                    [F.col(c).eqNullSafe(F.col(f"of{c}")) for c in _CHUNK_ID], "left_semi")
        none = F.lit(None).cast("array<bigint>")
        rows = own.select(*_CHUNK_ID, _T, *[none.alias(c) for c in ("start", "old_start", "old_end")]).unionByName(
            states.select(*_CHUNK_ID, F.lit(None).cast("bigint").alias(_T), "start", "old_start", "old_end"))
        return _fold_chunks(rows.repartition(*_CHUNK_ID).sortWithinPartitions(*_CHUNK_ID, F.col(_T).asc_nulls_first()), max_calls, window_us)

    guesses = calls.select(*_CHUNK_ID).distinct().select(
        *_CHUNK_ID, empty.alias("start"), F.lit(None).cast("array<bigint>").alias("old_start"), F.lit(None).cast("array<bigint>").alias("old_end"))
    runs = _kept(folded(guesses), "chunk-runs")
    earlier = Window.partitionBy(_KEY, _SEG).orderBy(_CHUNK)
    while True:
        # What counts in a chunk is what its first call still finds in its window.
        given = F.filter(F.coalesce(F.lag("end").over(earlier), empty), lambda t: F.col("first") - t < window_us)
        states = runs.withColumn("given", given)
        wrong = _kept(states.where("given <> start").select(
            *_CHUNK_ID, F.col("given").alias("start"), F.col("start").alias("old_start"), F.col("end").alias("old_end")), "wrong-guesses")
        if wrong.isEmpty():
            return runs.select(*_CHUNK_ID, "start")
        again = _kept(folded(wrong, wrong), "chunk-runs-again")
        marks = again.select(*[F.col(c).alias(f"of{c}") for c in _CHUNK_ID])
        runs = _kept(runs.join(marks, [F.col(c).eqNullSafe(F.col(f"of{c}")) for c in _CHUNK_ID], "left_anti").unionByName(again), "chunk-runs")


def rate_limit(calls: DataFrame, key: str, ts: str, seq: str, max_calls: int = 60,
               window_seconds: float = 60.0, num_partitions: int | None = None, chunk_calls: int = CHUNK_CALLS) -> DataFrame:
    """RATE-1: ``calls`` + boolean ``admitted`` per call.

    ``seq`` orders calls with the same timestamp. Times are compared in
    microseconds. Calls without a key share one budget; a call without a time lies in
    no window, is not counted and gets ``admitted`` NULL.
    """
    if max_calls < 1 or window_seconds <= 0 or chunk_calls < 1:
        raise ValueError("max_calls and chunk_calls must be >= 1 and window_seconds > 0")
    window_us = int(round(window_seconds * 1_000_000))
    bucket_us = max(window_us // BUCKETS_PER_WINDOW, 1)
    t_us = epoch_micros(calls.schema, ts)
    own = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # never NULL
    placed = calls.select("*", own.alias(_KEY), t_us.alias(_T))
    keyed = (placed.where(F.col(_T).isNotNull())
             .withColumn(_B, F.expr(f"{_T} div {bucket_us}")))  # exact integer buckets
    # One row per (key, bucket), written out: AQE broadcasts it when it is small, and splits a hot key when not.
    buckets = _kept(segments(keyed, window_us, chunk_calls), "call-buckets")
    tagged = keyed.join(buckets, [_KEY, _B])
    dense = buckets.where(F.col(_CHUNK) > 0).select(F.col(_KEY).alias("_of_key"), F.col(_SEG).alias("_of_seg")).distinct()
    rows = tagged.withColumn(_START, F.lit(None).cast("array<bigint>"))
    if not dense.isEmpty():
        of_dense = (F.col(_KEY) == F.col("_of_key")) & (F.col(_SEG) == F.col("_of_seg"))
        starts = chunk_starts(tagged.join(dense, of_dense, "left_semi"), max_calls, window_us)
        rows = rows.unionByName(starts.withColumnRenamed("start", _START), allowMissingColumns=True)
    parts = rows.repartition(num_partitions, *_CHUNK_ID) if num_partitions else rows.repartition(*_CHUNK_ID)
    ordered = parts.sortWithinPartitions(*_CHUNK_ID, F.col(_T).asc_nulls_first(), seq)
    out_schema = T.StructType(calls.schema.fields + [T.StructField("admitted", T.BooleanType())])
    # Rows pass through the fold, so no join back to the input is needed.
    judged = ordered.mapInPandas(lambda it: _admit_batches(it, max_calls, window_us), out_schema)
    untimed = placed.where(F.col(_T).isNull()).select(*calls.columns, F.lit(None).cast("boolean").alias("admitted"))
    return judged.unionByName(untimed)
