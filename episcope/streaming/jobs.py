"""Structured Streaming twins of the batch operators (STR-1..4).

Each job reads landed files (CSV, Parquet, JSON lines) as a stream, applies
the *same* operator functions as the batch path, and runs with a checkpoint in
the shared folder, so a restarted job resumes where it stopped.

Sinks: keyed results run in ``update`` mode and write each micro-batch's
changed rows to an *upsert log* (``foreachBatch``, a folder for each batch, so a
replayed micro-batch writes the same folder again). Reading folds the log to the
latest row per key; ``compact_upsert_log`` folds it for good.

Late data: daily counts keep a 7-day event-time watermark; a row older than
the watermark when it arrives is dropped (the source has no late-data rule).
The keyed jobs bound their state by event time as well; see their docstrings.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import repeat
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from episcope import schema as S
from episcope.functions.dates import epoch_micros
from episcope.operators.clean import clean_cases
from episcope.operators.ops import execution_counts, execution_record, flatten_events
from episcope.operators.ratelimit import admit
from episcope.sources import versions
from episcope.sources.audit import audit_stream
from episcope.sources.cases import cases_of_files

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
WATERMARK = "7 days"
FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
_EVENT_TIME = "event_time"


def _run(query_writer, available_now: bool = True):
    """Start a stream; with ``available_now`` process what has landed, then stop."""
    writer = query_writer.trigger(availableNow=True) if available_now else query_writer
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def _session_with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(PROVIDER, ROCKSDB)
    return own


# ------------------------------------------------------------------ upsert log

def upsert_log(path: str):
    """``foreachBatch`` function: a micro-batch's rows in a folder named by its id, replaced if the batch runs again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/tail/_batch={batch_id}")
    return write


def _log_state(spark: SparkSession, path: str) -> tuple[int, str | None, list[int]]:
    """The newest snapshot's last batch (-1 for none) and folder, and the batches after it."""
    root = path.rstrip("/")
    snapshots = [int(m[1]) for n in versions.names(spark, f"{root}/snapshots") if (m := re.fullmatch(r"(\d+)\.done", n))]
    upto = max(snapshots, default=-1)
    batches = [int(m[1]) for n in versions.names(spark, f"{root}/tail") if (m := re.fullmatch(r"_batch=(\d+)", n))]
    folder = versions.read_small(spark, f"{root}/snapshots/{upto}.done") if snapshots else None
    return upto, folder, sorted(b for b in batches if b > upto)


def read_upsert_log(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Fold an upsert log to the newest row per key: the newest snapshot and the batches after it (partial aggregation, no sort)."""
    upto, snapshot, batches = _log_state(spark, path)
    parts = [spark.read.parquet(snapshot).withColumn("_batch", F.lit(upto).cast("bigint"))] if snapshot else []
    if batches:
        tail = f"{path.rstrip('/')}/tail"
        folders = [f"{tail}/_batch={b}" for b in batches]
        parts.append(spark.read.option("basePath", tail).option("mergeSchema", True).parquet(*folders).withColumn("_batch", F.col("_batch").cast("bigint")))
    if not parts:
        raise FileNotFoundError(f"no batch was written to {path}")
    log = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    values = [c for c in log.columns if c not in (*keys, "_batch")]
    newest = F.max_by(F.struct(*values), F.col("_batch")).alias("v")
    return log.groupBy(*keys).agg(newest).select(*keys, "v.*")


def compact_upsert_log(spark: SparkSession, path: str, keys: Sequence[str]) -> int | None:
    """Fold the log's newest snapshot and tail into a new snapshot, so that reading does not grow with finished batches.

    The snapshot counts only once its small ``<last batch>.done`` file names it: a crash
    before that leaves the old state in force, and the tail stays until a later run of
    this function finds it covered. Returns the last batch covered, None if nothing was new.
    Call it between batches, or on a log whose last batch is finished.
    """
    root = path.rstrip("/")
    upto, _, batches = _log_state(spark, path)
    covered = [int(m[1]) for n in versions.names(spark, f"{root}/tail") if (m := re.fullmatch(r"_batch=(\d+)", n)) and int(m[1]) <= upto]
    versions.remove(spark, [f"{root}/tail/_batch={b}" for b in covered])
    if not batches:
        return None
    folder = f"{root}/snapshots/upto={batches[-1]}-{versions.fresh()}"
    read_upsert_log(spark, path, keys).write.parquet(folder)
    versions.create(spark, f"{root}/snapshots/{batches[-1]}.done", folder)
    return batches[-1]


# ------------------------------------------------------------------ STR-1

def stream_ingest(spark: SparkSession, raw_dir: str, out_dir: str, checkpoint: str,
                  year: int | None = 2024, available_now: bool = True,
                  max_files_per_trigger: int | None = None):
    """STR-1: new raw CSV files → CLEAN → curated Parquet under ``batch=<id>/year=<year>``.

    The stream is one of files, not of rows (their names; no content is read): each
    micro-batch reads its files by their own headers, so layouts may change from file to
    file. A batch that runs again replaces its folder. ``max_files_per_trigger`` bounds a
    batch. A file without a required column stops the stream, as it stops a batch load.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def load(files: DataFrame, batch_id: int) -> None:
        curated = clean_cases(cases_of_files(files), year=year).withColumn("year", F.year("dt_notific"))
        curated.write.mode("overwrite").partitionBy("year").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")

    w = reader.load(raw_dir).select("path").writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
    return _run(w, available_now)


# ------------------------------------------------------------------ STR-2

def daily_counts_stream(cases: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Tumbling one-day counts with an event-time watermark (dates as timestamps)."""
    ts = F.col("dt_notific").cast("timestamp")
    return (cases.withColumn("_t", ts).withWatermark("_t", watermark)
            .groupBy(F.window("_t", "1 day")).agg(F.count(F.lit(1)).alias("cases"))
            .select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "cases"))


def stream_daily_cases(spark: SparkSession, curated_dir: str, schema: T.StructType, log_dir: str,
                       checkpoint: str, available_now: bool = True):
    """STR-2: daily counts over arriving curated files, written to an upsert log."""
    stream = spark.readStream.schema(schema).parquet(curated_dir)
    w = (daily_counts_stream(stream).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint).foreachBatch(upsert_log(log_dir)))
    return _run(w, available_now)


# ------------------------------------------------------------------ STR-3

_COUNTS = ("first_us", "last_us", "total_tool_calls", "total_validations", "failed_validations", "total_errors")


EXECUTION_KEYS = ("execution_id", "span")
SPANS = 10


def _summed() -> list[Column]:
    first, last, *counts = _COUNTS
    return [F.min(first).alias(first), F.max(last).alias(last), *[F.sum(c).alias(c) for c in counts]]


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{interval}') AS us").first().us


def stream_execution_summary(spark: SparkSession, audit_dir: str, log_dir: str, checkpoint: str,
                             available_now: bool = True, watermark: str = WATERMARK, max_files_per_trigger: int | None = None):
    """STR-3: OPS-5 kept up to date over an arriving audit log.

    Events are counted by execution and span of event time (a ``SPANS``-th of the watermark), so
    that Spark's own aggregation combines them before the shuffle and drops the state of a span
    that the watermark has passed: the log, keyed by ``EXECUTION_KEYS``, holds it. An event whose
    span is over is dropped. Events without an execution id or a time belong to
    no execution. Read the result with ``read_execution_summary``.
    """
    own = _session_with_rocksdb(spark)
    span = f"{max(_micros(own, watermark) // SPANS, 1_000_000)} microseconds"
    events = flatten_events(audit_stream(own, audit_dir, max_files_per_trigger)).where(F.col("execution_id").isNotNull() & F.col("ts").isNotNull())
    counted = execution_counts(events.withColumn(_EVENT_TIME, F.col("ts")).withWatermark(_EVENT_TIME, watermark), keep=[_EVENT_TIME])
    summary = counted.groupBy("execution_id", F.window(_EVENT_TIME, span).alias("_w")).agg(*_summed()).select(
        "execution_id", F.col("_w.start").alias("span"), *_COUNTS)
    w = summary.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert_log(log_dir))
    return _run(w, available_now)


def read_execution_summary(spark: SparkSession, log_dir: str) -> DataFrame:
    """The execution summaries of STR-3's log: the newest counts of each span, added up."""
    return execution_record(read_upsert_log(spark, log_dir, EXECUTION_KEYS).groupBy("execution_id").agg(*_summed()))


# ------------------------------------------------------------------ STR-4

# Names without an underscore before them: the state API renames such columns.
_TIME, _SEQ, _ROW = "time_us", "seq", "row"
STRETCH_CALLS = 5_000  # calls of a state entry; calls of one instant are never parted
HELD_CALLS = 100_000  # calls of a key that a task holds at a time

_Call = tuple  # time, seq, row, admitted (None: not judged yet)


def _call_order(call: _Call) -> tuple:
    none = call[1] is None or call[1] != call[1]
    return call[0], none, 0 if none else call[1]


class RateLimitProcessor(StatefulProcessor):
    """Admission of a key's calls in event-time order, whatever order they arrive in.

    Calls younger than the watermark are buffered in stretches of up to ``stretch_calls``
    calls in time order, with the decision last given to them: a key costs a few state calls
    for each batch it is in, however far apart its calls lie, and of a hot key only the
    stretches in question are read. Calls that arrive put decisions after them in question:
    those are made again until they are what they were before, and new or changed ones are
    emitted. A timer stands at the end of the first call's window. When the watermark passes
    it, nothing can precede the calls older than the watermark any more: they are dropped,
    and at most ``max_calls`` admitted instants of the window before it are kept. Once these
    are a window old they are dropped as well, if the key has no younger calls. Spark drops
    calls that are older than the watermark when they arrive.
    """

    def __init__(self, max_calls: int, window_us: int, stretch_calls: int = STRETCH_CALLS, held_calls: int = HELD_CALLS):
        self.max_calls, self.window_us, self.stretch_calls, self.held_calls = max_calls, window_us, stretch_calls, held_calls

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ``firsts``: the time of each stretch's first call, ``numbers``: its entry in ``stretches``.
        self.known = handle.getValueState("known", "settled ARRAY<LONG>, firsts ARRAY<LONG>, numbers ARRAY<LONG>, timer LONG")
        self.stretches = handle.getMapState("stretches", "number LONG", "calls BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer = self._open()
        touched, new = set(), []
        for part in rows:
            new.extend(zip(*(part[c].tolist() for c in (_TIME, _SEQ, _ROW)), repeat(None)))
            if len(new) >= self.held_calls:
                touched |= self._place(new)
                new = []
        touched |= self._place(new)
        yield from self._decided(touched)
        due = self._end_ms(self.firsts[0])
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.known.update((self.settled, self.firsts, self.numbers, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open()
        over_us = timerValues.getCurrentWatermarkInMs() * 1000
        window = deque(self.settled, self.max_calls)
        while self.firsts and self.firsts[0] < over_us:
            calls = self._calls(self.numbers[0])
            n = bisect_left(calls, over_us, key=itemgetter(0))
            window.extend(c[0] for c in calls[:n] if c[3])
            if n < len(calls):
                self._store(self.numbers[0], calls[n:])
                self.firsts[0] = calls[n][0]
            else:
                self.stretches.removeKey((self.numbers[0],))
                del self.firsts[0], self.numbers[0]
        settled = [t for t in window if over_us - t < self.window_us]
        if self.firsts or settled:
            timer = self._end_ms(self.firsts[0] if self.firsts else settled[-1] + self.window_us)
            self.handle.registerTimer(timer)
            self.known.update((settled, self.firsts, self.numbers, timer))
        else:
            self.known.clear()
        return iter(())

    def _open(self) -> int | None:
        """Read what is known of the key; returns its timer."""
        settled, firsts, numbers, timer = self.known.get() or ([], [], [], None)
        self.settled, self.firsts, self.numbers = list(settled), list(firsts), list(numbers)
        self.unwritten: dict[int, list[_Call]] = {}
        return timer

    def _place(self, new: list[_Call]) -> set[int]:
        """Add calls to their stretches, which are cut when they become too long; returns the stretches' numbers."""
        new.sort(key=_call_order)
        touched = set()
        at = len(self.firsts) - 1
        while new:  # from the end, so that stretches which are cut do not move those still to come
            if at < 0:
                number, known, own, new = 0, [], new, []
            else:
                start = bisect_left(new, self.firsts[at], key=itemgetter(0)) if at else 0
                own, new = new[start:], new[:start]
                if not own:
                    at -= 1
                    continue
                number, known = self.numbers[at], self._calls(self.numbers[at])
            calls = sorted(known + own, key=_call_order)
            cuts, size = [0], -(-len(calls) // -(-len(calls) // self.stretch_calls))
            while cuts[-1] + size < len(calls):
                cuts.append(bisect_right(calls, calls[cuts[-1] + size - 1][0], key=itemgetter(0)))
            pieces = [calls[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], len(calls)], strict=True) if lo < hi]
            free = max(self.numbers, default=0) + 1
            numbers = [number, *range(free, free + len(pieces) - 1)]
            lo = max(at, 0)
            self.firsts[lo:lo + 1], self.numbers[lo:lo + 1] = [p[0][0] for p in pieces], numbers
            self.unwritten |= dict(zip(numbers, pieces, strict=True))
            touched |= set(numbers)
            at -= 1
            if sum(map(len, self.unwritten.values())) >= self.held_calls:
                self._write()
        return touched

    def _decided(self, touched: set[int]) -> Iterator[pd.DataFrame]:
        """Judge the touched stretches, and those after them as long as decisions change; yield decisions that are new or differ."""
        was = now = None
        for at, number in enumerate(self.numbers):
            if number not in touched and was == now:  # it begins as it did before
                was = now = None
                continue
            calls = self._calls(number)
            if now is None:
                now = self._before(at)
                was = now.copy()
            flags = admit([c[0] for c in calls], deque(now), self.max_calls, self.window_us)
            was.extend(c[0] for c in calls if c[3])
            now.extend(c[0] for c, f in zip(calls, flags, strict=True) if f)
            changed = [(c[2], f) for c, f in zip(calls, flags, strict=True) if c[3] is not f]
            if changed or number in self.unwritten:
                self.unwritten.pop(number, None)
                self._store(number, [(*c[:3], f) for c, f in zip(calls, flags, strict=True)])
            if changed:
                yield pd.DataFrame(changed, columns=[_ROW, "admitted"])

    def _before(self, at: int) -> deque:
        """The last admitted instants before a stretch."""
        found: list[int] = []
        for number in reversed(self.numbers[:at]):
            found = [c[0] for c in self._calls(number) if c[3]] + found
            if len(found) >= self.max_calls:
                break
        else:
            found = self.settled + found
        return deque(found, self.max_calls)

    def _end_ms(self, time_us: int) -> int:
        """The first millisecond after the window, of those that follow one another from 1970 on, that ``time_us`` lies in."""
        return -(-(time_us // self.window_us + 1) * self.window_us // 1000)

    def _calls(self, number: int) -> list[_Call]:
        return self.unwritten[number] if number in self.unwritten else pickle.loads(self.stretches.getValue((number,))[0])

    def _store(self, number: int, calls: list[_Call]) -> None:
        self.stretches.updateValue((number,), (pickle.dumps(calls, protocol=5),))

    def _write(self) -> None:
        for number, calls in self.unwritten.items():
            self._store(number, calls)
        self.unwritten = {}

    def close(self) -> None:
        pass


def stream_rate_limit(spark: SparkSession, calls_dir: str, schema: T.StructType, key: str, ts: str,
                      seq: str, log_dir: str, checkpoint: str, max_calls: int = 60,
                      window_seconds: float = 60.0, available_now: bool = True,
                      watermark: str = "1 hour", max_files_per_trigger: int | None = None):
    """STR-4: RATE-1 per key over arriving call files, equal to the batch rule for calls at most ``watermark`` out of order.

    Decisions go to an upsert log keyed by ``key`` and ``seq``, which must tell a key's calls apart:
    one that a later arrival overturns is written again. State is bounded by the watermark:
    the calls of that span and one window, and ``max_calls`` instants a key.
    ``max_files_per_trigger`` bounds a batch. Calls without a time are left out.
    """
    own = _session_with_rocksdb(spark)
    window_us = int(window_seconds * 1_000_000)
    reader = own.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    at = epoch_micros(schema, ts)
    timed = reader.parquet(calls_dir).where(F.col(ts).isNotNull()).select(
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("limited"), at.alias(_TIME), F.col(seq).alias(_SEQ),
        F.to_json(F.struct(*[F.col(c) for c in schema.names])).alias(_ROW), F.timestamp_micros(at).alias(_EVENT_TIME)).withWatermark(_EVENT_TIME, watermark)
    judged = timed.groupBy("limited").transformWithStateInPandas(
        statefulProcessor=RateLimitProcessor(max_calls, window_us), outputStructType=f"{_ROW} STRING, admitted BOOLEAN",
        outputMode="Update", timeMode="EventTime")
    whole = judged.select(F.from_json(_ROW, schema).alias("call"), "admitted").select("call.*", "admitted")
    w = whole.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert_log(log_dir))
    return _run(w, available_now)
