"""Streaming twins: stream equals batch, state stays bounded, and late rows past the watermark drop."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from episcope import schema as S
from episcope.operators import metrics as M
from episcope.operators import ops as OPS
from episcope.operators import ratelimit as RL
from episcope.operators import series as TS
from episcope.sources import audit as SA
from episcope.sources import versions
from episcope.streaming import jobs as ST

SCHEMA = "dt_notific DATE, obito INT, internou_uti INT, vacinado INT"


def _land(spark, path, days):
    spark.createDataFrame([(d, 0, 0, 0) for d in days], SCHEMA).write.mode("append").parquet(path)


def test_stream_daily_counts_and_late_rows(spark, tmp_path):
    base = tmp_path / uuid.uuid4().hex
    src, log, ckpt = str(base / "in"), str(base / "log"), str(base / "ckpt")
    jan = [dt.date(2024, 1, d) for d in range(1, 21)]
    _land(spark, src, jan + jan[:5])
    schema = spark.read.parquet(src).schema
    ST.stream_daily_cases(spark, src, schema, log, ckpt)
    first = {r.date: r.cases for r in ST.read_upsert_log(spark, log, ["date"]).collect()}
    batch = {r.date: r.cases for r in TS.daily_cases(M.daily_fact(spark.read.parquet(src)), 365).collect()}
    assert first == batch  # replay in one pass equals the batch twin

    # Watermark is now 2024-01-13: a row for 01-05 is late and dropped, 01-15 still counts.
    _land(spark, src, [dt.date(2024, 1, 5), dt.date(2024, 1, 15)])
    ST.stream_daily_cases(spark, src, schema, log, ckpt)
    second = {r.date: r.cases for r in ST.read_upsert_log(spark, log, ["date"]).collect()}
    assert second["2024-01-05"] == first["2024-01-05"] == 2
    assert second["2024-01-15"] == first["2024-01-15"] + 1


def _dirs(tmp_path):
    base = tmp_path / uuid.uuid4().hex
    return str(base / "in"), str(base / "log"), str(base / "ckpt")


def _audit(spark, path, events):
    rows = [(str(k), t, kind, execution, data) for k, (t, kind, execution, data) in enumerate(events)]
    SA.append_audit(spark.createDataFrame(rows, S.AUDIT_SCHEMA).coalesce(1), path)


def test_execution_state_is_dropped_behind_the_watermark(spark, tmp_path):
    src, log, ckpt = _dirs(tmp_path)
    days = [[(f"2024-01-{d:02d}T{h:02d}:00:00", kind, f"e{d}", '{"valid": false}') for h, kind in enumerate(["tool_call", "validation", "error"])]
            for d in (1, 2, 20, 25)]
    states = []
    for k, events in enumerate(days):
        # Executions go on in a later batch as long as they are younger than the watermark.
        more = [(f"2024-01-{d:02d}T05:00:00", "tool_call", f"e{d}", None) for d in (2, 20)[k - 2:k - 1] if k in (2, 3) and d != 2]
        _audit(spark, src, events + more + [(f"2024-01-{2 + 18 * (k > 1):02d}T04:00:00", "error", None, None)])
        q = ST.stream_execution_summary(spark, src, log, ckpt, watermark="3 days")
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted(map(tuple, ST.read_execution_summary(spark, log).collect()))
    want = sorted(map(tuple, OPS.execution_summary(OPS.flatten_events(SA.read_audit_log(spark, src))).collect()))
    assert got == want and len(got) == 4
    # e1 and e2 are gone once e20 has moved the watermark past them.
    assert states[1] == 2 * states[0] and states[-1] < states[1] + states[0]


def test_executions_longer_than_a_span_and_late_events(spark, tmp_path):
    src, log, ckpt = _dirs(tmp_path)
    # Spans of a day: an execution of four days, in every batch; the last batch has an event that is long over.
    kinds = ["tool_call", "validation", "error", "decision"]
    batches = [[(f"2024-01-{d:02d}T{h:02d}:00:00", kinds[h % 4], e, '{"valid": true}') for d in range(1, 5) for h in range(k, 24, 3) for e in ("long", f"e{d}")]
               for k in range(3)]
    batches.append([("2024-03-01T00:00:00", "error", "new", None)])
    batches.append([("2024-01-01T12:30:00", "error", "long", None), ("2024-03-01T01:00:00", "tool_call", "new", None)])
    for events in batches:
        _audit(spark, src, events)
        q = ST.stream_execution_summary(spark, src, log, ckpt, watermark="10 days")
        ST.compact_upsert_log(spark, log, ST.EXECUTION_KEYS)
    got = sorted(map(tuple, ST.read_execution_summary(spark, log).collect()))
    events = OPS.flatten_events(SA.read_audit_log(spark, src)).where(~((F.col("execution_id") == "long") & (F.minute("ts") == 30)))
    assert got == sorted(map(tuple, OPS.execution_summary(events).collect())) and len(got) == 6
    # Spark's own aggregation, without Python; the state holds the new execution alone.
    state = q.lastProgress["stateOperators"][0]
    assert state["operatorName"] == "stateStoreSave" and state["numRowsTotal"] == 1


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    write = ST.upsert_log(log)
    for batch in range(6):
        write(spark.createDataFrame([(k, batch * 10 + k) for k in range(batch, batch + 3)], "k LONG, v LONG"), batch)
        if batch == 1:
            write(spark.createDataFrame([(9, 9)], "k LONG, v LONG"), batch)  # a replay replaces the batch
    with pytest.raises(FileNotFoundError):
        ST.read_upsert_log(spark, str(tmp_path / "none"), ["k"])
    want = {r.k: r.v for r in ST.read_upsert_log(spark, log, ["k"]).collect()}
    assert want == {0: 0, 1: 1, 2: 22, 3: 33, 4: 44, 5: 55, 6: 56, 7: 57, 9: 9}
    # A crash before the marker: a snapshot folder that nothing names.
    spark.range(1).selectExpr("id AS k", "-1L AS v").write.parquet(f"{log}/snapshots/upto=5-dead")
    assert ST.compact_upsert_log(spark, log, ["k"]) == 5 and ST.compact_upsert_log(spark, log, ["k"]) is None
    assert versions.names(spark, f"{log}/tail") == []  # reading costs the snapshot only
    assert {r.k: r.v for r in ST.read_upsert_log(spark, log, ["k"]).collect()} == want
    write(spark.createDataFrame([(9, 90)], "k LONG, v LONG"), 6)
    assert {r.k: r.v for r in ST.read_upsert_log(spark, log, ["k"]).collect()} == want | {9: 90}
    assert ST.compact_upsert_log(spark, log, ["k"]) == 6
    assert {r.k: r.v for r in ST.read_upsert_log(spark, log, ["k"]).collect()} == want | {9: 90}


CALLS = "call_id LONG, client STRING, at TIMESTAMP"


def test_rate_limit_of_calls_out_of_order(spark, tmp_path):
    src, log, ckpt = _dirs(tmp_path)
    r = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    calls = [(k, "hot" if k % 3 == 0 else f"c{k % 7}" if k % 11 else None, start + dt.timedelta(seconds=r.randrange(0, 4000), microseconds=r.randrange(10**6)))
             for k in range(900)]
    calls += [(900, "late", None)]
    # Up to ten minutes out of order, over several batches.
    calls.sort(key=lambda c: (c[2] or start) + dt.timedelta(seconds=r.randrange(0, 600)))
    for lo in range(0, len(calls), 190):
        spark.createDataFrame(calls[lo:lo + 190], CALLS).coalesce(2).write.mode("append").parquet(src)
        q = ST.stream_rate_limit(spark, src, spark.read.parquet(src).schema, "client", "at", "call_id", log, ckpt, 3, 60.0,
                                 watermark="20 minutes", max_files_per_trigger=1)
    want = {x.call_id: x.admitted for x in RL.rate_limit(spark.createDataFrame(calls, CALLS), "client", "at", "call_id", 3, 60.0).collect()}
    got = {x.call_id: x.admitted for x in ST.read_upsert_log(spark, log, ["client", "call_id"]).collect()}
    assert got == {k: v for k, v in want.items() if k != 900}
    assert 0 < sum(want.values() if None not in want.values() else [v for v in want.values() if v]) < 900
    # State holds buckets of the last twenty minutes, not of the whole hour, and the caller's settings stay.
    rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert rows < 9 * 2 * (20 + 2) * 2
    assert "RocksDB" not in (spark.conf.get(ST.PROVIDER, "") or "")


def test_stream_of_mixed_layouts(spark, tmp_path):
    src, out, ckpt = _dirs(tmp_path)
    import os
    os.makedirs(src)
    names = list(S.RAW_COLUMNS)
    for k, columns in enumerate([names, ["OUTRA", *names[::-1]], sorted(names)]):
        row = {"DT_NOTIFIC": f"2024-01-0{k + 1}", "SG_UF": f"S{k}", "EVOLUCAO": "2"}
        with open(f"{src}/{k}.csv", "w", encoding="latin-1") as f:
            f.write(";".join(columns) + "\n" + ";".join(row.get(c, "1") for c in columns) + "\n")
        if k:
            ST.stream_ingest(spark, src, out, ckpt, max_files_per_trigger=1)
    got = sorted((str(r.dt_notific), r.sg_uf, r.obito) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01", "S0", 1), ("2024-01-02", "S1", 1), ("2024-01-03", "S2", 1)]


def test_calls_far_apart_share_state_entries(spark, tmp_path):
    src, log, ckpt = _dirs(tmp_path)
    start = dt.datetime(2024, 1, 1)
    calls = [(2 * k + j, "a", start + dt.timedelta(minutes=k, seconds=j)) for k in range(150) for j in range(2)]
    for half in range(2):
        spark.createDataFrame([c for c in calls if c[0] // 2 % 2 == half], CALLS).coalesce(1).write.mode("append").parquet(src)
        q = ST.stream_rate_limit(spark, src, spark.read.parquet(src).schema, "client", "at", "call_id", log, ckpt, 1, 30.0, watermark="1 day")
    assert {r.call_id: r.admitted for r in ST.read_upsert_log(spark, log, ["client", "call_id"]).collect()} == {c[0]: c[0] % 2 == 0 for c in calls}
    # 300 windows hold no entry, nor a timer, each.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 10


class _State:
    """A key's state and timers, as the state API gives them to a processor."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


@pytest.mark.parametrize(("stretch", "held", "most", "window_us"), [(4, 7, 3, 60_000_000), (1, 1, 1, 7_000_000), (50, 1000, 5, 600_000_000), (3, 100, 40, 90_000_000)])
def test_rate_limit_state_of_a_hot_key(stretch, held, most, window_us):
    from collections import deque

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    r = random.Random(stretch)
    calls = [(r.randrange(0, 3000) * 1_000_000 + r.choice([0, 1]), k, str(k)) for k in range(500)]
    calls.sort(key=lambda c: c[0] + r.randrange(0, 300_000_000))  # at most five minutes out of order
    calls.append((9_000_000_000, 500, "500"))
    state, got, seen, watermark = _State(), {}, [], 0
    while calls:
        n = r.choice([1, 2, 30, 60])
        batch, calls = calls[:n], calls[n:]
        seen += batch
        p = ST.RateLimitProcessor(most, window_us, stretch, held)
        p.init(state)
        parts = [pd.DataFrame(batch[lo:lo + 20], columns=["time_us", "seq", "row"]) for lo in range(0, len(batch), 20)]
        for out in p.handleInputRows(("k",), iter(parts), TimerValues(0, watermark)):
            got |= dict(zip(out["row"], out["admitted"].tolist(), strict=True))
        watermark = max(c[0] for c in seen) // 1000 - 300_000
        for timer in [t for t in state.timers if t <= watermark]:
            list(p.handleExpiredTimer(("k",), TimerValues(0, watermark), ExpiredTimerInfo(timer)))
            state.timers.remove(timer)
        ordered = sorted(seen)
        assert got == dict(zip([c[2] for c in ordered], RL.admit([c[0] for c in ordered], deque(), most, window_us), strict=True))
        settled, firsts, numbers, timer = state.value
        kept = [(c[0], c[1]) for x in numbers for c in p._calls(x)]
        assert {(x,) for x in numbers} == set(state.map) and state.timers == {timer} and kept == sorted(kept)
        assert firsts == [p._calls(x)[0][0] for x in numbers] and len(settled) <= most
        assert kept == [c[:2] for c in ordered][-len(kept):] and kept[0][0] >= watermark * 1000 - window_us
    p.handleExpiredTimer(("k",), TimerValues(0, 9_000_000 + 1), ExpiredTimerInfo(0))
    p.handleExpiredTimer(("k",), TimerValues(0, 10_000_000), ExpiredTimerInfo(0))
    assert state.value is None and not state.map  # a window later nothing is left
