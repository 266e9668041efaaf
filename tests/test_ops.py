"""Job ledger fold, audit summaries and the rate limiter."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from episcope.operators import ops as OPS
from episcope.operators.ratelimit import rate_limit, segments

T0 = dt.datetime(2024, 1, 1)


def _changes(spark, rows):
    return spark.createDataFrame(
        [(j, i, T0 + dt.timedelta(seconds=s), st, ex, rp, du, er, pl) for (j, i, s, st, ex, rp, du, er, pl) in rows],
        "job_id STRING, event_id BIGINT, ts TIMESTAMP, status STRING, execution_id STRING, "
        "report_path STRING, duration_ms DOUBLE, error STRING, payload STRING")


def test_fold_job_state(spark):
    ch = _changes(spark, [
        ("a", 1, 0, "queued", None, None, None, None, '{"k": 1}'),
        ("a", 2, 5, "running", "exec-a", None, None, None, None),
        ("a", 3, 9, "failed", None, None, None, "boom", None),
        ("a", 4, 12, "succeeded", None, "r.md", 1.5, None, None),
        ("b", 5, 1, "queued", None, None, None, None, '{"k": 2}'),
        ("b", 6, 3, "failed", None, None, None, "bad", None),
    ])
    jobs = {r.job_id: r for r in OPS.latest_job_state(ch).collect()}
    a, b = jobs["a"], jobs["b"]
    assert (a.status, a.execution_id, a.report_path, a.error, a.payload) == ("succeeded", "exec-a", "r.md", None, '{"k": 1}')
    assert (b.status, b.error) == ("failed", "bad")
    counts = {r.status: (r.jobs, r.total_jobs) for r in OPS.status_counts(OPS.latest_job_state(ch)).collect()}
    assert counts == {"queued": (0, 2), "running": (0, 2), "succeeded": (1, 2), "failed": (1, 2)}
    retry = OPS.retry_plan(OPS.latest_job_state(ch)).collect()
    assert [(r.job_id, r.retry_payload) for r in retry] == [("b", '{"k":2}')]
    assert OPS.backlog_head(OPS.latest_job_state(ch)).count() == 0
    assert [r.job_id for r in OPS.recent_jobs(OPS.latest_job_state(ch), 500).collect()] == ["b", "a"]


def test_fold_keeps_what_a_success_sets(spark):
    rows = [("a", 1, 0, "queued", None, None, None), ("a", 2, 5, "succeeded", 1, '["CPF"]', '{"n": "1"}'),
            ("a", 3, 9, "succeeded", 0, "[]", '{"n": "2"}'), ("a", 4, 12, "failed", None, None, None),
            ("b", 5, 1, "succeeded", 1, '["RG", "CPF"]', '{"n": "3"}'), ("c", 6, 2, "queued", None, None, None)]
    ch = spark.createDataFrame(
        [(j, i, T0 + dt.timedelta(seconds=s), st, None, None, None, None, "{}", d, t, m) for j, i, s, st, d, t, m in rows],
        "job_id STRING, event_id BIGINT, ts TIMESTAMP, status STRING, execution_id STRING, report_path STRING, "
        "duration_ms DOUBLE, error STRING, payload STRING, pii_detected INT, pii_types STRING, summary STRING")
    out = {r.job_id: r for r in OPS.decode_json_columns(OPS.latest_job_state(ch)).collect()}
    assert {j: (r.status, r.pii_detected, r.pii_types, r.summary) for j, r in out.items()} == {
        "a": ("failed", 0, [], {"n": "2"}), "b": ("succeeded", 1, ["RG", "CPF"], {"n": "3"}), "c": ("queued", None, [], None)}
    # A change log written without the columns.
    old = OPS.decode_json_columns(OPS.latest_job_state(ch.drop("pii_detected", "pii_types", "summary"))).where("job_id = 'b'").first()
    assert (old.pii_detected, old.pii_types, old.summary) == (None, [], None)


def test_decode_and_evolve(spark):
    df = spark.createDataFrame([("j", None, "", None), ("k", '["CPF"]', '{"k": 3}', '{"n": "1"}')],
                               "job_id STRING, pii_types STRING, payload STRING, summary STRING")
    out = {r.job_id: r for r in OPS.decode_json_columns(df).collect()}
    assert out["j"].pii_types == [] and out["j"].payload == {} and out["j"].summary is None
    assert out["k"].pii_types == ["CPF"] and out["k"].payload["k"].toPython() == 3 and out["k"].summary == {"n": "1"}
    old = spark.createDataFrame([("j",)], "job_id STRING")
    assert OPS.evolve_schema(old).first().payload == "{}"


def test_execution_summary(spark):
    rows = [("e1", "validation", 0.0, True), ("e1", "validation", 2.5, False), ("e1", "tool_call", 1.0, None),
            ("e2", "error", 0.0, None), ("e2", "agent_decision", 0.004, None)]
    ev = spark.createDataFrame([(e, t, T0 + dt.timedelta(seconds=s), v) for e, t, s, v in rows],
                               "execution_id STRING, event_type STRING, ts TIMESTAMP, valid BOOLEAN")
    got = {r.execution_id: r for r in OPS.execution_summary(ev).collect()}
    e1, e2 = got["e1"], got["e2"]
    assert (e1.duration_ms, e1.total_tool_calls, e1.total_validations, e1.failed_validations,
            e1.total_errors, e1.success) == (2500.0, 1, 2, 1, 0, True)
    assert (e2.total_errors, e2.success, e2.duration_ms) == (1, False, 4.0)


def test_rate_limit_golden(spark):
    secs = [0, 10, 20, 59.9, 60, 61]
    calls = spark.createDataFrame([(i, "u", T0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)],
                                  "seq BIGINT, key STRING, ts TIMESTAMP")
    got = [r.admitted for r in rate_limit(calls, "key", "ts", "seq", 2, 60).orderBy("seq").collect()]
    assert got == [True, True, False, False, True, False]


def test_rate_limit_keys_independent_and_partition_count_free(spark):
    rows = [(i, f"k{i % 3}", T0 + dt.timedelta(seconds=7 * i)) for i in range(60)]
    calls = spark.createDataFrame(rows, "seq BIGINT, key STRING, ts TIMESTAMP")
    a = sorted((r.seq, r.admitted) for r in rate_limit(calls, "key", "ts", "seq", 2, 60, 1).collect())
    b = sorted((r.seq, r.admitted) for r in rate_limit(calls, "key", "ts", "seq", 2, 60, 7).collect())
    assert a == b and len(a) == 60


def _brute_force(times, k, window):
    admitted, out = [], []
    for t in times:
        admitted = [a for a in admitted if t - a < window]
        ok = len(admitted) < k
        if ok:
            admitted.append(t)
        out.append(ok)
    return out


def test_rate_limit_segments_match_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows, expected = [], {}
    seq = 0
    for key in ("hot", "a", "b"):
        t, times = 0.0, []
        for _ in range(400 if key == "hot" else 40):
            # bursts with pauses longer than the window split the key into segments
            t += rnd.choice([0.5, 1.0, 3.0, 7.0, 95.0])
            times.append(round(t, 3))
        for ok, tt in zip(_brute_force(times, 3, 60.0), times):
            rows.append((seq, key, T0 + dt.timedelta(seconds=tt)))
            expected[seq] = ok
            seq += 1
    calls = spark.createDataFrame(rows, "seq BIGINT, key STRING, ts TIMESTAMP")
    got = {r.seq: r.admitted for r in rate_limit(calls, "key", "ts", "seq", 3, 60, 5).collect()}
    assert got == expected


def test_retry_keeps_every_payload_key(spark):
    rows = [("a", "failed", "e1", '{"days": 30, "k": 1, "db_path": "x/y.db", "opt": {"a": null, "b": [1, 2]}, "none": null}'),
            ("b", "failed", "e2", '{"execution_id": "old", "model": "m"}'), ("c", "failed", None, '{"execution_id": "old"}'),
            ("d", "failed", "e4", "not json"), ("e", "failed", None, None), ("f", "succeeded", "e6", "{}"), ("g", None, "e7", "{}")]
    jobs = spark.createDataFrame(rows, "job_id STRING, status STRING, execution_id STRING, payload STRING")
    got = {r.job_id: json.loads(r.retry_payload) for r in OPS.retry_plan(jobs).collect()}
    assert got == {"a": {"days": 30, "k": 1, "db_path": "x/y.db", "opt": {"a": None, "b": [1, 2]}, "none": None, "execution_id": "e1"},
                   "b": {"execution_id": "e2", "model": "m"}, "c": {"execution_id": "old"}, "d": {"execution_id": "e4"}, "e": {}}


def test_bad_stamp_and_missing_execution(spark):
    rows = [("1", "tool_call", "e", "no time", '{"tool_name": "t", "inputs": {"q": [1]}, "metadata": {"a": 1}}'),
            ("2", "error", None, "2026-01-01T00:00:00", '{"stack_trace": "line 1"}')]
    audit = spark.createDataFrame(rows, "event_id STRING, event_type STRING, execution_id STRING, timestamp STRING, data STRING")
    events = OPS.flatten_events(audit)
    first, second = events.orderBy("event_id").collect()
    assert first.ts is None and json.loads(first.inputs) == {"q": [1]} and json.loads(first.metadata) == {"a": 1}
    assert second.stack_trace == "line 1"
    assert [r.execution_id for r in OPS.execution_summary(events).collect()] == ["e"]


def test_rate_limit_keeps_calls_without_key_or_time(spark):
    from episcope.operators.ratelimit import rate_limit
    rows = [(1, None, T0), (2, None, T0), (3, "u", None), (4, "u", T0)]
    calls = spark.createDataFrame(rows, "seq INT, user STRING, ts TIMESTAMP")
    got = {r.seq: r.admitted for r in rate_limit(calls, "user", "ts", "seq", max_calls=1).collect()}
    assert got == {1: True, 2: False, 3: None, 4: True}


def _brute_rate(calls, max_calls, window_s):
    """Decisions by ``seq``, one key after the other, straight from the rule."""
    out, admitted = {}, {}
    for seq, key, ts in sorted(calls, key=lambda c: (c[2], c[0])):
        kept = admitted.setdefault(key, [])
        out[seq] = sum((ts - t).total_seconds() < window_s for t in kept) < max_calls
        if out[seq]:
            kept.append(ts)
    return out


@pytest.mark.parametrize("chunk", [1, 7, 40])
def test_dense_keys_are_folded_in_chunks(spark, chunk):
    r = random.Random(chunk)
    start = dt.datetime(2024, 1, 1)
    calls = []
    # Keys that never pause: well under the limit, about at it, and far over it; one that pauses.
    for key, gap in (("calm", 40), ("even", 21), ("over", 3), (None, 20)):
        at = 0.0
        for _ in range(220):
            at += r.uniform(0, 2 * gap)
            calls.append((len(calls), key, start + dt.timedelta(seconds=round(at, 3))))
    calls += [(len(calls) + k, "pauses", start + dt.timedelta(seconds=700 * (k // 9) + k % 9)) for k in range(90)]
    df = spark.createDataFrame(calls, "seq LONG, key STRING, ts TIMESTAMP").repartition(5)
    out = rate_limit(df, "key", "ts", "seq", 3, 60, chunk_calls=chunk)
    assert {x.seq: x.admitted for x in out.collect()} == _brute_rate(calls, 3, 60)


def test_a_dense_key_is_spread_over_tasks(spark):
    calls = spark.range(6000).select("id", F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id")).alias("ts"))
    keyed = calls.select(F.col("key").alias("_rl_key"), (F.col("id") * 1_000_000).alias("_rl_t"), F.expr("id div 7").alias("_rl_bucket"))
    chunks = segments(keyed, 60_000_000, 500)
    assert chunks.select("_rl_seg").distinct().count() == 1
    sizes = [x["count"] for x in keyed.join(chunks, ["_rl_key", "_rl_bucket"]).groupBy("_rl_chunk").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 510
    out = rate_limit(calls, "key", "ts", "id", 10, 60, chunk_calls=500)
    assert out.where("admitted").count() == 1000  # ten of every sixty
