"""Property checks on the smoke tables."""

import datetime as dt
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from episcope.operators import ops as OPS
from episcope.operators import privacy as PV
from episcope.operators.ratelimit import rate_limit
from episcope.plans import fixtures as FX
from episcope.plans.queries import cases
from episcope.session import shared_dir
from episcope.sources import audit as SA
from episcope.streaming import jobs as ST

SMOKE = "/root/testdata/sf0.001"


def test_daily_series_sums_to_window_count(spark):
    c = cases(spark, SMOKE)
    daily = E.queries()["daily_cases"](spark, SMOKE)
    last = c.agg(F.max("dt_notific")).first()[0]
    in_window = c.where(F.col("dt_notific") >= F.lit(last - dt.timedelta(days=30))).count()
    assert daily.agg(F.sum("cases")).first()[0] == in_window


def test_scrubbed_text_has_no_pii(spark):
    scrubbed = PV.scrub_texts(FX.pii_texts(spark, SMOKE))
    assert scrubbed.where("pii_detected").count() > 0
    again = PV.detect_pii(scrubbed.select("doc_id", "text"))
    assert again.where("has_pii").count() == 0


def test_rank_scores_do_not_increase(spark):
    rows = E.queries()["rank_news"](spark, SMOKE).orderBy("rank").collect()
    scores = [r.score for r in rows]
    assert scores == sorted(scores, reverse=True) and [r.rank for r in rows] == list(range(1, len(rows) + 1))


def test_stream_summary_equals_batch(spark):
    base = shared_dir(spark, "prop-" + uuid.uuid4().hex[:6])
    audit = FX.audit_events(spark, SMOKE)
    SA.append_audit(audit, f"{base}/in")
    ST.stream_execution_summary(spark, f"{base}/in", f"{base}/log", f"{base}/ckpt")
    stream = sorted(tuple(r) for r in ST.read_execution_summary(spark, f"{base}/log").collect())
    batch = OPS.execution_summary(OPS.flatten_events(audit))
    batch = sorted(tuple(r) for r in batch.select(*ST.read_execution_summary(spark, f"{base}/log").columns).collect())
    assert stream == batch


def _brute(times, k, w):
    kept, out = [], []
    for t in times:
        kept = [a for a in kept if t - a < w]
        out.append(len(kept) < k)
        if out[-1]:
            kept.append(t)
    return out


@settings(max_examples=8, deadline=None)
@given(gaps=st.lists(st.integers(min_value=0, max_value=90), min_size=1, max_size=40),
       k=st.integers(min_value=1, max_value=3))
def test_rate_limit_matches_brute_force(spark, gaps, k):
    times, t = [], 0
    for g in gaps:
        t += g
        times.append(t)
    t0 = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([(i, "u", t0 + dt.timedelta(seconds=s)) for i, s in enumerate(times)],
                                  "seq BIGINT, key STRING, ts TIMESTAMP")
    got = [r.admitted for r in rate_limit(calls, "key", "ts", "seq", k, 60, 3).orderBy("seq").collect()]
    assert got == _brute(times, k, 60)
