"""Driver contract, oracle agreement on the smoke tables and partition-count stability."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from episcope.plans.fixtures import TABLES  # noqa: E402

SMOKE = "/root/testdata/sf0.001"

FAST = ["clean_cases", "all_metrics", "describe_cases", "metrics_rollup", "daily_cases_by_uf",
        "monthly_cases", "monthly_cases_calendar", "chart_series_by_uf", "findings_by_uf",
        "report_by_uf", "report_legacy_by_uf", "metric_checks", "detect_pii",
        "anonymize_documents", "sanitize_text", "clean_html", "dedupe_titles", "rank_news",
        "report_with_news", "parse_feed_dates", "latest_job_state", "status_counts",
        "recent_jobs", "backlog_head", "retry_plan", "flatten_events", "execution_summary",
        "rate_limit", "feed_items", "audit_log_roundtrip"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_casos > 0
    assert df.columns == ["taxa_aumento_casos", "taxa_mortalidade", "taxa_ocupacao_uti",
                          "taxa_vacinacao", "total_casos"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMOKE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMOKE)
    res = duck.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(o_cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(o_cols, res.fetchall())
    # Same pandas dtypes on both sides, so a hash over pandas values agrees too.
    s_types = {c: str(t) for c, t in df.toPandas().dtypes.items()}
    o_types = {c: str(t) for c, t in duck.execute(E.oracle_sql()[name]).df().dtypes.items()}
    assert s_types == o_types


@pytest.mark.parametrize("name", ["metrics_by_uf", "dedupe_titles", "latest_job_state", "rate_limit"])
def test_same_result_for_any_shuffle_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in (1, 4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append(sorted(tuple(r) for r in E.queries()[name](spark, SMOKE).collect()))
        assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
