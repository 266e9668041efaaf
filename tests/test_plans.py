"""Plan-shape checks: pruning, single scan of the cases, aggregates instead of windows."""

import re

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain(mode="formatted")
    return capsys.readouterr().out


def test_flagship_reads_materialised_fact(spark, capsys):
    text = plan(E.queries()["all_metrics"](spark, SMOKE), capsys)
    # The anchor subquery and the aggregate both read the checkpointed fact:
    # no parquet scan (and no join) appears anywhere in the plan.
    assert "Scan parquet" not in text
    assert "Join" not in text
    assert "Subquery" in text


def test_case_scan_is_pruned(spark, capsys):
    from episcope.plans.queries import cases
    text = plan(cases(spark, SMOKE), capsys)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    lineitem = [s for s in schemas if "l_orderkey" in s]
    assert lineitem and "l_extendedprice" not in lineitem[0] and "l_tax" not in lineitem[0]
    assert "PushedFilters" in text


def test_dedupe_and_job_fold_are_aggregates(spark, capsys):
    from episcope.operators import news as N
    from episcope.plans.queries import jobs, page_news
    dedupe = plan(N.dedupe_titles(page_news(spark, SMOKE)), capsys)
    assert "HashAggregate" in dedupe or "ObjectHashAggregate" in dedupe or "SortAggregate" in dedupe
    assert "Window" not in dedupe
    fold = plan(jobs(spark, SMOKE), capsys)
    assert "Window" not in fold and "Aggregate" in fold


def test_top_k_is_take_ordered(spark, capsys):
    text = plan(E.queries()["recent_jobs"](spark, SMOKE), capsys)
    assert "TakeOrderedAndProject" in text


def _all_queries():
    return sorted(E.queries())


@pytest.mark.parametrize("name", _all_queries())
def test_no_cross_join_anywhere(spark, capsys, name):
    """No registered query plans a Cartesian product or nested-loop join."""
    text = plan(E.queries()[name](spark, SMOKE), capsys)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
