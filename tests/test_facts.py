"""The maintained daily fact: computed once for each load, merged sketches within their error."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from episcope.operators import metrics as M
from episcope.operators import series as TS
from episcope.sources import cases as SC
from episcope.sources import facts as SFA
from episcope.sources import versions

CASES = "dt_notific DATE, sg_uf STRING, idade_anos DOUBLE, obito INT, internou_uti INT, vacinado INT"


def _cases(spark, seed, years=(2022, 2023, 2024), n=900):
    r = random.Random(seed)
    rows = [(dt.date(r.choice(years), r.randint(1, 12), r.randint(1, 28)), r.choice(["SP", "RJ", "AC", None]),
             None if r.random() < 0.1 else float(r.randint(0, 95)), r.randint(0, 1), r.randint(0, 1), r.randint(0, 1)) for _ in range(n)]
    return spark.createDataFrame(rows, CASES)


def test_only_reloaded_years_are_computed_anew(spark, tmp_path):
    cases, fact = str(tmp_path / "cases"), str(tmp_path / "fact")
    SC.replace_curated(_cases(spark, 1), cases)
    assert SFA.refresh_daily_fact(spark, cases, fact) == ["2022", "2023", "2024"]
    assert SFA.refresh_daily_fact(spark, cases, fact) == [] and versions.head(spark, fact).number == 0
    before = versions.head(spark, fact).parts
    SC.replace_curated(_cases(spark, 2, (2023,), 300), cases, years=[2023])
    SC.load_curated(_cases(spark, 3, (2025,), 50), cases)
    assert SFA.refresh_daily_fact(spark, cases, fact) == ["2023", "2025"]
    after = versions.head(spark, fact).parts
    assert after["2022"] == before["2022"] and after["2024"] == before["2024"] and after["2023"] != before["2023"]
    SC.replace_curated(_cases(spark, 3).limit(0), cases, years=[2022])
    assert SFA.refresh_daily_fact(spark, cases, fact) == ["2022"]
    curated, kept = SC.read_curated(spark, cases), SFA.read_daily_fact(spark, fact)
    for year in (None, 2023):
        own = M.daily_fact(curated if year is None else curated.where(F.col("year") == year), ["sg_uf"])
        got = kept if year is None else SFA.read_daily_fact(spark, fact, year)
        assert sorted(map(str, got.select(own.columns).collect())) == sorted(map(str, own.collect()))
    assert M.all_metrics(kept).first() == M.all_metrics(M.daily_fact(curated)).first()
    assert TS.daily_cases(kept, 30).collect() == TS.daily_cases(M.daily_fact(curated), 30).collect()


def test_metrics_read_no_case_file(spark, tmp_path):
    cases, fact = str(tmp_path / "cases"), str(tmp_path / "fact")
    SC.replace_curated(_cases(spark, 4), cases)
    SFA.refresh_daily_fact(spark, cases, fact)
    files = M.all_metrics(SFA.read_daily_fact(spark, fact), keys=["sg_uf"]).inputFiles()
    assert files and all(str(tmp_path / "fact") in f for f in files)


@pytest.mark.parametrize("n", [5, 20_000])
def test_merged_sketches_keep_their_error(spark, tmp_path, n):
    r = random.Random(n)
    rows = [(dt.date(2024, r.randint(1, 12), r.randint(1, 28)), r.choice(["SP", "RJ"]), r.lognormvariate(3, 1), 0, 0, 0) for _ in range(n)]
    curated = SC._curated_with_year(spark.createDataFrame(rows, CASES))
    fact = SFA.daily_fact_with_ages(curated)
    for keys in ([], ["sg_uf"]):
        for got in SFA.describe_fact(fact, keys).collect():
            ages = sorted(x[2] for x in rows if not keys or x[1] == got["sg_uf"])
            low = sum(a < got["idade_mediana"] for a in ages) / len(ages)
            high = sum(a <= got["idade_mediana"] for a in ages) / len(ages)
            assert low - SFA.RANK_ERROR <= 0.5 <= high + SFA.RANK_ERROR
            assert got["total_casos"] == len(ages) and got["idade_media"] == pytest.approx(sum(ages) / len(ages), abs=1e-5)


def test_days_without_ages(spark):
    rows = [(dt.date(2024, 1, 1), "SP", None, 1, 0, 0), (dt.date(2024, 1, 2), "SP", 30.0, 0, 0, 0), (dt.date(2024, 1, 2), "RJ", None, 0, 0, 0)]
    fact = SFA.daily_fact_with_ages(SC._curated_with_year(spark.createDataFrame(rows, CASES)))
    got = {x["sg_uf"]: x for x in SFA.describe_fact(fact, ["sg_uf"]).collect()}
    assert (got["SP"]["idade_mediana"], got["SP"]["idade_media"], got["SP"]["total_casos"]) == (30.0, 30.0, 2)
    assert got["RJ"]["idade_mediana"] is None and got["RJ"]["idade_media"] is None
    assert SFA.describe_fact(fact.limit(0)).first()["total_casos"] == 0
