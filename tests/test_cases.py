"""Cleaning, indicators and series: golden values (FIXTURES.md §3)."""

import datetime as dt

import pytest

from episcope import schema as S
from episcope.functions.cases import age_years, coerce_date
from episcope.operators import clean as C
from episcope.operators import metrics as M
from episcope.operators import series as TS
from episcope.sources.cases import read_cases_csv

RAW_CSV = """DT_NOTIFIC;DT_SIN_PRI;SG_UF;CO_MUN_RES;CS_SEXO;NU_IDADE_N;TP_IDADE;EVOLUCAO;UTI;DT_ENTUTI;DT_SAIDUTI;VACINA;VACINA_COV;DOSE_1_COV;DOSE_2_COV;DOSE_REF;CLASSI_FIN;DT_EVOLUCA;DT_INTERNA;HOSPITAL;FEBRE;TOSSE;DISPNEIA;SATURACAO
2024-03-11;2024-03-08;SP;350950;2;8;3;1;2;;;2;1;;;;4;2024-03-20;2024-03-11;1;1;2;1;9
2024-04-02;2024-03-29;RJ;330330;1;81;4;2;1;2024-04-03;2024-04-10;1;2;;;;5;2024-04-11;2024-04-02;1;2;1;1;1
"""


def test_reference_table_metrics(curated_fixture):
    fact = M.daily_fact(curated_fixture)
    row = M.all_metrics(fact).first()
    assert row[S.M_TOTAL] == 12
    assert row[S.M_MORTALITY] == pytest.approx(25.0)
    assert row[S.M_ICU] == pytest.approx(100 / 3)
    assert row[S.M_VACCINATION] == pytest.approx(50.0)
    assert row[S.M_GROWTH] == 0.0  # no earlier cases


def test_daily_window_is_n_plus_one_days(curated_fixture):
    rows = TS.daily_cases(M.daily_fact(curated_fixture), 7).collect()
    assert [r.date for r in rows] == [f"2024-12-{d:02d}" for d in range(5, 13)]
    assert all(r.cases == 1 for r in rows)


def test_monthly_last_n(curated_fixture):
    rows = TS.monthly_cases(M.daily_fact(curated_fixture), 3).collect()
    assert [(r.month, r.cases) for r in rows] == [("2024-12", 12)]


def test_flat_series_growth_is_asymmetric(spark):
    base = dt.date(2024, 1, 1)
    rows = [(base + dt.timedelta(days=d), 1, 0, 0) for d in range(100) for _ in range(10)]
    cases = spark.createDataFrame(rows, "dt_notific DATE, obito INT, internou_uti INT, vacinado INT")
    g = M.growth_rate(M.daily_fact(cases), 30).first()[0]
    assert g == pytest.approx((310 - 300) / 300 * 100)


def test_empty_table_metrics_are_zero(spark):
    empty = spark.createDataFrame([], "dt_notific DATE, obito INT, internou_uti INT, vacinado INT")
    row = M.all_metrics(M.daily_fact(empty)).first()
    assert row.asDict() == {S.M_GROWTH: 0.0, S.M_MORTALITY: 0.0, S.M_ICU: 0.0,
                            S.M_VACCINATION: 0.0, S.M_TOTAL: 0}


def test_raw_csv_clean(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_bytes(RAW_CSV.encode("latin1"))
    out = C.clean_cases(read_cases_csv(spark, str(path)), year=2024).orderBy("dt_notific").collect()
    assert len(out) == 2
    assert [r.idade_anos for r in out] == [pytest.approx(8 / 12), 81.0]
    assert [r.obito for r in out] == [0, 1]
    assert [r.internou_uti for r in out] == [0, 1]
    assert [r.vacinado for r in out] == [1, 1]
    assert [r.hospitalizado for r in out] == [1, 1]
    assert [r.co_mun_res for r in out] == ["350950", "330330"]
    m = M.all_metrics(M.daily_fact(C.clean_cases(read_cases_csv(spark, str(path)), year=2024))).first()
    assert (m[S.M_MORTALITY], m[S.M_ICU], m[S.M_VACCINATION]) == (50.0, 50.0, 100.0)


def test_missing_column_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("DT_NOTIFIC;SG_UF\n2024-01-01;SP\n", encoding="latin1")
    with pytest.raises(ValueError, match="DT_SIN_PRI"):
        read_cases_csv(spark, str(path))


def test_age_units(spark):
    df = spark.createDataFrame([("30", 4), ("6", 3), ("73", 2), ("876", 1), ("1", 5), ("9", None)],
                               "n STRING, u INT")
    got = [r[0] for r in df.select(age_years("n", "u")).collect()]
    assert got[:4] == pytest.approx([30.0, 0.5, 0.2, 0.1])
    assert got[4:] == [None, None]


def test_date_coercion(spark):
    df = spark.createDataFrame([("2024-1-5",), ("2024-01-05 10:00:00",), (" 2024-01-05",), ("",), (None,)],
                               "s STRING")
    got = [r[0] for r in df.select(coerce_date("s")).collect()]
    assert got == [dt.date(2024, 1, 5), None, None, None, None]


def test_unknown_codes_count_as_zero(spark):
    raw = spark.createDataFrame([("2024-03-01", None, "9", None, "9", "x")],
                                "DT_NOTIFIC STRING, EVOLUCAO STRING, UTI STRING, VACINA STRING, "
                                "VACINA_COV STRING, HOSPITAL STRING")
    r = C.clean_cases(raw, year=2024).first()
    assert (r.obito, r.internou_uti, r.vacinado, r.hospitalizado) == (0, 0, 0, 0)


def test_gap_month_separates_ts2_and_ts3(spark):
    days = [dt.date(2024, m, 1) for m in (1, 2, 3, 5, 6)]  # April is empty
    cases = spark.createDataFrame([(d, 0, 0, 0) for d in days],
                                  "dt_notific DATE, obito INT, internou_uti INT, vacinado INT")
    fact = M.daily_fact(cases)
    assert [r.month for r in TS.monthly_cases(fact, 4).collect()] == ["2024-02", "2024-03", "2024-05", "2024-06"]
    assert [r.month for r in TS.monthly_cases_calendar(fact, 4).collect()] == ["2024-03", "2024-05", "2024-06"]


def test_parameter_checks(curated_fixture):
    fact = M.daily_fact(curated_fixture)
    with pytest.raises(ValueError):
        TS.daily_cases(fact, 0)
    with pytest.raises(ValueError):
        TS.monthly_cases(fact, 25)


def test_describe_cases(spark):
    cases = spark.createDataFrame(
        [(dt.date(2024, 1, 1), 1, 0, 1, 10.0), (dt.date(2024, 1, 3), 0, 1, 1, None),
         (dt.date(2024, 1, 2), 0, 0, 0, 30.0), (dt.date(2024, 1, 2), 0, 0, 0, 50.0)],
        "dt_notific DATE, obito INT, internou_uti INT, vacinado INT, idade_anos DOUBLE")
    r = M.describe_cases(cases).first()
    assert (r.total_casos, r.total_obitos, r.total_uti, r.total_vacinados) == (4, 1, 1, 2)
    assert (r.idade_media, r.idade_mediana) == (30.0, 30.0)
    assert (r.data_inicio, r.data_fim) == ("2024-01-01", "2024-01-03")


def test_metrics_by_region_share_global_anchor(spark):
    rows = [(dt.date(2024, 1, 15), "A", 0, 0, 0), (dt.date(2024, 3, 1), "B", 0, 0, 0)]
    cases = spark.createDataFrame(rows, "dt_notific DATE, sg_uf STRING, obito INT, internou_uti INT, vacinado INT")
    fact = M.daily_fact(cases, ["sg_uf"])
    got = {r.sg_uf: r[S.M_GROWTH] for r in M.all_metrics(fact, 30, ["sg_uf"]).collect()}
    # A's only case falls in the previous window of the global anchor (2024-03-01).
    assert got == {"A": -100.0, "B": 0.0}
    roll = {r.sg_uf: r[S.M_TOTAL] for r in M.metrics_rollup(fact).collect()}
    assert roll == {"A": 1, "B": 1, None: 2}


def test_files_of_other_layouts_are_matched_by_name(spark, tmp_path):
    """Extra columns, another column order, nullable codes as 2.0 and a quoted backslash, batch and stream."""
    from episcope.streaming.jobs import stream_ingest
    header, first, second = RAW_CSV.strip().split("\n")
    names = header.split(";")
    d = tmp_path / "raw"
    d.mkdir()
    one = dict(zip(names, first.split(";"), strict=True)) | {"UTI": "1.0", "OBS": '"back\\"'}
    wide = ["OBS", *names[:5], "EXTRA", *names[5:]]
    body = ";".join(one.get(n, "x") for n in wide)
    (d / "2023.csv").write_bytes((";".join(wide) + "\n" + body + "\n").encode("latin1"))
    out = d.parent / "out"
    stream_ingest(spark, str(d), str(out), str(tmp_path / "ck"), year=2024)
    streamed = spark.read.parquet(str(out)).collect()
    assert [(r.sg_uf, r.co_mun_res, r.internou_uti) for r in streamed] == [("SP", "350950", 1)]
    two = dict(zip(names, second.split(";"), strict=True))
    turned = names[::-1]
    (d / "2024.csv").write_bytes((";".join(turned) + "\n" + ";".join(two[n] for n in turned) + "\n").encode("latin1"))
    rows = C.clean_cases(read_cases_csv(spark, str(d)), year=2024).orderBy("dt_notific").collect()
    assert [(r.sg_uf, r.co_mun_res, r.internou_uti) for r in rows] == [("SP", "350950", 1), ("RJ", "330330", 1)]
