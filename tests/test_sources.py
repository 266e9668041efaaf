"""Sources and sinks: round trips through files."""

import datetime as dt
import json
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from episcope import schema as S
from episcope.operators.clean import clean_cases
from episcope.operators.news import union_feeds
from episcope.operators.report import latest_source
from episcope.sources import audit as SA
from episcope.sources import cases as SC
from episcope.sources import versions

from test_cases import RAW_CSV


def _curated(spark):
    rows = [(dt.date(2023, 12, 30), "SP", 1), (dt.date(2024, 1, 2), "RJ", 0), (dt.date(2024, 2, 2), "SP", 1)]
    return spark.createDataFrame(rows, "dt_notific DATE, sg_uf STRING, obito INT")


def test_processed_round_trip(spark, tmp_path):
    df = _curated(spark)
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        SC.write_processed(df.withColumnRenamed("dt_notific", "DT_NOTIFIC"), path, fmt)
        back = SC.read_processed(spark, path, fmt)
        assert sorted(r.DT_NOTIFIC for r in back.collect()) == sorted(r.dt_notific for r in df.collect())


def test_append_and_reload(spark, tmp_path):
    root = str(tmp_path / "table")
    SC.load_curated(_curated(spark), root)
    SC.load_curated(_curated(spark), root)
    assert SC.read_curated(spark, root).count() == 6 and SC.read_curated(spark, root, year=2024).count() == 4
    SC.replace_curated(_curated(spark), root)
    SC.replace_curated(_curated(spark).where(F.col("sg_uf") == "SP"), root)
    assert SC.read_curated(spark, root).count() == 2  # only the latest reload is visible
    assert SC.read_curated(spark, root, year=2024).count() == 1
    SC.load_curated(_curated(spark).where(F.col("sg_uf") == "RJ"), root)  # an append after a reload is seen, too
    assert SC.read_curated(spark, root).count() == 3
    assert "year=2024" in SC.read_curated(spark, root, year=2024).inputFiles()[0]


def test_reload_of_single_years(spark, tmp_path):
    root = str(tmp_path / "table")
    SC.replace_curated(_curated(spark), root)
    before = versions.head(spark, root)
    SC.replace_curated(_curated(spark).where(F.col("sg_uf") == "SP"), root, years=[2024])
    after = versions.head(spark, root)
    assert after.parts["2023"] == before.parts["2023"] and after.parts["2024"] != before.parts["2024"]
    assert sorted((r.dt_notific.year, r.sg_uf) for r in SC.read_curated(spark, root).collect()) == [(2023, "SP"), (2024, "SP")]
    SC.replace_curated(_curated(spark).limit(0), root, years=[2023])  # a year without rows is emptied
    assert [r.year for r in SC.read_curated(spark, root).collect()] == [2024]
    assert SC.read_curated(spark, root, year=2023).count() == 0
    SC.replace_curated(_curated(spark).limit(0), root)
    assert SC.read_curated(spark, root).count() == 0 and SC.read_curated(spark, root).columns[-1] == "year"


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "table")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: SC.load_curated(_curated(spark).withColumn("obito", F.lit(k)), root), range(4)))
    assert sorted(r.obito for r in SC.read_curated(spark, root, year=2023).collect()) == [0, 1, 2, 3]
    assert versions.head(spark, root).number == 3


def test_a_failed_load_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "table")
    SC.load_curated(_curated(spark), root)
    versions.write_load(SC._curated_with_year(_curated(spark)), root, "year")  # files, but no manifest
    broken = _curated(spark).withColumn("obito", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        SC.replace_curated(broken, root)
    assert SC.read_curated(spark, root).count() == 3


def test_rows_without_a_date_have_a_partition(spark, tmp_path):
    root = str(tmp_path / "table")
    undated = _curated(spark).withColumn("dt_notific", F.when(F.col("sg_uf") == "SP", F.col("dt_notific")))
    SC.load_curated(undated, root)
    assert SC.read_curated(spark, root).where("year IS NULL").count() == 1
    SC.replace_curated(undated.where("dt_notific IS NULL"), root, years=[None])
    assert SC.read_curated(spark, root).count() == 3


def test_processed_types_come_back(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_bytes(RAW_CSV.encode("latin1"))
    for curated in (True, False):
        out = clean_cases(SC.read_cases_csv(spark, str(raw)), year=2024, curated=curated)
        path = str(tmp_path / f"processed-{curated}")
        SC.write_processed(out, path, "csv")
        back = SC.read_processed(spark, path, "csv")
        assert back.dtypes == out.dtypes
        assert sorted(map(str, back.collect())) == sorted(map(str, out.collect()))


def _jobs(spark, action):
    """How many Spark jobs ``action`` runs."""
    group = f"jobs-{uuid.uuid4().hex}"  # a function that is gone may leave its address, and so its name, to the next
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_many_files_take_as_many_jobs_as_few(spark, tmp_path):
    names = list(S.RAW_COLUMNS)
    layouts = [names, ["OUTRA", *names[::-1]], [*sorted(names), "MAIS"]]
    row = {"DT_NOTIFIC": "2024-01-02", "SG_UF": "SP"}
    counts = []
    for n in (3, 150, 450):
        d = tmp_path / str(n)
        d.mkdir()
        for k in range(n):
            columns = layouts[k % 3]
            (d / f"{k:04d}.csv").write_text(";".join(f'"{c}"' for c in columns) + "\n" + ";".join(row.get(c, "9") for c in columns) + "\n")
        (d / "empty.csv").write_text("")
        got = []
        counts.append(_jobs(spark, lambda d=d, got=got: got.extend(SC.read_cases_csv(spark, str(d)).collect())))
        assert len(got) == n and {(r.DT_NOTIFIC, r.SG_UF) for r in got} == {("2024-01-02", "SP")}
    # Spark lists more than a few files in a job of its own, twice for each scan.
    assert counts[1] == counts[2] <= counts[0] + 2 * 3


def test_headers_of_files_that_tasks_cannot_open(spark, tmp_path, monkeypatch):
    names = ["OUTRA", *S.RAW_COLUMNS[::-1]]
    path = tmp_path / "a b.csv"
    path.write_bytes((";".join(names) + "\nx;" + ";".join("1" if c == "UTI" else "é" for c in names[1:]) + "\n").encode("latin1"))
    files = spark.read.format("binaryFile").load(str(path))
    got = SC._headers_by_spark(spark, [r.path for r in files.select("path").collect()], ";", "ISO-8859-1").collect()
    assert [(r.path, r.header) for r in got] == [(files.first().path, names)]
    assert SC._first_line("nowhere://host/file.csv", "utf-8") is None


def test_ingest_writes_load_history(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_bytes(RAW_CSV.encode("latin1"))
    history = str(tmp_path / "history")
    meta = SC.ingest(spark, str(raw), str(tmp_path / "t"), year=2024, metadata_path=history,
                     source_url="https://example.test/file.csv")
    assert meta["rows_processed"] == 2
    SC.ingest(spark, str(raw), str(tmp_path / "t"), year=2023, metadata_path=history)
    latest = latest_source(spark.read.json(history)).first()
    assert latest.rows_processed == 0  # the 2023 reload is the newest entry
    assert SC.read_curated(spark, str(tmp_path / "t")).count() == 0


SHAPES = ['{"valid": false}', '{"inputs": {"a": [1, null]}, "tool_name": "t"}', '[1, 2]', '"text"', "no json", None]


def test_audit_batches_count_once(spark, tmp_path):
    rows = [(str(k), f"2024-01-0{1 + k % 2}T10:00:00", "validation", "e1", data) for k, data in enumerate(SHAPES)]
    ev = spark.createDataFrame(rows, S.AUDIT_SCHEMA)
    path = str(tmp_path / "audit")
    batch = SA.append_audit(ev.where("event_id < '3'"), path)
    SA.append_audit(ev.where("event_id >= '3'"), path, "late")
    for _ in range(2):  # a retry of either batch adds nothing
        SA.append_audit(ev.where("event_id < '3'"), path, batch)
        SA.append_audit(ev.where("event_id >= '3'"), path, "late")
    got = {r.event_id: r.data for r in SA.read_audit_log(spark, path).collect()}
    assert {k: v and json.loads(v) for k, v in got.items()} == {
        "0": {"valid": False}, "1": {"inputs": {"a": [1, None]}, "tool_name": "t"}, "2": [1, 2], "3": "text", "4": "no json", "5": None}
    # In the files ``data`` is an object, not an escaped string.
    lines = [json.loads(r[0]) for r in spark.read.text(f"{path}/batch={batch}").collect()]
    assert {type(x["data"]) for x in lines} == {dict, list}
    # A batch whose writer died before its marker is not there.
    ev.write.partitionBy("event_type").json(f"{path}/batch=dead")
    assert SA.read_audit_log(spark, path).count() == 6


def test_reports_round_trip(spark, tmp_path):
    reports = spark.createDataFrame([("e1", "# A\n\nline\n"), ("e2", "# B")], "execution_id STRING, report STRING")
    SA.write_reports(reports, str(tmp_path / "reports"))
    got = {r.execution_id: r.report for r in SA.read_reports(spark, str(tmp_path / "reports")).collect()}
    assert got == {"e1": "# A\n\nline\n", "e2": "# B"}


def test_union_feeds_keeps_order_columns(spark):
    a = spark.createDataFrame([(0, 1, "t1")], "feed_pos INT, item_pos INT, title STRING")
    b = spark.createDataFrame([(1, 0, "t2")], "feed_pos INT, item_pos INT, title STRING")
    assert [tuple(r) for r in union_feeds(a, b).orderBy("feed_pos").collect()] == [(0, 1, "t1"), (1, 0, "t2")]


def test_a_second_batch_of_reports_keeps_the_first(spark, tmp_path):
    from episcope.sources.audit import read_reports, write_reports
    path = str(tmp_path / "reports")
    for execution, text in (("20240102", "one\ntext"), ("b", "two"), ("b", "two again")):
        write_reports(spark.createDataFrame([(execution, text)], "execution_id STRING, report STRING"), path)
    got = sorted((r.execution_id, r.report) for r in read_reports(spark, path).collect())
    assert got == [("20240102", "one\ntext"), ("b", "two again")]
