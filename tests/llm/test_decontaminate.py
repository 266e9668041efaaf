import hashlib
import random
import re

from pyspark.sql import functions as F

from episcope.llm import decontaminate
from episcope.llm.common import written
from episcope.llm.queries import op5_decontamination
from tests.llm.helpers import SCHEMA, documents, odd_documents, prose, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id LONG, text STRING"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, n=10):
    """For each text: words, hit words, and the ids of items with an occurring window."""
    out = []
    for text in texts:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            iw = words(body)
            for window in {tuple(iw[k:k + n]) for k in range(max(len(iw) - n, 0) + 1)} - {()}:
                for k in range(len(w) - len(window) + 1):
                    if tuple(w[k:k + len(window)]) == window:
                        hit |= set(range(k, k + len(window)))
                        found.add(str(item))
        out.append((len(w), len(hit), len(found), sorted(found)))
    return out


def scanned(spark, docs, items, **kw):
    found = decontaminate.contamination(docs, spark.createDataFrame(items, ITEMS), **kw)
    return found


def test_random_texts_against_brute_force(spark):
    r = random.Random(7)
    texts = [" ".join(r.choices("a b c D".split(), k=r.randint(0, 60))) for _ in range(60)] + ["É a, b-c é", "a" * 9]
    items = [(k, " ".join(r.choices("a b c d".split(), k=r.randint(0, 9)))) for k in range(12)]
    items += [(99, "a b c d a b"), (99, "c c c"), (7, None), (8, "...")]
    got = {r["id"]: (r["n_words"], r["n_hit"], r["n_items"], r["item_ids"]) for r in scanned(spark, documents(spark, texts), items, n=5).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, items, 5)


def test_passages_in_long_texts_and_overlapping_windows(spark):
    item = prose(8, 25)
    texts = [prose(9, 20_000) + " " + item + " " + prose(10, 500), f"{prose(11, 5)} {' '.join(item.split()[3:13])} end",
             " ".join(item.split()[:9]), f"{item} {item}", item.upper().replace(" ", ", ")]
    items = [(1, item), (2, " ".join(item.split()[5:25])), (3, prose(12, 30))]
    got = rows(scanned(spark, documents(spark, texts), items), "id", "n_words", "n_hit", "n_items", "item_ids", "contaminated")
    want = [(k, *b, b[1] > 0) for k, b in enumerate(brute(texts, items))]
    assert got == want


def test_repeated_rows_nulls_and_empty_tables(spark):
    docs = odd_documents(spark).withColumn("pos", F.lit("x")).withColumn("w", F.lit(None).cast("string"))
    found = scanned(spark, docs, [(1, prose(2, 40)), (None, "twin")])
    got = rows(found, "id", "n_hit", "n_items")
    assert len(got) == 14 and got.count((11, 1, 1)) == 2 and (8, 40, 1) in got and (9, 40, 1) in got and (1, 0, 0) in got
    assert found.where("id = 11").first()["item_ids"] == ["null"]
    empty = spark.createDataFrame([], SCHEMA)
    assert scanned(spark, empty, [(1, "a")]).count() == 0
    none = decontaminate.contamination(docs, spark.createDataFrame([], ITEMS))
    assert none.count() == 14 and none.agg(F.sum("n_hit")).first()[0] == 0


def test_removal_of_documents_and_of_spans(spark):
    item = prose(8, 12)
    docs = documents(spark, [f"Before, {item}! After.", "clean text", None, f"{item}"], [5, 6, None, 6]).withColumn("row_hash", F.lit("mine"))
    bench = spark.createDataFrame([(1, item)], ITEMS)
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns and rows(kept, "doc_id", "text", "row_hash") == [(None, None, "mine"), (6, "clean text", "mine")]
    cut = decontaminate.remove_spans(docs, bench)
    gaps = " " * 11
    assert cut.columns == docs.columns
    assert rows(cut, "doc_id", "text") == [(None, None), (5, f"Before, {gaps}! After."), (6, gaps), (6, "clean text")]


def steps(spark, small=True):
    """The plans of the two steps that do the work, on the smoke table."""
    d = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    ids = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row_hash"), "text")
    windows = decontaminate.numbered_windows(bench, 10, "item_id", "text")
    scan = decontaminate.scan_hits(ids, windows, [10], small)
    doubtful = written(scan.where(F.size("hits") > 0).select("id", "row_hash", "hits"), "test-doubtful")
    check = decontaminate.verified_hits(ids, doubtful, windows, small)
    return [df._jdf.queryExecution().executedPlan().toString() for df in (scan, check)], check


def test_plans_are_native_and_move_numbers(spark):
    (scan, check), _ = steps(spark)
    for plan in (scan, check):
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    # The windows come to the documents; the one exchange of the scan moves hits as numbers, no text.
    assert scan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in scan
    moved = [line for line in scan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "grams" not in scan
    # Texts meet their hits in one sort-merge join, whatever the sizes; the windows' words are broadcast.
    assert check.count("SortMergeJoin") == 1 and check.count("BroadcastHashJoin") == 1


def test_a_large_benchmark_is_joined_without_a_broadcast(spark, monkeypatch):
    plans, check = steps(spark, small=False)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", 0)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans, check = steps(spark, small=False)
        assert all("SortMergeJoin" in p and "Broadcast" not in p and "Python" not in p for p in plans)
        assert check.count() > 0
        test_random_texts_against_brute_force(spark)
        test_repeated_rows_nulls_and_empty_tables(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_query_on_the_smoke_table(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = dict(zip(docs, brute(docs.values(), items), strict=True))
    for r in op5_decontamination(spark, d).collect():
        n, hit, k, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, k, hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
