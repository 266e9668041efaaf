import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from episcope.llm import resample
from episcope.llm.queries import op13_importance_resampling
from tests.llm.helpers import SCHEMA, documents, odd_documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for i in range(len(w)) for n in (1, 2, 3) if i + n <= len(w)], len(w)


def brute(pairs, targets, percent=5, least=20):
    """``(id, features, weight, score, rank)`` of every row."""
    ours = [plain_features(t) for _, t in pairs]
    raw = np.bincount([b for f, _ in ours for b in f], minlength=10000)
    goal = np.bincount([b for t in targets for b in plain_features(t)[0]], minlength=10000)
    s, t = int(raw.sum()), int(goal.sum())
    gain = [math.floor(1000 * math.log(float((goal[b] + 1) * (s + 10000)) / float((raw[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for (doc_id, _), (features, n) in zip(pairs, ours, strict=True):
        name = "null" if doc_id is None else str(doc_id)
        u = (int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[b] for b in features)
        out.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, n])
    pool = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(pool[:percent * len(pool) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_buckets_against_crc32():
    r = random.Random(1)
    words = ["ab", "Cd", "é", "日本", "..", "1", "\x00", "_"]
    texts = ["", "a", "a b", "É ÀB日本 x,y", "x" * 100 + " b c " + "y" * 61 + " z", "q" * 60 + " " + "r" * 60 + " " + "s" * 60]
    texts += [r.choice([" ", "-", "\n"]).join(r.choice([*words, "x" * r.randint(1, 90)]) for _ in range(r.randint(0, 40))) for _ in range(500)]
    flat, n_words = resample.feature_buckets([t.encode() for t in texts])
    want = [plain_features(t) for t in texts]
    assert flat.tolist() == [b for f, _ in want for b in f] and n_words.tolist() == [n for _, n in want]


def test_documents_against_brute_force(spark):
    r = random.Random(6)
    texts = [prose(k, r.randint(1, 90)) for k in range(300)] + [prose(3, 25)] * 30
    targets = [prose(k, 30, 60) for k in range(20)] + [None, ""]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(targets)], "item_id LONG, text STRING")
    docs = documents(spark, texts).repartition(6)
    assert found(resample.resample(docs, bench)) == brute(list(enumerate(texts)), targets)
    assert found(resample.resample(docs, bench, percent=100, min_words=0)) == brute(list(enumerate(texts)), targets, 100, 0)
    assert {r[4] for r in found(resample.resample(docs, bench, percent=0))} == {None}


def test_quickselect_against_a_sort(spark):
    r = random.Random(2)
    values = [(r.randrange(40), k) for k in range(700)]
    df = spark.createDataFrame(values, "a LONG, b LONG").repartition(7)
    for k in (1, 2, 350, 699, 700):
        assert resample.kth_highest(df, k, ["a", "b"], pivots=4) == sorted(values)[k - 1]
    assert resample.kth_highest(df, 0, ["a", "b"]) is None and resample.kth_highest(df, 701, ["a", "b"]) is None
    assert resample.kth_highest(df.where("a < 0"), 1, ["a", "b"]) is None
    got = resample.ranked(df, ["a", "b"], "rank").collect()
    assert sorted((r["rank"], r["a"], r["b"]) for r in got) == [(k + 1, *v) for k, v in enumerate(sorted(values))]


def test_ties_and_repeated_rows(spark):
    text = prose(1, 30)
    docs = documents(spark, [text] * 40 + [prose(2, 40)] * 20, [7] * 40 + [None] * 20)
    target = spark.createDataFrame([(text,)], "text STRING")
    got = resample.resample(docs, target, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31))
    assert len(got) == 60 and {r["id"] for r in got if r["rank"]} == {7}


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark).withColumn("score", F.lit("mine")).withColumn("_buckets", F.lit(1))
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = spark.createDataFrame([(1, prose(2, 40))], "item_id LONG, text STRING")
    got = found(resample.resample(docs, target, percent=50))
    want = brute(pairs, [prose(2, 40)], 50)
    assert got == want
    empty = spark.createDataFrame([], SCHEMA)
    assert resample.resample(empty, target).count() == 0
    assert found(resample.resample(docs, target.limit(0), percent=50)) == brute(pairs, [], 50)


def test_query_on_the_smoke_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    targets = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert found(op13_importance_resampling(spark, d).withColumnRenamed("doc_id", "id")) == brute(docs, targets)
