import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from episcope.llm import runs
from episcope.llm.queries import op12_periodic_runs
from tests.llm.helpers import SCHEMA, documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, min_length=6, repeats=4):
    """Every maximal stretch, period by period; stretches with a smaller period are left out."""
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(min_length, repeats * q) and not any(all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_rest(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def looping_texts(r, count):
    out = []
    for _ in range(count):
        w = [r.choice("abcd"[:r.randint(1, 4)]) for _ in range(r.randint(0, 60))]
        if w and r.random() < 0.6:
            a, p = r.randrange(len(w)), r.randint(1, 8)
            w = [w[i if i < a else a + (i - a) % min(p, len(w) - a)] for i in range(len(w))]
            if r.random() < 0.5:
                w += [r.choice("abcd") for _ in range(r.randint(0, 20))] + w
        out.append(" ".join(w))
    return out


def test_runs_against_brute_force():
    texts = looping_texts(random.Random(3), 900)
    for (words, got), text in zip(runs.find_runs([t.encode() for t in texts]), texts, strict=True):
        want = plain_runs(text.split())
        assert got == want, text
        assert runs.collapsed(words, got).decode() == plain_rest(text.split(), want)


@pytest.mark.parametrize("min_length,repeats", [(2, 2), (4, 2), (9, 3), (6, 5)])
def test_other_thresholds(min_length, repeats):
    texts = looping_texts(random.Random(min_length), 250)
    for (_, got), text in zip(runs.find_runs([t.encode() for t in texts], min_length, repeats), texts, strict=True):
        assert got == plain_runs(text.split(), min_length, repeats), text


def test_suffix_order_and_repeats():
    r = random.Random(8)
    for _ in range(200):
        w = np.array([r.randrange(3) for _ in range(r.randint(1, 40))])
        order, lcp = runs.suffix_order(w, np.arange(len(w)))
        assert order.tolist() == sorted(range(len(w)), key=lambda k: w[k:].tolist())
        for k in range(1, len(w)):
            a, b = w[order[k - 1]:], w[order[k]:]
            n = min(len(a), len(b))
            same = a[:n] == b[:n]
            assert lcp[k] == (n if same.all() else int(same.argmin()))
        cut = r.randrange(len(w))
        text = (np.arange(len(w)) >= cut).astype(int)
        grams = [(text[k], tuple(w[k:k + 5])) if k + 5 <= len(w) and text[k] == text[k + 4] else None for k in range(len(w))]
        assert runs.repeated_starts(w, text, 5).tolist() == [k for k, g in enumerate(grams) if g and grams.count(g) > 1]


def test_positions_in_pieces():
    r = random.Random(1)
    values = r.sample(range(10**6), 5000)
    held, plain = runs.Positions(values[0]), [values[0]]
    for x in values[1:]:
        before, after = held.add(x)
        assert before == max((v for v in plain if v < x), default=-1) and after == min((v for v in plain if v > x), default=-1)
        plain.append(x)
    assert list(held) == sorted(plain) and held.size == len(plain) and len(held.pieces) > 2


def test_long_texts_take_their_time_once():
    began = time.time()
    for text, want in ((b"a " * 100_000, [(0, 100_000, 1)]), (b" ".join(b"w%d" % (k % 500) for k in range(50_000)), [(0, 50_000, 500)]),
                       (b" ".join(b"w%d" % k for k in range(50_000)), [])):
        assert next(runs.find_runs([text]))[1] == want
    assert time.time() - began < 30


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark).withColumn("runs", F.lit("mine")).withColumn("id", F.lit(1))
    got = runs.scan_runs(docs)
    assert got.columns == ["id", "n_words", "runs", "collapsed"]
    want = sorted(((r["doc_id"], len(WORD.findall(r["text"] or "")), " ".join(WORD.findall(r["text"] or ""))) for r in docs.collect()), key=str)
    assert sorted(((r["id"], r["n_words"], r["collapsed"]) for r in got.collect()), key=str) == want
    assert runs.scan_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        runs.scan_runs(docs, min_repeats=1)


def test_strongest_run_and_its_ties(spark):
    texts = ["a a a a a a x b c b c b c b c b c b c", "x a a a a a a y b b b b b b", "a b c", "a b a b a b a b c d c d c d c d"]
    got = {r["id"]: r["best"] for r in runs.scan_runs(documents(spark, texts)).select("id", runs.strongest_run().alias("best")).collect()}
    assert [tuple(got[k]) if got[k] else None for k in range(4)] == [(0, 6, 1), (1, 6, 1), None, (0, 8, 2)]


def test_query_on_the_smoke_table(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    some = 0
    for r in op12_periodic_runs(spark, d).collect():
        w = WORD.findall(docs[r["doc_id"]] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            a, p = h // 10 % len(w), 1 + (len(w) - h // 10 % len(w)) // (3 + h // 10 % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
        if len(w) > 1500:  # the plain version takes their square
            continue
        found = plain_runs(w)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        some += len(found)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_rest(w, found).encode()).hexdigest()
    assert some > 10
