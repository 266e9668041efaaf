import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from episcope.llm import minhash
from episcope.llm.queries import op11_minhash_dedup
from tests.llm.helpers import SCHEMA, documents, odd_documents, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k:k + n]) for k in range(max(len(w) - n, 0) + 1)} if w else set()


def brute(pairs, n=5, percent=80):
    """``(id, set size, smallest id reachable)`` over all pairs."""
    sets = [plain_set(t, n) for _, t in pairs]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[root(i)] = root(j)
    low = {}
    for k, (doc_id, _) in enumerate(pairs):
        if doc_id is not None:
            low[root(k)] = min(low.get(root(k), doc_id), doc_id)
    return sorted(((d, len(s), low.get(root(k)) if s else d) for k, ((d, _), s) in enumerate(zip(pairs, sets, strict=True))), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("id", "n_shingles", "component_id").collect()), key=str)


def edited(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def test_sets_against_a_plain_version():
    r = random.Random(1)
    parts = ["a", "B", "é", "É", "c", "\x1c", "\xa0"]
    texts = [r.choice(["", " ", "\x0b"]).join(r.choice(parts) + r.choice(["", " ", "\n\t"]) for _ in range(r.randint(0, 30))) for _ in range(400)]
    for n in (1, 2, 5):
        seen = {}
        for text, got in zip(texts, minhash.shingle_sets([t.encode() for t in texts], n), strict=True):
            want = plain_set(text, n)
            assert len(got) == len(want)
            if len(want) == 1:  # equal hashes for equal shingles only
                assert seen.setdefault(int(got[0]), want) == want


def test_signatures_estimate_similarity():
    r = random.Random(2)
    base = prose(3, 1000, 5000)
    sets = minhash.shingle_sets([base.encode(), edited(r, base, 30).encode()], 2)
    a, b = minhash.minima(sets, 512)
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs((a == b).mean() - true) < 0.08
    one, two = minhash.band_keys(np.stack([a, b]), 4)
    assert ((one == two) == (a == b).reshape(-1, 4).all(axis=1)).all()


@pytest.mark.parametrize("block,block_shingles", [(minhash.BLOCK, minhash.BLOCK_SHINGLES), (4, 700)])
def test_groups_against_brute_force(spark, monkeypatch, block, block_shingles):
    r = random.Random(5)
    texts = [prose(k, 60 + 7 * k, 2000) for k in range(14)]
    for k in range(8):  # copies at all distances, about the threshold too
        texts += [edited(r, texts[k], n) for n in (0, 1, 2, 3, 4, 6)]
    chain = prose(50, 120, 2000)
    for _ in range(12):  # ends of the chain are far apart
        chain = edited(r, chain, 4)
        texts.append(chain)
    texts += [texts[0]] * 20 + ["", None, " ", "few words", "Few  words", "few"]
    r.shuffle(texts)
    pairs = [(k + 1, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(minhash.candidate_links, "__defaults__", (minhash.LEAST_AGREEING, block))
    monkeypatch.setattr(minhash.confirmed_links, "__defaults__", (block_shingles,))
    docs = documents(spark, texts, [k for k, _ in pairs]).repartition(5)
    got = minhash.near_duplicates(docs, shingle=2)
    assert found(got) == brute(pairs, 2)
    kept = minhash.keep_one_of_each(docs, shingle=2)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({x["component_id"] for x in got.collect()})


def test_blocks_compare_across_only():
    near = lambda a, others: (others % 3) == (a % 3)
    whole = minhash.spanning_links(9, np.zeros(9), near)
    assert len(whole) == 6 and all(a % 3 == b % 3 for a, b in whole)
    side = np.array([0, 0, 0, 0, 1, 1, 1, 1, 1])
    assert all(side[a] != side[b] for a, b in minhash.spanning_links(9, side, near))


def test_links_stay_linear_in_a_dense_group(spark):
    r = random.Random(9)
    base = prose(4, 300, 3000)
    texts = [edited(r, base, 3) for _ in range(300)]
    table = minhash.with_signatures(documents(spark, texts), "doc_id", "text", 2, minhash.MINIMA, minhash.BAND)
    classes = table.select(F.col("id").alias("class"), "keys", "signature")
    assert minhash.candidate_links(classes).count() < 40 * len(texts)


def test_stars_against_union_find(spark):
    r = random.Random(4)
    for n, m in ((200, 150), (60, 59), (40, 0)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] if n != 60 else [(k, k + 1) for k in range(m)]
        low = list(range(n))
        for _ in range(n):
            for a, b in edges:
                low[a] = low[b] = min(low[a], low[b])
        got = {x["node"]: x["root"] for x in minhash.star_components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
        assert all(got.get(k, k) == low[k] for k in range(n))


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark).withColumn("n_shingles", F.lit("mine")).withColumn("class", F.lit(1))
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(minhash.near_duplicates(docs)) == brute(pairs)
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    # Rows without words all stay; of equal texts and of repeated rows one does.
    assert rows(kept, "doc_id") == sorted([(1,), (2,), (3,), (4,), (5,), (6,), (7,), (8,), (10,), (11,), (None,), (None,)],
                                          key=lambda r: [(x is not None, str(x)) for x in r])
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one_of_each(empty).count() == 0


def test_query_on_the_smoke_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = op11_minhash_dedup(spark, d)
    assert found(got.withColumnRenamed("doc_id", "id")) == brute(docs, 2)
    assert got.where("kept != (doc_id = component_id)").count() == 0
