import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from episcope.llm import simhash
from tests.llm.helpers import SCHEMA, documents, odd_documents, prose, rows


def plain_fingerprint(text, n=4):
    words = []
    for ch in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""):
        if ch in " \t\n\x0b\x0c\r":
            words.append("")
        else:
            words = words or [""]
            words[-1] += ch
    words = [w for w in words if w]
    shingles = [" ".join(words[k:k + n]) for k in range(max(len(words) - n, 0) + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, max_bits=4):
    """Labels of connected components over all pairs."""
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (low == label).all():
            return label
        label = low


def test_fingerprints_against_a_plain_version():
    r = random.Random(1)
    parts = ["a", "B", "é", "É", " ", "  ", "\n", "\x0b", "\x0c", "\r", "\x1c", "\xa0", " ", "word", "the"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert simhash.fingerprint(text.encode(), 4) == plain_fingerprint(text), repr(text)
    assert simhash.fingerprint(b"", 4) == simhash.fingerprint(b" \n", 4) == 0
    long = prose(1, 70_000)
    assert simhash.fingerprint(long.encode(), 4) == plain_fingerprint(long)


def clustered(r, n_groups, size, spread):
    """Fingerprints in groups around centres, each at most ``spread`` bits away."""
    out = []
    for _ in range(n_groups):
        centre = r.getrandbits(64)
        for _ in range(size):
            fp = centre
            for b in r.sample(range(64), r.randint(0, spread)):
                fp ^= 1 << b
            out.append(fp)
    return out


@pytest.mark.parametrize("max_bits,block", [(4, 2048), (4, 8), (2, 8), (6, 2048)])
def test_components_lose_no_link(spark, max_bits, block):
    r = random.Random(max_bits * 100 + block)
    # Chains: each a few bits from the one before, so the ends are far apart.
    fps = clustered(r, 12, 6, 5) + clustered(r, 1, 150, 3) + [r.getrandbits(64) for _ in range(200)]
    for _ in range(3):
        fp = r.getrandbits(64)
        for _ in range(20):
            for b in r.sample(range(64), max_bits):
                fp ^= 1 << b
            fps.append(fp)
    fps = sorted(set(fps))
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    table = spark.createDataFrame([(fp,) for fp in signed], "fp LONG").repartition(4)
    found = simhash.connected_components(simhash.links(table, max_bits, block)).collect()
    root = {r["node"]: r["root"] for r in found}
    want = plain_components(fps, max_bits)
    groups = {}
    for fp, label in zip(signed, want, strict=True):
        groups.setdefault(label, set()).add(root.get(fp, fp))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_links_stay_linear_in_a_dense_group(spark):
    r = random.Random(9)
    fps = sorted(set(clustered(r, 1, 600, 2)))
    table = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps], "fp LONG")
    assert simhash.links(table, 4).count() < 70 * len(fps)


def test_tables_of_the_documents_are_not_broadcast(spark, monkeypatch):
    """Spark sizes exploded postings like the fingerprints before, 70 times too low, and files as they are packed."""
    plans, write = {}, simhash.written

    def noted(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    docs = documents(spark, [prose(k % 15, 60) for k in range(20)])
    out, kept = simhash.near_duplicates(docs), simhash.keep_one_of_each(docs)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    # The first edges are the links of the index.
    ends = [df._jdf.queryExecution().executedPlan().toString() for df in (out, kept)]
    for plan in (plans["edges"], plans["placed"], plans["components"], plans["keepers"], *ends):
        assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan


def brute(docs, max_bits=4):
    fps = [plain_fingerprint(t) for _, t in docs]
    label = plain_components(fps, max_bits)
    low = {}
    for (doc_id, _), k in zip(docs, label, strict=True):
        if doc_id is not None:
            low[k] = min(low.get(k, doc_id), doc_id)
    return sorted(((d, f"{fp:016x}", low.get(k)) for (d, _), fp, k in zip(docs, fps, label, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()), key=str)


def test_documents_against_brute_force(spark):
    base = [prose(k, 120 + k) for k in range(25)]
    r = random.Random(3)
    texts = list(base)
    for text in base[:12]:
        for _ in range(3):
            words = text.split()
            words[r.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += [base[0]] * 30 + ["", None, " ", "short", "Short", "three words here"]
    docs = documents(spark, texts).repartition(5)
    got = simhash.near_duplicates(docs)
    assert found(got) == brute(list(enumerate(texts)))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in got.collect()})


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark).withColumn("_row_hash", F.lit("mine")).withColumn("fp", F.lit(1)).drop("_row_hash")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == brute(pairs)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = rows(kept, "doc_id")
    # One of the blank texts, one of each pair of equal texts, and both rows without an id.
    assert ids == sorted([(1,), (4,), (5,), (6,), (7,), (8,), (10,), (11,), (None,), (None,)], key=lambda r: [(x is not None, str(x)) for x in r])
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0


def test_smoke_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(simhash.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_bounds():
    with pytest.raises(ValueError):
        simhash.links(None, 8)
