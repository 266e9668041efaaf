
import os
import re

from pyspark.sql import functions as F

import corpus_pipeline
from episcope.llm import common, mixing
from episcope.llm.queries import SOURCE_WEIGHTS
from tests.llm import test_decontaminate, test_mixing, test_simhash, test_tokens
from tests.llm.helpers import odd_documents, rows

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on its predecessor's result, next to a plain version of it."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        path = str(tmp_path / str(len(results)))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        results.append([r.asDict() for r in docs.collect()])
        if len(results) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    known, apart, clean, mixed, tokens = results
    assert len(known) == 200  # every text of the table is in a language

    labels = test_simhash.plain_components([test_simhash.plain_fingerprint(d["text"]) for d in known])
    low = {}
    for d, k in zip(known, labels, strict=True):
        low[k] = min(low.get(k, d["doc_id"]), d["doc_id"])
    assert sorted(d["doc_id"] for d in apart) == sorted(low.values()) and len(apart) < len(known)

    hits = test_decontaminate.brute([d["text"] for d in apart], items)
    assert sorted(d["doc_id"] for d in clean) == sorted(d["doc_id"] for d, h in zip(apart, hits, strict=True) if not h[1])
    assert 0.5 * len(apart) < len(clean) < len(apart)

    sizes = {}
    for d in clean:
        pool = d["source"] if d["source"] in SOURCE_WEIGHTS else "rest"
        sizes[pool] = sizes.get(pool, 0) + len((d["text"] or "").encode())
    weight = sum(w for p, w in SOURCE_WEIGHTS.items() if sizes.get(p))
    want = []
    for d in clean:
        pool = d["source"] if d["source"] in SOURCE_WEIGHTS else "rest"
        rate = SOURCE_WEIGHTS[pool] / weight * sum(sizes.values()) / sizes[pool]
        u = spark.range(1).select(mixing.hashed_uniform("mix", F.lit(d["doc_id"]))).first()[0]
        want += [d["doc_id"]] * test_mixing.quantile(u, rate)
    assert sorted(d["doc_id"] for d in mixed) == sorted(want)

    expected = test_tokens.expected([(d["doc_id"], d["text"]) for d in mixed], 0)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == expected


def test_run_gives_the_last_stage_and_leaves_nothing_else(spark, monkeypatch):
    made = []
    noted = common._noted
    monkeypatch.setattr(common, "_noted", lambda path: made.append(path) or noted(path))
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    left = [p for p in made if os.path.exists(re.sub("^file:/*", "/", p))]
    assert len(made) > 10 and len(left) == 1 and "pipeline-4" in left[0]


CLASHING = ("score", "lang_pred", "copy", "row", "id", "key", "fp", "row_hash", "hits", "w", "place", "a.b", "doc_id.x", "class")


def test_columns_of_any_name_keep_their_content(spark):
    """Every stage hands on what it got, under names of the operators' own columns and names with dots."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    content = lambda c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string"))
    docs = docs.select("*", *[content(c).alias(c) for c in CLASHING])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == f"{c}-{r['doc_id']}" for r in found for c in CLASHING)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == docs.count()


def test_stages_on_odd_and_empty_documents(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DIR)
            assert k == 4 or out.columns == docs.columns
            out.count()


def test_language_stage_rejects_texts_without_a_language(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    odd = docs.limit(3).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("12 34 ...")))
    kept = corpus_pipeline.STAGES[0][1](spark, docs.union(odd.withColumn("doc_id", F.col("doc_id") + 10_000)), DIR)
    assert rows(kept, "doc_id") == rows(docs, "doc_id")
