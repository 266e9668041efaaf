import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from episcope.llm import exact_dedup
from tests.llm.helpers import SCHEMA, documents, odd_documents, prose, rows

SMALL = exact_dedup.Chunking(least=32, mean_bits=4, most=96)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=6))
def test_chunks_join_to_the_text_and_do_not_depend_on_neighbours(texts):
    for text, chunks in zip(texts, exact_dedup.cut(texts, SMALL), strict=True):
        assert b"".join(chunks) == text
        assert all(len(c) <= SMALL.most for c in chunks)
        assert [chunks] == exact_dedup.cut([text], SMALL)


def test_cuts_follow_the_content():
    body = prose(1, 3000).encode()
    whole, shifted = exact_dedup.cut([body, b"some new words before it " + body], SMALL)
    assert len(set(whole) & set(shifted)) > 0.8 * len(set(whole))


def brute(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("p", [exact_dedup.Chunking(), SMALL, exact_dedup.Chunking(32, 4, 96, digest_bytes=1)])
def test_groups_against_brute_force_also_with_colliding_digests(spark, p):
    """One-byte digests collide all the time; contents still decide."""
    r = random.Random(3)
    texts = [prose(k % 40, 10 + k % 40 * 7) for k in range(120)] + ["", None, "é", "é", "é"]
    r.shuffle(texts)
    docs = documents(spark, texts).repartition(4)
    assert exact_dedup.collided_chunks(docs, "text", p) != {} or p.digest_bytes > 1
    got = exact_dedup.exact_duplicates(docs, p=p)
    assert sorted(map(tuple, got.collect()), key=str) == brute(enumerate(texts))


def test_many_collisions_lengthen_the_digest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_COLLIDED", 20)
    texts = [prose(k % 60, 200) for k in range(90)]
    docs, p = documents(spark, texts), exact_dedup.Chunking(32, 4, 96, digest_bytes=1)
    assert exact_dedup.collided_chunks(docs, "text", p) is None
    longer, collided = exact_dedup.verified_chunking(docs, "text", p)
    assert longer.digest_bytes in (2, 4) and len(collided) <= 20
    got = exact_dedup.exact_duplicates(docs, p=p)
    assert sorted(map(tuple, got.collect()), key=str) == brute(enumerate(texts))


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    got = sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=str)
    assert got == brute((r["doc_id"], r["text"]) for r in docs.collect())
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_null_ids(spark):
    got = exact_dedup.exact_duplicates(documents(spark, ["a", "a", "b"], [None] * 3))
    assert rows(got, "id", "keep_id", "group_size", "kept") == sorted([(None, None, 2, True), (None, None, 2, False), (None, None, 1, True)], key=lambda r: [(x is not None, str(x)) for x in r])
