import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from episcope.llm import dac, encoding, token_counts, token_files
from episcope.llm.common import shared_folder
from episcope.llm.encoding import TextEncoder, read_tokenizer
from episcope.llm.queries import END_OF_TEXT, op6_token_output, op8_token_counts, tokenizer_path
from tests.llm.helpers import SCHEMA, documents, odd_documents, prose, rows

VOCABULARY = read_tokenizer(tokenizer_path())
LIBRARY = Tokenizer.from_str(VOCABULARY)
ENCODERS = {special: TextEncoder(VOCABULARY, special) for special in (False, True)}


def library(texts, special_as_text=False):
    LIBRARY.encode_special_tokens = special_as_text
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def own(texts, special_as_text=False):
    flat, counts = ENCODERS[special_as_text].encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if len(texts) else []


PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", "a", "B.", "foo's", "'ll", "é", "ß!", "12", ".", "...", "日本", "🎉", "<|endoftext|>",
         "́", "²", "Ɤ.", "_", "-x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), max_size=6), st.booleans())
def test_words_encode_like_the_whole_text(texts, special):
    assert own(texts, special) == library(texts, special)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_any_text_encodes_like_the_whole_text(texts):
    assert own(texts) == library(texts)


def test_other_vocabularies_get_whole_texts():
    """Normalizers, prefix spaces and other splitters change ids across words; white space in added tokens, too."""
    import json

    import public_tokenizers

    made = json.loads(VOCABULARY)
    others = [read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))]
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": made["pre_tokenizer"] | {"add_prefix_space": True}},
                   {"added_tokens": [*made["added_tokens"], made["added_tokens"][0] | {"id": 50257, "content": "two words", "special": False}]}):
        others.append(json.dumps(made | change))
    texts = ["two words AND Two  words", "", "don't\nstop <|endoftext|> x", prose(1, 50)]
    assert encoding.splits_at_spaces(VOCABULARY)
    for other in others:
        assert not encoding.splits_at_spaces(other)
        flat, counts = TextEncoder(other, False).encode(texts)
        want = [e.ids for e in Tokenizer.from_str(other).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want


def test_a_full_cache_keeps_its_words_until_other_texts_come(monkeypatch):
    monkeypatch.setattr("episcope.llm.encoding.MAX_WORDS", 20)
    texts = [" ".join(random.Random(k).choices([f"w{i}" for i in range(60)], [60 - i for i in range(60)], k=40)) for k in range(30)]
    texts += [" ".join(random.Random(k).choices([f"other{i}" for i in range(30)], k=40)) for k in range(30)]
    e, sizes = TextEncoder(VOCABULARY, False), []
    for t, want in zip(texts, library(texts), strict=True):
        assert e.encode([t])[0].tolist() == want
        sizes.append(len(e._known))
    assert max(sizes) < 60 and len({n for n in sizes if n >= 20}) < len(sizes) / 2 and "other1" in e._known


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40), max_size=8), st.data())
def test_shards_give_back_every_token(docs, data):
    ids = np.array([i for d in docs for i in d], np.uint32)
    names = data.draw(st.lists(st.one_of(st.none(), st.integers(-2**63, 2**63 - 1)), min_size=len(docs), max_size=len(docs)))
    shard = dac.ShardReader(dac.encode_shard(names, ids, np.array([len(d) for d in docs], np.int64)))
    assert shard.doc_ids == names and shard.doc_ends.tolist() == np.cumsum([len(d) for d in docs]).astype(int).tolist()
    assert [shard.token(i) for i in range(len(ids))] == ids.tolist()
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert shard.tokens(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        shard.token(len(ids))


def test_rank_over_many_blocks():
    ids = np.random.default_rng(0).integers(0, 70_000, 5000).astype(np.uint32)
    shard = dac.ShardReader(dac.encode_shard([1], ids, np.array([5000])))
    assert all(shard.token(i) == ids[i] for i in range(5000))
    for a, b in [(0, 5000), (511, 513), (512, 1024), (4999, 5000), (5000, 5000)]:
        assert (shard.tokens(a, b) == ids[a:b]).all()


def expected(docs, end_id, special_as_text=False):
    """By the library, whole texts, in ascending id order: id, start, n_tokens, crc32."""
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out, start = [], 0
    for (doc_id, _), ids in zip(ordered, library([t for _, t in ordered], special_as_text), strict=True):
        ids = ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_output_query_against_the_library(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, op6_token_output(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected(docs, 0)


def test_counts_query_against_the_library(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(map(tuple, op8_token_counts(spark, d).collect()))
    assert got == [(x[0], x[2]) for x in expected(docs, END_OF_TEXT, True)]


def test_output_of_odd_rows_in_many_shards(spark):
    docs = odd_documents(spark).repartition(5)
    folder = shared_folder(spark, "test-shards")
    manifest = token_files.write_token_shards(docs, tokenizer_path(), folder, shard_tokens=50)
    assert manifest.count() > 4
    got = token_files.read_token_shards(spark, folder, manifest).collect()
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()], 0)
    # Rows of one id stand together; which comes first among them is not by text order.
    assert sorted((str(r["id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(w[0]), *w[2:]) for w in want)
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.cumsum([0] + [r["n_tokens"] for r in by_start])[:-1].tolist()
    assert [r["id"] for r in by_start] == [w[0] for w in want]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = token_files.token_output(empty, tokenizer_path())
    assert out.columns == ["id", "start", "n_tokens", "ids_crc32"] and out.count() == 0
    out = token_counts.token_counts(empty, tokenizer_path(), END_OF_TEXT)
    assert out.columns == ["id", "doc_no", "start", "n_tokens"] and out.count() == 0


def test_one_id_on_many_rows_is_spread(spark):
    docs = documents(spark, ["same text"] * 4000, [7] * 4000).repartition(4)
    ordered = token_files.in_id_order(docs, "doc_id", "text")
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in ordered.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and (len(sizes) == 1 or max(sizes) < 3000)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separator_scan_against_a_plain_scan(spark, block):
    """Documents across blocks and files, empty documents, files without a separator, an open end."""
    r = random.Random(block)
    folder = shared_folder(spark, "test-flat")
    path = folder.removeprefix("file://").removeprefix("file:")
    import os

    os.makedirs(path)
    stream = []
    for k in range(9):
        ids = [r.choice([5, 6, 7, 0 if k not in (3, 4) else 5]) for _ in range(r.randint(0, 30))]
        np.array(ids, "<u4").tofile(f"{path}/{k:06d}-000000.tok")
        stream += ids
    want, start = [], 0
    for i, t in enumerate(stream):
        if t == 0:
            want.append((len(want), start, i + 1 - start, True))
            start = i + 1
    if start < len(stream):
        want.append((len(want), start, len(stream) - start, False))
    assert sorted(map(tuple, token_counts.separator_scan(spark, folder, 0, block, width=4).collect())) == want


def test_counts_of_odd_rows_with_files_cut_anywhere(spark):
    docs = odd_documents(spark).repartition(3)
    folder = shared_folder(spark, "test-cut")
    order = token_counts.write_flat_files(docs, tokenizer_path(), folder, END_OF_TEXT, width=4, file_tokens=17)
    scanned = {r["doc_no"]: (r["start"], r["n_tokens"]) for r in token_counts.separator_scan(spark, folder, END_OF_TEXT, 5, width=4).collect()}
    got = sorted((str(r["id"]), scanned[r["doc_no"]][1]) for r in token_counts.numbered(order).collect())
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()], END_OF_TEXT, True)
    assert got == sorted((str(x[0]), x[2]) for x in want) and sorted(scanned) == list(range(14))
    ends = sorted((a, a + n) for a, n in scanned.values())
    assert ends[0][0] == 0 and all(p[1] == q[0] for p, q in zip(ends, ends[1:]))


def test_ids_must_fit_their_width(spark):
    with pytest.raises(Exception, match="do not fit in 1 bytes"):
        token_counts.write_flat_files(documents(spark, ["some words"]), tokenizer_path(), shared_folder(spark, "narrow"), 0, width=1)
