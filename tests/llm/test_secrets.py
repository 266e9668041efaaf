import hashlib
import random
import re

from episcope.llm import secrets
from episcope.llm.queries import op2_secret_scan
from tests.llm.helpers import SCHEMA, documents, odd_documents

SCAN = secrets.NoveltyScan().scanner()
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_spans(text):
    """The fixed patterns, plainly."""
    assign = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "to\u212aen", "\u017fecret", '"', "'", " ", "  ", ":", "=", " = ", "AKIA",
             "AKIAABCDEFGH", "ABCD0123", "0123456789abcdef", "abcdefgh", "short", "é", "\n", "x.y-z", "+/="]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert secrets.base_spans(text) == plain_spans(text), text


def test_consumed_matches_are_dropped_not_retried():
    # The first match takes ``secret`` as its value, too short, and the search goes on behind it.
    assert secrets.base_spans("token=secret:abcdefgh") == plain_spans("token=secret:abcdefgh") == []
    assert secrets.base_spans("token = abc") == []


def test_novelty_reports_random_strings_in_sensitive_contexts():
    r = random.Random(3)
    key = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    text = f'client.login(auth, "{key}")'
    at = text.index(key)
    assert SCAN(text, []) == [(at, at + 40)]
    assert SCAN(text, [(at + 3, at + 9)]) == []  # already a base span
    assert SCAN(f"the {key} of things", []) == []  # no sensitive word near
    # Identifiers of the dictionary and repeats of the surroundings add little.
    assert SCAN("private key configuration_configuration2configuration", []) == []
    assert SCAN(f"# {key}\nsecret is {key}\n", []) == []


def novel_spans(spark, *texts):
    found = secrets.scan_secrets(documents(spark, texts)).orderBy("doc_id").collect()
    return [[tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("novel")] for r in found]


def test_a_key_that_stands_again_nearby_is_found_at_every_sensitive_place(spark):
    r = random.Random(3)
    key = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    texts = [f'login("{key}")\nsigned with private "{key}"\n', f"# {key}\nprivate is {key}\n", f"private auth={key}\nprivate session={key}\n"]
    # Copies that the end of the context cuts in two, on either side.
    texts += [f'login("{key}") {"word " * n} login("{key}")' for n in (41, 43, 45, 47, 50)]
    # The name before the = belongs to the third text's candidates.
    names = [("", ""), ("", ""), ("auth=", "session=")] + [("", "")] * 5
    expected = []
    for text, own in zip(texts, names, strict=True):
        spans = [(m.start() - len(n), m.end()) for m, n in zip(re.finditer(key, text), own, strict=True)]
        expected.append(spans[1:] if text.startswith("#") else spans)
    assert novel_spans(spark, *texts) == expected


def test_the_compressed_bytes_decide_not_the_kinds_of_character(spark):
    r = random.Random(4)
    upper, digits = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=40)), "".join(r.choices("0123456789", k=40))
    texts = [f"private key {upper}", f"private key {digits}", "private key " + "=" * 60, "private key configuration_configuration_configuration"]
    # A random digit holds 0.42 bytes, less than min_novelty.
    assert novel_spans(spark, *texts) == [[(12, 52)], [], [], []]


def test_odd_rows_and_clashing_columns(spark):
    docs = odd_documents(spark).withColumnRenamed("lang", "spans")
    out = secrets.scan_secrets(docs)
    assert out.columns == ["doc_id", "source", "n_chars", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
    assert out.count() == docs.count()
    assert {r["base_sha256"] for r in out.where("doc_id <= 4").collect()} == {EMPTY}
    assert secrets.scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text_is_scanned_to_its_end(spark):
    text = "a word " * 40_000 + "token = 0123456789abcdef0123456789abcdef"
    r = secrets.scan_secrets(documents(spark, [text])).first()
    at = 280_000
    assert r["spans"] == f"assign:{at}:{at + 40},hex:{at + 8}:{at + 40}" and (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 0, 1)
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()


def test_query_equals_plain_patterns_on_the_whole_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = op2_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(docs)
    for r in found:
        spans = plain_spans(docs[r["doc_id"]])
        named = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("novel")] == named
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == k for s in spans) for k in range(3)]
