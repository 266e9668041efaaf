import random
import re
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from episcope.llm import licenses
from tests.llm.helpers import SCHEMA, documents, odd_documents, prose, rows

P = licenses.LicenseScan()
MATCHER = licenses.Matcher(licenses.TEMPLATES, P)


def lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return int(best[-1, -1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_patience_is_a_common_subsequence(a, b):
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= lcs(a, b)
    if set(a) & set(b):
        assert pairs


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=15), st.lists(st.integers(0, 5), min_size=1, max_size=15))
def test_gap_without_anchor_is_closed_by_the_longest_subsequence(a, b):
    assert len(licenses.common_subsequence(a, b, 0, len(a), 0, len(b))) == lcs(a, b)


def test_whole_templates_are_found_where_they_stand():
    for name, text in licenses.TEMPLATES.items():
        before = prose(3, 50)
        found = MATCHER.find(f"{before}. {text}\n{prose(4, 50)}")
        at = len(before) + 2
        words = list(re.finditer(r"[^\W_]+", text))
        assert [(a, b, n) for a, b, n, *_ in found] == [(at, at + words[-1].end(), name)], name
        assert found[0][3] == found[0][4] == len(words)


def test_every_template_is_told_from_its_relatives():
    """All templates, full texts too: each is named as itself."""
    every = licenses.all_templates()
    assert len(every) > 80 and {f"{n} full text" for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0",
                                                          "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0")} <= every.keys()
    matcher = licenses.Matcher(every, P)
    for name, text in every.items():
        found = matcher.find(f"{prose(3, 50)}. {text}\n{prose(4, 50)}")
        assert [(n, aligned == size) for *_, n, aligned, size in found] == [(name, True)], name


def test_near_relatives_by_their_own_words(spark):
    clause = "3. Neither the name of Foo Inc nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    bsd = licenses.TEMPLATES["BSD-2-Clause text"]
    texts = {
        "GPL-2.0 header": licenses.TEMPLATES["GPL-3.0 header"].replace("version 3", "version 2"),
        "GPL-3.0 header": licenses.TEMPLATES["GPL-3.0 header"],
        "BSD-2-Clause text": bsd.replace("COPYRIGHT HOLDERS", "REGENTS"),
        "BSD-3-Clause text": bsd.replace("THIS SOFTWARE IS", clause + " THIS SOFTWARE IS", 1),
        "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
        "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0",
        "CC-BY-3.0 notice": "Licensed under CC BY 3.0.",
        "Apache-2.0 full text": licenses.all_templates()["Apache-2.0 full text"].split("END OF TERMS")[0],
    }
    found = licenses.scan_licenses(documents(spark, list(texts.values()))).orderBy("doc_id").collect()
    assert [[m["license"] for m in r["matches"]] for r in found] == [[n] for n in texts]


def test_a_license_needs_the_words_that_name_it():
    for text in ("Released under the BSD License.", "This page was released under the old license", "Licensed under the European Public License, Version 2.0",
                 "Educational Community License, Version 2.0", "Licensed under the Apache License, Version 2.1",
                 "This work is licensed under the GNU General Public License, version 4", "Licensed under CC BY-XX 4.1"):
        assert MATCHER.find(text) == [], text
    for text, name in (("Licensed under the Apache License, Version 2.0", "Apache-2.0 notice"), ("It is released under the MIT license", "MIT notice"),
                       ("work is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0 notice"), ("Licensed under CC BY-NC-ND 2.5", "CC-BY-NC-ND-2.5 notice")):
        assert [m[2] for m in MATCHER.find(text)] == [name], text
    for name, text in licenses.TEMPLATES.items():  # the words named are in the template, and it accepts itself
        words = Counter(w.lower() for w in re.findall(r"[^\W_]+", text))
        assert not Counter(licenses.name_words(name)) - words, name


def test_full_texts_one_behind_the_other():
    every = licenses.all_templates()
    full = sorted(n for n in every if n.endswith("full text"))
    matcher = licenses.Matcher(every, P)
    r = random.Random(1)
    pairs = [(a, b) for a in full for b in full if a[:4] == b[:4] or {a[:3], b[:3]} <= {"GPL", "LGP", "AGP"}]
    pairs += [tuple(r.sample(full, 2)) for _ in range(20)]
    for a, b in pairs:
        found = matcher.find(f"{every[a]}\n{every[b]}")
        assert [(n, aligned == size) for *_, n, aligned, size in found] == [(a, True), (b, True)], (a, b)


def test_cost_stays_linear():
    every = licenses.all_templates()
    matcher = licenses.Matcher(every, P)
    full = sorted(n for n in every if n.endswith("full text"))
    joined, names, r = [], [], random.Random(2)
    while sum(len(every[n].split()) for n in names) < 50_000:
        names.append(r.choice(full))
        joined += [every[names[-1]], prose(len(names), 30)]
    began = time.time()
    assert [m[2] for m in matcher.find("\n".join(joined))] == names
    assert time.time() - began < 60
    for name in ("GPL-3.0 full text", "Apache-2.0 full text"):  # the same words in no order
        words = every[name].split()
        r.shuffle(words)
        began = time.time()
        assert name not in [m[2] for m in matcher.find(" ".join(words))]
        assert time.time() - began < 20


def test_long_texts_with_changes_keep_their_span():
    every = licenses.all_templates()
    matcher = licenses.Matcher(every, P)
    r = random.Random(3)
    for name in ("GPL-2.0 full text", "MPL-2.0 full text", "MIT text"):
        words = every[name].split()
        for k in range(len(words) // 15):
            words[r.randrange(2, len(words) - 2)] = f"other{k}"
        before = prose(8, 400)
        text = f"{before} {' '.join(words)} {prose(9, 400)}"
        (start, end, found, aligned, size), = matcher.find(text)
        assert found == name and 0.85 * size < aligned < size
        assert start == len(before) + 1 and abs(end - (len(before) + 1 + len(" ".join(words)))) <= 1


def test_repeated_and_reworded_notices():
    notice = "Released under the MIT License."
    found = MATCHER.find(" ".join([notice] * 3))
    assert [f[2] for f in found] == ["MIT notice"] * 3
    # One word of twelve replaced, two added: still the same license.
    found = MATCHER.find("This whole work is hereby licensed under the GNU General Public License, release 3.")
    assert [f[2] for f in found] == ["GPL-3.0 notice"] and found[0][3] == 11
    assert MATCHER.find("Some text under the general license of the public.") == []
    assert MATCHER.find("THE the The under released mit") == []


def brute(text):
    """Every window of every template's width, by longest common subsequence."""
    words = [w.lower() for w in re.findall(r"[^\W_]+", text)]
    out = set()
    for t in MATCHER.templates:
        ids = [MATCHER.vocabulary.get(w, -1) for w in words]
        if any(lcs(t.words, ids[k:k + t.width]) >= t.need and not t.naming - Counter(ids[k:k + t.width]) for k in range(len(ids))):
            out.add(t.name)
    return out


def test_a_text_has_a_license_exactly_when_some_window_covers_a_template():
    r = random.Random(5)
    short = {n: t for n, t in licenses.TEMPLATES.items() if len(t) < 120}
    for k in range(30):
        words = prose(k, 15).split()
        for name in r.sample(sorted(short), 1 + k % 2):
            notice = short[name].split()
            for _ in range(r.randint(0, 2)):
                notice[r.randrange(len(notice))] = r.choice(["other", "the", "license"])
            at = r.randrange(len(words))
            words[at:at] = notice
        text = " ".join(words)
        assert bool(MATCHER.find(text)) == bool(brute(text)), text
        assert {f[2] for f in MATCHER.find(text)} <= brute(text)


def test_length_changing_lower_case_keeps_positions():
    text = "İİİ Released under the MIT License İ"
    assert [(text[a:b]) for a, b, *_ in MATCHER.find(text)] == ["Released under the MIT License"]


def test_odd_rows_and_clashing_columns(spark):
    docs = odd_documents(spark).withColumnRenamed("lang", "matches")
    out = licenses.scan_licenses(docs)
    assert out.columns == ["doc_id", "source", "n_chars", "matches"]
    assert out.count() == docs.count() and not out.where("size(matches) > 0").count()
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_smoke_table_lines(spark):
    """On the test table every planted notice line is found, and nothing else."""
    from episcope.llm.queries import op1_license_scan

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    notice = re.compile(r"This work is licensed under the GNU General Public License, version 3|Licensed under CC BY-NC 4\.0"
                        r"|Released under the MIT License|Licensed under the Apache License, Version 2\.0")
    found = {r["doc_id"]: r["n_licenses"] for r in op1_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert found.keys() == docs.keys()
    assert {d for d, n in found.items() if n} >= {d for d, t in docs.items() if notice.search(t)}
    assert all(n >= len(notice.findall(docs[d])) for d, n in found.items())
