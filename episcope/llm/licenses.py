"""License scans by patience alignment of documents with license templates.

Stretches of a text that may hold a template are aligned with it: words that are unique on
both sides anchor the alignment, the longest increasing run of anchors is kept, and the
gaps between them are aligned the same way. The share of the template's words that find a
partner is its coverage. The words that name a license and its version must be among them.

Where to align: for a notice, every window that holds enough of its words, but for those that
cannot pass after the last one failed. For a long template, where the words that stand in
it once lie on nearly the same diagonal of text and template; each such word is used in
one alignment at most, so the cost is linear in the text for every template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from episcope.llm.common import unused_name

# License notices, headers and short license texts, by SPDX identifier and kind.
_CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
_CC = [f"BY{k}" for k in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND")]
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_NAMES = {f"{k}-{v}": (_GNU[k], v.removesuffix(".0")) for k, v in (
    ("GPL", "1.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))}
_GNU_NAMES["LGPL-2.0"] = ("GNU Library General Public License", "2")


def _gnu_header(license: str, version: str, later: bool) -> str:
    of = (f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version"
          if later else f"version {version} as published by the Free Software Foundation")
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the {license} {of}. This program is "
            "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
            f"FITNESS FOR A PARTICULAR PURPOSE. See the {license} for more details.")


_BSD_3_CLAUSE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES = {
    f"CC-{k}-{v} notice": f"Licensed under CC {k} {v}." for k in _CC for v in _CC_VERSIONS
} | {
    f"CC-{k}-{v} long notice": f"This work is licensed under a Creative Commons {'-'.join(_CC_PARTS[x] for x in k.split('-'))} {v} {area} License."
    for k in _CC for v, area in _CC_VERSIONS.items()
} | {
    f"{n} notice": f"This work is licensed under the {license}, version {v}." for n, (license, v) in _GNU_NAMES.items()
} | {
    f"{n} header": _gnu_header(license, v, True) for n, (license, v) in _GNU_NAMES.items()
} | {
    f"{n}-only header": _gnu_header(license, v, False) for n, (license, v) in _GNU_NAMES.items()
} | {
    "CC0-1.0 notice": "Licensed under CC0 1.0 Universal.",
    "CC0-1.0 long notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "MPL-1.1 header": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the "
        "License is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific "
        "language governing rights and limitations under the License."),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 long notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 long notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 long notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."),
    "MIT notice": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}
TEMPLATES["BSD-3-Clause text"] = TEMPLATES["BSD-2-Clause text"].replace(" THIS SOFTWARE", _BSD_3_CLAUSE + " THIS SOFTWARE", 1)


def all_templates() -> dict[str, str]:
    """``TEMPLATES`` and the full texts of ``license_texts``; read on the driver."""
    folder = Path(__file__).parent / "license_texts"
    return TEMPLATES | {f"{f.stem} full text": f.read_text(encoding="utf-8") for f in sorted(folder.glob("*.txt"))}


_WORD = re.compile(r"[^\W_]+")
LONG = 60  # words; longer templates are looked for along diagonals
MAX_TABLE = 1 << 18  # cells of a table for a longest common subsequence; longer gaps are anchored by numbered words


def name_words(name: str) -> list[str]:
    """The words of a notice or header that name the license and its version, from the template's name; texts have none."""
    license, _, kind = name.partition(" ")
    family, version = license.removesuffix("-only").rpartition("-")[::2]
    numbers = version.split(".")
    if kind.endswith("text") or license == "CC0-1.0" and kind == "long notice":
        return []
    if family.startswith("CC-"):
        parts = family.split("-")[1:]
        return (["creative", "commons", *[_CC_PARTS[x].lower() for x in parts]] if kind == "long notice" else ["cc", *map(str.lower, parts)]) + numbers
    if license.removesuffix("-only") in _GNU_NAMES:
        words, short = _GNU_NAMES[license.removesuffix("-only")]
        return [*words.lower().split(), *short.split(".")]
    return {"MPL": ["mozilla", "public", *numbers], "Apache": ["apache", *numbers], "CC0": ["cc0", *numbers]}.get(family, [license.lower()] if license == "MIT" else [])


@dataclass(frozen=True)
class LicenseScan:
    """``min_coverage``: share of a template's words that must align; ``slack``: foreign words
    that a match may hold, as a share of the template's words (and two at least)."""

    min_coverage: float = 0.8
    slack: float = 0.5


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned positions of two word sequences, in ascending order on both sides.

    Equal ends are paired first. A gap with no word unique on both sides is closed by a
    longest common subsequence, so no gap is left for want of an anchor; a long one has its
    words numbered, which makes them unique.
    """
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen_a, seen_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if seen_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if seen_a[w] == 1 and w in place]
        if not anchors:
            if not seen_a.keys() & seen_b.keys():
                continue
            if (a1 - a0) * (b1 - b0) <= MAX_TABLE:
                pairs += common_subsequence(a, b, a0, a1, b0, b1)
                continue
            # The k-th of a word on one side stands for the k-th on the other.
            numbered, seen = {}, Counter()
            for j in range(b0, b1):
                numbered[b[j], seen[b[j]]] = j
                seen[b[j]] += 1
            seen = Counter()
            for i in range(a0, a1):
                if (a[i], seen[a[i]]) in numbered:
                    anchors.append((i, numbered[a[i], seen[a[i]]]))
                seen[a[i]] += 1
        run = increasing_run(anchors)
        pairs += run
        edges = [(a0 - 1, b0 - 1), *run, (a1, b1)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(pairs)


def increasing_run(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of anchors (ascending on the first side) that ascends on the second."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(anchors):
        pile = bisect_left(tops, j)
        before.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = j, k
    run, k = [], top_at[-1]
    while k >= 0:
        run.append(anchors[k])
        k = before[k]
    return run[::-1]


def common_subsequence(a: Sequence[int], b: Sequence[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Longest common subsequence of two short runs, as pairs of positions."""
    best = np.zeros((a1 - a0 + 1, b1 - b0 + 1), np.int32)
    right = np.asarray(b[b0:b1])
    for i in range(a1 - a0 - 1, -1, -1):
        equal = np.where(right == a[a0 + i], best[i + 1, 1:] + 1, 0)
        best[i, :-1] = np.maximum.accumulate(np.maximum(equal, best[i + 1, :-1])[::-1])[::-1]
    pairs, i, j = [], 0, 0
    while i < a1 - a0 and j < b1 - b0:
        if a[a0 + i] == b[b0 + j] and best[i, j] == best[i + 1, j + 1] + 1:
            pairs.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _score(m: tuple[int, int, str, int, int]) -> int:
    """Aligned words less the foreign words within a match and the template's words without a partner."""
    start, end, _, aligned, size = m
    return aligned - (end - start - aligned) - (size - aligned)


def _keep(found: list[tuple[int, int, str, int, int]], n: int) -> tuple[list[tuple[int, int, str, int, int]], np.ndarray]:
    """Of matches in ``n`` words the ones that stay (see ``Matcher.find``), and which words they hold."""
    taken, held = [], np.zeros(n, bool)
    for m in sorted(found, key=lambda m: (-_score(m), -m[3], m[0], m[2])):
        if not held[m[0]:m[1]].any():
            taken.append(m)
            held[m[0]:m[1]] = True
    return taken, held


def densest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretch of aligned pairs that holds the most of them for the text words that it spans: no stray words at its ends."""
    best, best_sum, total, first = (0, 0), 0, 0, 0
    for k, (_, j) in enumerate(pairs):
        total += 3 - (j - pairs[k - 1][1] if k > first else 1)
        if total <= 0:
            total, first = 0, k + 1
        elif total > best_sum:
            best, best_sum = (first, k + 1), total
    return pairs[best[0]:best[1]]


@dataclass(frozen=True)
class Template:
    name: str
    words: list[int]
    counts: Counter
    need: int  # words that must align
    width: int  # text words that a match may span
    naming: Counter  # words that must be among the aligned ones

    def accepts(self, pairs: list[tuple[int, int]]) -> bool:
        return (len(pairs) >= self.need and pairs[-1][1] - pairs[0][1] < self.width
                and not self.naming - Counter(self.words[i] for i, _ in pairs))


class Matcher:
    """Finds templates in texts; built once per task."""

    def __init__(self, templates: Mapping[str, str], p: LicenseScan):
        self.p, self.vocabulary = p, {}
        self.templates: list[Template] = []
        for name, text in sorted(templates.items()):
            words = [self.vocabulary.setdefault(w.lower(), len(self.vocabulary)) for w in _WORD.findall(text)]
            need = max(1, ceil(p.min_coverage * len(words) - 1e-9))
            slack = max(2, int(p.slack * len(words)))
            naming = Counter(self.vocabulary[w] for w in name_words(name) if w in self.vocabulary) & Counter(words)
            if words:
                self.templates.append(Template(name, words, Counter(words), need, len(words) + slack, naming))
        # By the words they need: a text can only hold those before the first that needs more than it has.
        self.templates.sort(key=lambda t: t.need)
        self.needs = np.array([t.need for t in self.templates], np.int64)
        # Distinct words and their numbers, all templates one after the other.
        self.bounds = np.cumsum([0] + [len(t.counts) for t in self.templates])
        self.words = np.array([w for t in self.templates for w in t.counts], np.int64)
        self.numbers = np.array([n for t in self.templates for n in t.counts.values()], np.int64)
        self.member = np.zeros((len(self.templates), len(self.vocabulary) + 1), bool)
        # Where the words that a long template holds once stand in it; -1 for all others.
        self.places = {}
        for t, x in enumerate(self.templates):
            self.member[t, x.words] = True
            if len(x.words) > LONG:
                self.places[t] = np.full(len(self.vocabulary) + 1, -1)
                once = [j for j, w in enumerate(x.words) if x.counts[w] == 1]
                self.places[t][[x.words[j] for j in once]] = once

    def find(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """``(start, end, template, aligned words, template words)`` of the matches, by start.

        Of matches that overlap, the one with the most aligned words stays, foreign words
        within it and words it lacks taken off; then the one with more aligned words, then
        the first by start and name.
        """
        low = text.lower()
        words = _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]
        ids = np.fromiter(map(self.vocabulary.get, words, [len(self.vocabulary)] * len(words)), np.int64, len(words))
        known = np.flatnonzero(ids < len(self.vocabulary))
        if not len(known):
            return []
        present = np.bincount(ids[known], minlength=len(self.vocabulary))
        found = []
        held = self.bounds[np.searchsorted(self.needs, len(known), side="right")]
        some = np.searchsorted(self.bounds, held)
        if not some:
            return []
        common = np.add.reduceat(np.minimum(self.numbers[:held], present[self.words[:held]]), self.bounds[:some])
        # Long templates first: no template can stay inside a match that scores more than its number of words.
        for t in sorted(np.flatnonzero(common >= self.needs[:some]).tolist(), key=lambda t: -len(self.templates[t].words)):
            template = self.templates[t]
            if any(present[w] < n for w, n in template.naming.items()):
                continue
            shut = _keep([m for m in found if _score(m) > len(template.words)], len(ids))[1]
            at = known[self.member[t, ids[known]]]
            spans = self._regions(ids, at, template, self.places[t], shut) if t in self.places else self._windows(ids, at, template, shut)
            found += [(a, b, template.name, n, len(template.words)) for a, b, n in spans]
        if not found:
            return []
        taken, _ = _keep(found, len(ids))
        spans = [m.span() for m in _WORD.finditer(text if len(low) != len(text) else low)]
        return sorted((spans[a][0], spans[b - 1][1], name, n, size) for a, b, name, n, size in taken)

    @staticmethod
    def _regions(ids: np.ndarray, at: np.ndarray, template: Template, places: np.ndarray, shut: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Word ranges that align with a long template, densest diagonals first, and their aligned words.

        A match lacks ``size - need`` words at most and moves on by at most ``width - size``
        foreign ones: its votes, text places less template places of words that stand in the
        template once, lie in a band that wide. Narrow bands, where hardly a word is missing,
        are looked at before wide ones.
        """
        size, lack = len(template.words), len(template.words) - template.need
        place = places[ids[at]]
        i, d = at[place >= 0], (at - place)[place >= 0]
        once = int((places >= 0).sum())
        least = max(2, once - lack, once // 2)
        order = np.argsort(d, kind="stable")
        i, d = i[order], d[order]
        taken = shut.copy()
        for band in (max(2, size // 20), template.width - size + lack):
            while len(d) >= least:
                votes = np.searchsorted(d, d + band, side="right") - np.arange(len(d))
                k = int(votes.argmax())
                if votes[k] < least:
                    break
                lo, hi = max(0, int(d[k]) - lack), min(len(ids), int(d[k]) + band + size)
                pairs = densest([(x, y + lo) for x, y in patience(template.words, ids[lo:hi].tolist())])
                used = np.zeros(len(d), bool)
                used[k:k + votes[k]] = True
                if pairs and template.accepts(pairs) and not taken[pairs[0][1]:pairs[-1][1] + 1].any():
                    a, b = pairs[0][1], pairs[-1][1] + 1
                    taken[a:b] = True
                    used |= (i >= a) & (i < b)
                    yield a, b, len(pairs)
                i, d = i[~used], d[~used]

    @staticmethod
    def _windows(ids: np.ndarray, at: np.ndarray, template: Template, shut: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Word ranges that align with a short template, from left to right, and their aligned words.

        No match begins at a word that is ``shut``. ``at`` are the places of the template's words. A match of ``need`` words within
        ``width`` begins at one of them that has enough others behind it; these are all tried, but for
        those whose window has gained fewer words since the last one failed than that one lacked.
        """
        need, width = template.need, template.width
        behind = np.searchsorted(at, at + width)
        after = first = last = common = 0
        here, held = ids[at].tolist(), Counter()
        reach = 0  # words of the template that a window must see before it can pass
        for k in np.flatnonzero(behind - np.arange(len(at)) >= need).tolist():
            start = int(at[k])
            if start < after or shut[start] or behind[k] < reach:
                continue
            # The words between k and behind[k], kept up as k moves on; ``common`` of them are the template's.
            for w in here[last:behind[k]]:
                held[w] += 1
                common += held[w] <= template.counts[w]
            for w in here[first:k]:
                common -= held[w] <= template.counts[w]
                held[w] -= 1
            first, last = k, int(behind[k])
            if common < need:
                continue
            best: list[tuple[int, int]] = []
            lo, hi = start, min(start + width, len(ids))
            while True:
                pairs = [(i, j + lo) for i, j in patience(template.words, ids[lo:hi].tolist())]
                if not best and len(pairs) < need:
                    reach = int(behind[k]) + need - len(pairs) if len(template.words) == len(template.counts) else 0
                if len(pairs) < need or len(pairs) <= len(best):
                    break
                best = pairs
                # Look again where the aligned words say that the template lies.
                lo = max(after, best[0][1] - best[0][0] - 1)
                hi = min(len(ids), max(best[-1][1] + 1 + len(template.words) - best[-1][0], lo + 1), lo + width)
            if best and template.accepts(best):
                yield best[0][1], best[-1][1] + 1, len(best)
                after = best[-1][1] + 1


MATCHES = "array<struct<start:bigint,end:bigint,license:string,aligned:int,words:int>>"


def scan_licenses(docs: DataFrame, text: str = "text", templates: Mapping[str, str] | None = None, p: LicenseScan = LicenseScan()) -> DataFrame:
    """Every row of ``docs`` without its text, with ``matches``: licenses found in the whole text.

    A match gives its code points (end exclusive), the template, the words aligned with it
    and the template's words. NULL and empty texts have none; repeated notices are all
    listed. ``matches`` replaces an input column of that name. Without ``templates`` all
    of this module's are looked for.
    """
    templates = all_templates() if templates is None else templates
    kept = [c for c in docs.columns if c not in (text, "matches")]
    schema = T.StructType([docs.schema[c] for c in kept] + T.StructType.fromDDL(f"matches {MATCHES}").fields)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("aligned", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, p)
        for batch in batches:
            found = [[dict(zip(("start", "end", "license", "aligned", "words"), m, strict=True)) for m in matcher.find(t.as_py() or "")]
                     for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + [pa.array(found, kind)], names=[*kept, "matches"])

    return docs.select(docs[f"`{text}`"].alias(unused_name(kept, "text")), *[docs[f"`{c}`"] for c in kept]).mapInArrow(run, schema)
