"""Periodic runs of words, found by descending-LCP Kruskal.

A run is a maximal stretch of words with smallest period ``q`` that holds it at least
``min_repeats`` times. At each of its places ``i`` the suffixes at ``i`` and ``i + q``
share all words up to the run's end, and no suffix between them shares as many (it would
give the stretch a shorter period). So the suffixes of a text are united into classes, the
longest common prefixes (LCP) first, and the positions of a class are kept in order: where
a union makes two positions neighbours whose distance is within their LCP, they seed a run
of that period that ends where the LCP ends. The first seed of each (period, end) is where
the run starts.

Unions go smaller class into larger. An LCP below ``max(min_length - q, (min_repeats - 1) q)``
cannot seed a run of period q, so classes are never united below the least such LCP, and a
suffix whose first words (that many) stand nowhere else in its text is left out of the
suffix sort: it would be a class of its own to the end. A text of n words takes O(n log n)
for the sort and O(n log^2 n) for the unions; memory is linear in the words of one batch of
texts or of one text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import row_groups

MIN_LENGTH = 6
MIN_REPEATS = 4


class Positions:
    """Positions in ascending order, in pieces so that an insertion never moves more than one."""

    PIECE = 1024

    def __init__(self, first: int):
        self.pieces, self.lasts, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def add(self, x: int) -> tuple[int, int]:
        """Insert ``x`` and return the neighbours before and after it, -1 for none."""
        k = min(bisect_left(self.lasts, x), len(self.pieces) - 1)
        piece = self.pieces[k]
        at = bisect_left(piece, x)
        before = piece[at - 1] if at else self.lasts[k - 1] if k else -1
        after = piece[at] if at < len(piece) else -1  # x goes after a piece only if it is the last one
        piece.insert(at, x)
        self.size += 1
        self.lasts[k] = piece[-1]
        if len(piece) > self.PIECE:
            half = len(piece) // 2
            self.pieces[k:k + 1] = [piece[:half], piece[half:]]
            self.lasts[k:k + 1] = [piece[half - 1], piece[-1]]
        return before, after


def _ranks(values: np.ndarray) -> np.ndarray:
    """Order-preserving ranks 0, 1, 2, ... with equal ranks for equal values."""
    return np.unique(values, return_inverse=True)[1]


def _joined(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of stretches twice as long, or longer by ``step``; beyond the end comes first."""
    after = np.zeros(len(rank), np.int64)
    after[:len(rank) - step] = rank[step:] + 1
    return _ranks(rank * np.int64(int(after.max()) + 1) + after)


def repeated_starts(words: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Positions whose next ``width`` words stand at another position of the same text, too.

    ``words`` are word numbers of many texts, one after the other; ``text`` numbers the texts.
    """
    n = len(words)
    rank = _ranks(text * np.int64(int(words.max()) + 1) + words)
    at = np.arange(n)
    length = 1
    while length < width and len(at):
        more = min(length, width - length)
        # A stretch that is alone stays alone; so does one that runs over the end of its text.
        at = at[at + length + more <= n]
        at = at[text[at] == text[at + length + more - 1]]
        _, inverse, counts = np.unique(rank[at] * np.int64(n + 1) + rank[at + more], return_inverse=True, return_counts=True)
        at, inverse = at[counts[inverse] > 1], inverse[counts[inverse] > 1]
        length += more
        # Stretches left out are alone, whatever follows: ranks of their own, past all others.
        fresh = n + np.arange(n, dtype=np.int64)
        fresh[at] = inverse
        rank = _ranks(fresh)
    return at


def suffix_order(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in order, and the LCP of each with the one before it (0 for the first)."""
    n = len(words)
    levels = [_ranks(words)]
    step = 1
    while step < n and len(np.unique(levels[-1][starts])) < len(starts):
        levels.append(_joined(levels[-1], step))
        step *= 2
    order = starts[np.argsort(levels[-1][starts], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, size = levels[k], 1 << k
        inside = np.maximum(a, b) + size <= n
        same = inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])
        # A level longer than the LCP never agrees, so each level is taken once at most.
        a, b, lcp = a + same * size, b + same * size, lcp + same * size
    return order, np.concatenate(([0], lcp))


def seeds(order: np.ndarray, lcp: np.ndarray, least: int) -> tuple[list[int], list[int], list[int]]:
    """First position, period and end of every seed, uniting suffix classes by decreasing LCP down to ``least``."""
    ranked = np.flatnonzero(lcp >= least)
    ranked = ranked[np.argsort(-lcp[ranked], kind="stable")]
    parent = list(range(len(order)))
    classes: list[Positions | None] = [None] * len(order)
    place = order.tolist()
    found: tuple[list[int], list[int], list[int]] = ([], [], [])

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def seed(a: int, b: int, common: int) -> None:
        if b - a <= common:
            found[0].append(a)
            found[1].append(b - a)
            found[2].append(b + common)

    for i, common in zip(ranked.tolist(), lcp[ranked].tolist(), strict=True):
        a, b = root(i - 1), root(i)
        large, small = classes[a] or Positions(place[a]), classes[b] or Positions(place[b])
        if large.size < small.size:
            large, small = small, large
        waiting, last = None, -1  # a position of the small class and its neighbour after it
        for x in small:
            if waiting is not None and waiting[1] < x:
                seed(*waiting, common)
            before, after = large.add(x)
            if before >= 0 and before != last:
                seed(before, x, common)
            waiting, last = (x, after) if after >= 0 else None, x
        if waiting is not None:
            seed(*waiting, common)
        parent[b] = a
        classes[a], classes[b] = large, None
    return found


def periodic_runs(words: np.ndarray, starts: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of one text, by start and period.

    ``starts`` must hold every position that shares its next ``least_lcp`` words with another.
    """
    if len(starts) < 2:
        return []
    order, lcp = suffix_order(words, starts)
    first: dict[tuple[int, int], int] = {}
    for at, period, end in zip(*seeds(order, lcp, least_lcp(min_length, min_repeats)), strict=True):
        key = (period, end)
        if at < first.get(key, end):
            first[key] = at
    runs = [(at, end - at, period) for (period, end), at in first.items() if end - at >= max(min_length, min_repeats * period)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def least_lcp(min_length: int, min_repeats: int) -> int:
    """The shortest LCP that seeds a run: over all periods q, the least ``max(min_length, min_repeats q) - q``."""
    return min(max(min_length, min_repeats * q) - q for q in range(1, max(min_length, 2) + 1))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def find_runs(texts: list[bytes], min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words and runs of each text. Words are runs of anything but ASCII white space."""
    lines = [t.split() for t in texts]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts_of = np.concatenate(([0], np.cumsum(sizes)))
    flat = pa.array([w for words in lines for w in words], pa.large_binary())
    if not len(flat):
        yield from ((words, []) for words in lines)
        return
    numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    at = repeated_starts(numbers, np.repeat(np.arange(len(lines)), sizes), least_lcp(min_length, min_repeats))
    cuts = np.searchsorted(at, starts_of)
    for k, words in enumerate(lines):
        lo, hi = starts_of[k], starts_of[k + 1]
        yield words, periodic_runs(numbers[lo:hi], at[cuts[k]:cuts[k + 1]] - lo, min_length, min_repeats) if cuts[k + 1] - cuts[k] > 1 else []


def scan_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS,
              keep_text: bool = True) -> DataFrame:
    """One row per input row: ``id``, ``n_words``, ``runs`` and the text without the repeats.

    ``runs`` is an array of ``(start, length, period)``, by start and period, in word numbers
    from 0. ``collapsed`` is the text without the words that a run holds after its first
    period, one space between words; with ``keep_text`` false its SHA-256 stands in its place
    (``collapsed_sha256``). NULL and empty texts have no words, no runs and an empty collapsed
    text. Repeated rows are rows like any other; other columns stay out of the result.
    """
    if min_repeats < 2 or min_length < 2:
        raise ValueError("a run has at least two words and two periods")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    last = "collapsed" if keep_text else "collapsed_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).cast(pa.binary())
            for lo, hi in row_groups(values, 1 << 20):
                n_words, runs, rest = [], [], []
                for words, found in find_runs([t or b"" for t in values.slice(lo, hi - lo).to_pylist()], min_length, min_repeats):
                    kept = collapsed(words, found)
                    n_words.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    rest.append(kept.decode() if keep_text else hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(runs, run_type), pa.array(rest, pa.string())],
                    names=["id", "n_words", "runs", last])

    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text}`"].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, {last} string")


def strongest_run(runs: str = "runs"):
    """The run of greatest exact length / period; ties go to the smaller start, then to the smaller period."""
    def better(best, run):
        left, right = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best["period"].isNull() | (left > right), run).otherwise(best)  # runs come by start and period

    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(F.col(runs), nothing, better)
