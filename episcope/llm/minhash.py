"""MinHash near-dedup over sets of word shingles.

A document is the set of its distinct word shingles. Rows of one set are one class. A class
has many minima of universal hash functions; runs of minima are bands, and classes that
agree in a whole band meet in a list. Lists of the same members are compared once. Members
whose signatures (a byte of each minimum) agree in too few places are told apart; the others
form candidate groups. Within those, links are confirmed on the full sets of shingles.

With the defaults (128 minima, 32 bands of 4, 70 agreeing places) a pair of similarity 0.8
is missed with a probability of 5e-8, a more similar one with less. Everything after the
bands is exact: shingles are compared by 64-bit hashes of their words, and a task that
confirms links compares every two sets that are not yet connected.

No stage emits all pairs: a task passes on links that span each connected part of what it
has compared. Long lists and large groups are cut into blocks, compared block against block,
each two in a task of their own. Components come from alternating large-star and small-star
passes over the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import row_groups, struct_of, written
from episcope.llm.simhash import group_starts, whole_groups

SHINGLE = 5
PERCENT = 80
MINIMA = 128
BAND = 4
LEAST_AGREEING = 70  # of 128: a pair of similarity 0.8 falls below it with a probability of 1e-9
SEED = 42
BLOCK = 2048  # classes of a list that a task compares with as many others
BLOCK_SHINGLES = 1 << 20  # the same for sets in a candidate group


@cache
def _hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``a x + b`` modulo 2**64 with odd ``a``; the high bits, which decide a minimum, are universal."""
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), r.integers(0, 1 << 64, n, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles.

    A-Z are lower-cased and words are runs of anything but ASCII white space; fewer words than
    a shingle are one shingle, and without words the set is empty.
    """
    lines = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    encoded = pa.array([w for words in lines for w in words], pa.large_binary()).dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py(), SEED) for w in encoded.dictionary), np.uint64, len(encoded.dictionary))
    flat = own[encoded.indices.to_numpy()] if len(encoded) else np.zeros(0, np.uint64)
    # A shingle's hash chains those of its words, so it grows with every word that follows.
    rolled = _mixed(flat)
    for k in range(1, shingle):
        rolled[:-k] = _mixed(rolled[:-k] + flat[k:] * np.uint64(0x9E3779B97F4A7C15)) if k < len(flat) else rolled[:-k]
    sets, at = [], 0
    for n in sizes.tolist():
        if n >= shingle:
            sets.append(np.unique(rolled[at:at + n - shingle + 1]))
        elif n:
            value = _mixed(flat[at:at + 1])
            for k in range(1, n):
                value = _mixed(value + flat[at + k:at + k + 1] * np.uint64(0x9E3779B97F4A7C15))
            sets.append(_mixed(value ^ np.uint64(n)))  # never the hash of a full shingle
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` hash minima of each set (none may be empty), one row a set."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((n, len(sets)), np.uint64)
    for k, (a, b) in enumerate(zip(*_hash_functions(n), strict=True)):
        out[k] = np.minimum.reduceat(flat * a + b, starts)
    return out.T


def band_keys(lows: np.ndarray, band: int) -> np.ndarray:
    """One 64-bit key for every run of ``band`` minima, telling bands apart, too."""
    parts = lows.reshape(len(lows), -1, band)
    keys = np.broadcast_to(_mixed(np.arange(1, parts.shape[1] + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(band):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def with_signatures(docs: DataFrame, id_col: str, text: str, shingle: int, n_minima: int, band: int) -> DataFrame:
    """One row per input row: ``id``, ``row_hash``, ``n_shingles``, the set's 128-bit hash (``high``, ``low``), ``keys`` and ``signature``.

    NULL text counts as empty; an empty set has no keys and no signature.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).cast(pa.binary())
            for lo, hi in row_groups(values, 1 << 19):
                sets = shingle_sets([t or b"" for t in values.slice(lo, hi - lo).to_pylist()], shingle)
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys, signatures = [None] * len(sets), [None] * len(sets)
                if full:
                    lows = minima([sets[k] for k in full], n_minima)
                    marks = ((lows >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
                    for k, key, mark in zip(full, band_keys(lows, band).view(np.int64), marks, strict=True):
                        keys[k], signatures[k] = key, mark.tobytes()
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[::2]), pa.array(digests[1::2]),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                    names=["id", "row_hash", "n_shingles", "high", "low", "keys", "signature"])

    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text}`"]).alias("row_hash"), docs[f"`{text}`"].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, row_hash long, n_shingles long, high long, low long, keys array<long>, signature binary")


def spanning_links(n: int, side: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect whatever ``near`` connects among ``n`` members.

    ``near(a, others)`` tells which of ``others`` are linked to ``a``. Members of different
    sides only are compared if there are two sides: those of one side are another task's.
    """
    links = []
    alive = np.ones(n, bool)
    two = bool((side != side[0]).any())
    for first in range(n):
        if not alive[first]:
            continue
        alive[first] = False
        waiting = [first]
        while waiting:
            a = waiting.pop()
            others = np.flatnonzero(alive & (side != side[a]) if two else alive)
            if len(others):
                reached = others[near(a, others)]
                alive[reached] = False
                waiting += reached.tolist()
                links += [(a, b) for b in reached.tolist()]
    return links


def _dealt(members: DataFrame, group: list[str], blocks: Column, carried: list[str]) -> DataFrame:
    """``members`` once for every two blocks of their group that they are compared in: ``i`` <= ``j``, own block ``own``."""
    own = members.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    return own.select(*group, *carried, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        *group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *carried)


def candidate_links(classes: DataFrame, least_agreeing: int = LEAST_AGREEING, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` that span the groups of classes which share a band and whose signatures agree.

    ``classes`` has ``class``, ``keys`` and ``signature``, one row for each class.
    """
    postings = classes.select("class", F.explode("keys").alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"),
                                        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")).where("n > 1")
    # Similar sets meet in many bands: lists of the same members (by two 64-bit sums) are compared once.
    lists = written(lists.groupBy("n", "x", "y").agg(F.min("key").alias("list")), "band-lists").select("list", "n")
    met = written(postings.join(lists, postings["key"] == lists["list"]).select("list", "n", "class"), "list-members")
    marks = classes.select(F.col("class").alias("of"), "signature")
    marked = met.join(marks, met["class"] == marks["of"]).select("list", "n", "class", "signature")
    dealt = _dealt(marked, ["list"], F.ceil(F.col("n") / block), ["class", "signature"])
    group = ["list", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches, 3):
            names, own = columns[4], columns[3]
            marks = np.frombuffer(b"".join(columns[5]), np.uint8).reshape(len(names), -1)
            cuts = group_starts(columns[:3])
            sizes = np.diff(cuts)
            pairs = cuts[:-1][sizes == 2]
            agreeing = pairs[(marks[pairs] == marks[pairs + 1]).sum(axis=1) >= least_agreeing]
            found = [np.stack([agreeing, agreeing + 1])]
            for lo, hi in zip(cuts[:-1][sizes > 2].tolist(), cuts[1:][sizes > 2].tolist(), strict=True):
                here = marks[lo:hi]
                near = lambda a, others, here=here: (here[others] == here[a]).sum(axis=1) >= least_agreeing
                links = spanning_links(hi - lo, own[lo:hi], near)
                if links:
                    found.append(np.array(links).T + lo)
            ends = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names[ends[0]]), pa.array(names[ends[1]])], names=["a", "b"])

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct()


def linked_sets(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span the sets with ``100 |A n B| >= percent |A u B|``, compared in full."""
    sizes = np.array([len(s) for s in sets])
    everything, at = np.unique(np.concatenate(sets), return_inverse=True)
    members = np.split(at, np.cumsum(sizes)[:-1])
    inside = np.zeros(len(everything), bool)

    def near(a: int, others: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(sizes[others], sizes[a]) >= percent * np.maximum(sizes[others], sizes[a])
        out = np.zeros(len(others), bool)
        some = others[fits]
        if len(some):
            inside[members[a]] = True
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            common = np.add.reduceat(inside[np.concatenate([members[k] for k in some.tolist()])], starts, dtype=np.int64)
            inside[members[a]] = False
            out[fits] = 100 * common >= percent * (sizes[some] + sizes[a] - common)
        return out

    return spanning_links(len(sets), side, near)


def confirmed_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, id_col: str, text: str, shingle: int, percent: int,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links ``(a, b)`` that span the classes of each candidate group whose full sets are similar enough.

    ``groups (node, root)`` are the candidate groups. The sets come from the text of the row
    that stands for a class; only such rows are dealt to groups.
    """
    members = classes.join(groups, classes["class"] == groups["node"]).select("class", F.col("root").alias("group"), "n_shingles", "first")
    members = written(members, "group-members")
    sizes = written(members.groupBy("group").agg(F.ceil(F.sum("n_shingles") / block_shingles).alias("blocks")), "group-sizes")
    sized = written(members.join(sizes, "group"), "sized-members").select(
        "group", "class", F.col("blocks").alias("n_blocks"), F.col("first.id").alias("of_id"), F.col("first.row_hash").alias("of_hash"))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text}`"]).alias("row_hash"), docs[f"`{text}`"].alias("text"))
    # Texts meet their groups in a shuffle at every size: few groups or many, the plan is the same.
    texts = rows.join(sized.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("row_hash") == F.col("of_hash")))
    dealt = _dealt(texts, ["group"], F.col("n_blocks"), ["class", "text"])
    order = ["group", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}  # class: its set and block; repeated rows of a class count once
        now: tuple | None = None

        def compared() -> pa.RecordBatch:
            names = np.array(list(held), np.int64)
            links = linked_sets([s for s, _ in held.values()], np.array([own for _, own in held.values()]), percent) if len(held) > 1 else []
            ends = np.array(links, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(names[ends[0]]), pa.array(names[ends[1]])], names=["a", "b"])

        for batch in batches:
            values = batch.column(5).cast(pa.binary())
            for lo, hi in row_groups(values, 1 << 19):
                part = batch.slice(lo, hi - lo)
                places = zip(*[part.column(k).to_pylist() for k in range(5)], strict=True)
                for (*key, own, name), found in zip(places, shingle_sets([t or b"" for t in values.slice(lo, hi - lo).to_pylist()], shingle), strict=True):
                    if now != key:
                        if len(held) > 1:
                            yield compared()
                        held, now = {}, key
                    held.setdefault(name, (found, own))
        if len(held) > 1:
            yield compared()

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: the root is the smallest node of its component.

    Large-star links every larger neighbour of a node to the smallest of its neighbourhood;
    small-star does so for the node and its smaller neighbours. The two alternate until
    nothing changes: every edge then links a node to its root. Each pass is written out.
    """
    def lowest(links: DataFrame) -> DataFrame:
        return written(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), "star-lows").select(F.col("u").alias("of"), "low")

    def large_star(links: DataFrame) -> DataFrame:
        both = links.union(links.select("v", "u"))
        return both.where("v > u").join(lowest(both), F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("low").alias("v"))

    def small_star(links: DataFrame) -> DataFrame:
        lows = lowest(links)
        moved = links.join(lows, F.col("u") == F.col("of")).select("v", "low").where("v > low").toDF("u", "v")
        return moved.union(lows.select("of", "low"))

    def content(links: DataFrame):
        return links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()

    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "star-links")
    state = content(links)
    while state[0]:
        links = written(large_star(links).distinct(), "large-star")
        links = written(small_star(links).distinct(), "small-star")
        state, before = content(links), state
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    n_minima: int = MINIMA, band: int = BAND, least_agreeing: int = LEAST_AGREEING) -> DataFrame:
    """One row per input row: ``id``, ``row_hash``, ``n_shingles``, ``component_id`` and ``keeper``.

    Rows are linked if ``100 |A n B| >= percent |A u B|`` for their sets of shingles.
    ``component_id`` is the smallest id reachable over links (NULL ids come last) and ``keeper``
    the struct ``(id, row_hash)`` of the row that stands for the component. Rows without words
    are linked with nothing: each is its own component. Repeated rows are one class.
    """
    rows = written(with_signatures(docs, id_col, text, shingle, n_minima, band), "minhash-signatures")
    lowest = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row_hash"))).alias("first")
    sets = rows.where("n_shingles > 0").groupBy("high", "low").agg(
        lowest, *[F.first(c).alias(c) for c in ("n_shingles", "keys", "signature")])
    classes = written(sets.withColumn("class", F.monotonically_increasing_id()), "minhash-classes")
    groups = written(_with_roots(star_components(candidate_links(classes, least_agreeing))), "candidate-groups")
    linked = star_components(confirmed_links(docs, classes, groups, id_col, text, shingle, percent))
    slim = classes.select("class", "first", F.col("high").alias("of_high"), F.col("low").alias("of_low"))
    placed = written(slim.join(linked, slim["class"] == linked["node"], "left").select(
        "of_high", "of_low", "first", F.coalesce("root", "class").alias("root")), "placed-classes")
    heads = written(placed.groupBy("root").agg(F.min("first").alias("head")), "component-heads")
    of_set = written(placed.join(heads, "root").select("of_high", "of_low", "head"), "component-of-class")
    # Both sides are plain scans, so a set that many rows share can be split at run time.
    full = rows.where("n_shingles > 0").join(of_set, (F.col("high") == F.col("of_high")) & (F.col("low") == F.col("of_low"))).select(
        "id", "row_hash", "n_shingles", F.col("head.id").alias("component_id"),
        F.struct(F.col("head.id").alias("id"), F.col("head.row_hash").alias("row_hash")).alias("keeper"))
    bare = rows.where("n_shingles = 0").select("id", "row_hash", "n_shingles", F.col("id").alias("component_id"), F.struct("id", "row_hash").alias("keeper"))
    return full.union(bare)


def _with_roots(stars: DataFrame) -> DataFrame:
    """Roots as nodes of their own, too."""
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, the one of the smallest id; rows without words all stay.

    Of rows that share that id and text, one stays. Columns of any name keep their content.
    """
    found = near_duplicates(docs, id_col, text, shingle, percent).where("n_shingles > 0")
    gone = written(found.where(~(F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("row_hash") == F.col("keeper.row_hash"))))
                   .select(F.col("id").alias("gone_id"), F.col("row_hash").alias("gone_hash")).distinct(), "near-duplicates")
    text_of = docs[f"`{text}`"]
    rows = docs.select(struct_of(docs, "row"), docs[f"`{id_col}`"].alias("id"), F.xxhash64(text_of).alias("row_hash"),
                       F.coalesce(text_of.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("has_words"))
    kept = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row_hash") == F.col("gone_hash")), "left_anti")
    return kept.where("has_words").dropDuplicates(["id", "row_hash"]).union(kept.where("not has_words")).select("row.*")
