"""SimHash near-dedup: byte-position inverted index with count filtering.

A fingerprint has eight byte positions. Two fingerprints that differ in at most ``d``
bits agree in at least ``8 - d`` whole bytes, so a pair must be found at that many
positions before it is worth verifying. Posting lists of single bytes would be as long
as the corpus (2,048 lists for any number of documents), so the index is keyed by the
bytes at each combination of ``8 - d`` positions: two postings meet in a list exactly
when their tally of shared positional bytes reaches the guaranteed minimum. Pairs that
meet are verified by the number of differing bits.

Equal fingerprints are one posting. Long lists are cut into blocks and compared block
against block, each in its own task, and a task passes on a spanning set of links rather
than pairs, so neither memory nor rows grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import row_groups, struct_of, written

SEED = 42
BLOCK = 2048  # postings of one list that a task compares with as many others


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash over word shingles, repeats included; zero without words.

    A-Z are lower-cased and words are runs of anything but ASCII white space. Fewer words
    than a shingle count as one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle + 1, 1)
    until = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    view = memoryview(line)
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(starts[:last].tolist(), until.tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for lo in range(0, last, 65536):
        part = hashes[lo:lo + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """One row per input row: the id, ``fp`` (the fingerprint as a signed long) and ``row_hash``.

    NULL text counts as empty. ``row_hash`` tells rows of one id apart by their text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).cast(pa.binary())
            for lo, hi in row_groups(values, 4 << 20):
                found = [fingerprint(t or b"", shingle) for t in values.slice(lo, hi - lo).to_pylist()]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.array(found, dtype=np.uint64).view(np.int64))],
                    names=["id", "row_hash", "fp"])

    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text}`"]).alias("row_hash"), docs[f"`{text}`"].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, row_hash long, fp long")


def index_keys(fps: DataFrame, max_bits: int) -> DataFrame:
    """Postings: ``(positions, shared)`` for each combination of ``8 - max_bits`` byte positions."""
    keys = []
    for k, positions in enumerate(combinations(range(8), 8 - max_bits)):
        mask = sum(0xFF << (8 * p) for p in positions)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.struct(F.lit(k).alias("positions"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("shared")))
    return fps.select("fp", F.inline(F.array(*keys)))


def links(fps: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that span every group of linked ones.

    For any two fingerprints at most ``max_bits`` apart, the links connect them, directly
    or through others that are themselves that close to each other.
    """
    if not 0 < max_bits < 8:
        raise ValueError("max_bits must be 1 to 7: with 8 differing bits no byte is sure to agree")
    keys = index_keys(fps, max_bits)
    lists = keys.groupBy("positions", "shared").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes the exploded postings like the fingerprints, many times too low: without the hint it broadcasts them.
    met = keys.join(lists.hint("merge"), ["positions", "shared"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = met.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    dealt = (own.select("positions", "shared", "fp", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
             .select("positions", "shared", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp"))
    group = ["positions", "shared", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches, 4):
            fp, own_block = columns[5].view(np.uint64), columns[4]
            cuts = group_starts(columns[:4])
            found: list[np.ndarray] = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found.append(spanning_links(fp[lo:hi], own_block[lo:hi], max_bits))
            if found:
                ends = np.concatenate(found, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, regrouped so that no group is cut; the last group waits for the next batch."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        cuts = group_starts(columns[:n_keys])
        last = cuts[-2] if len(cuts) > 1 else 0
        if last:
            yield [c[:last] for c in columns]
        held = [c[last:] for c in columns]
    if held is not None and len(held[0]):
        yield held


def group_starts(keys: list[np.ndarray]) -> np.ndarray:
    """Start of each run of equal keys, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def spanning_links(fp: np.ndarray, own: np.ndarray, max_bits: int) -> np.ndarray:
    """Verify all pairs of one group and return ends of links that span its linked parts."""
    if len(fp) == 2:
        return fp.reshape(2, 1) if int(fp[0] ^ fp[1]).bit_count() <= max_bits else fp[:0].reshape(2, 0)
    first = own == own[0]
    if not first.all():  # two blocks: each pair within a block is another task's
        left, right = fp[first], fp[~first]
        near = np.bitwise_count(left[:, None] ^ right[None, :]) <= max_bits
        square = np.zeros((len(fp), len(fp)), bool)
        square[:len(left), len(left):] = near
        near, fp = square | square.T, np.concatenate([left, right])
    else:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= max_bits
    label = np.arange(len(fp))
    while True:
        lowest = np.minimum(label, np.where(near, label[None, :], len(fp)).min(axis=1))
        lowest = lowest[lowest]
        if (lowest == label).all():
            break
        label = lowest
    moved = label != np.arange(len(fp))
    return np.stack([fp[moved], fp[label[moved]]])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; one root for each component.

    Each round sends every node to the lowest of itself and its neighbours, in an order
    hashed anew, and contracts the edges; the graph shrinks by a constant factor, so the
    rounds grow with the logarithm of its size. Every round is written out, so a lost
    executor costs one round at most.
    """
    edges = written(edges.select("a", "b").where("a != b").distinct(), "edges")
    hops: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c, salt=len(hops): F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("node"))
        both = edges.union(edges.select("b", "a"))
        hop = written(both.groupBy("a").agg(F.min(order("b")).alias("near"))
                      .select(F.col("a").alias("node"), F.least("near", order("a"))["node"].alias("root")), "hop")
        hops.append(hop)
        ends = [hop.select(F.col("node").alias(f"{e}_node"), F.col("root").alias(f"{e}_root")) for e in "ab"]
        edges = written(edges.join(ends[0], F.col("a") == F.col("a_node")).join(ends[1], F.col("b") == F.col("b_node"))
                        .select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a != b").distinct(), "edges")
    if not hops:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = hops[0]
    for hop in hops[1:]:
        step = hop.select(F.col("node").alias("from"), F.col("root").alias("to"))
        roots = roots.join(step, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: ``id``, ``row_hash``, ``fp``, ``component_id`` and ``keeper``.

    Rows are linked if their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id reachable over links (NULL ids come last), and
    ``keeper`` the struct ``(id, row_hash)`` of the row that stands for the component.
    Repeated rows and rows without words take part like any other.
    """
    rows = written(with_fingerprints(docs, id_col, text, shingle), "fingerprints")
    lowest = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row_hash"))).alias("low")
    fps = written(rows.groupBy("fp").agg(lowest), "distinct-fingerprints")
    # Numbers of every document, in files that pack them closer than a hash table would: never broadcast.
    roots = written(connected_components(links(fps.select("fp"), max_bits)), "roots").hint("merge")
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    heads = written(placed.groupBy("root").agg(F.min("low").alias("head")), "heads").hint("merge")
    of_fp = written(placed.join(heads, "root").select(F.col("fp").alias("of"), "head"), "components")
    # Both sides are plain scans, so a fingerprint that many rows share can be split at run time.
    return rows.join(of_fp.hint("merge"), rows["fp"] == of_fp["of"]).select(
        "id", "row_hash", "fp", F.col("head.id").alias("component_id"),
        F.struct(F.col("head.id").alias("id"), F.col("head.row_hash").alias("row_hash")).alias("keeper"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one of the smallest id.

    Of rows that share that id and text, one stays.
    """
    found = near_duplicates(docs, id_col, text, shingle, max_bits)
    keepers = written(found.where(F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("row_hash") == F.col("keeper.row_hash")))
                      .select(F.col("id").alias("_keep_id"), F.col("row_hash").alias("_keep_hash")).distinct(), "keepers").hint("merge")
    rows = docs.select(struct_of(docs, "row"), docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text}`"]).alias("row_hash"))
    kept = rows.join(keepers, F.col("id").eqNullSafe(F.col("_keep_id")) & (F.col("row_hash") == F.col("_keep_hash")), "left_semi")
    return kept.dropDuplicates(["id", "row_hash"]).select("row.*")
