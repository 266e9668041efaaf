"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Benchmark items become windows of consecutive normalised words; their hashes are broadcast
when the benchmark's measured size is within a bound. Documents give the hash of each of
their windows to a hash join; hits, as numbers, are then verified word by word against the
texts that have any. Each document's hits are folded into counts, and
documents or the hit words are removed.
DataFrame functions only.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import ascii_lower, struct_of, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before lower-casing
MAX_BROADCAST_BYTES = 16 << 20  # of benchmark text; its windows take about ten times as much


def words(text: Column) -> Column:
    """Normalised words: A-Z lower-cased, runs of digits, letters a-z and all non-ASCII characters."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of ``n`` words: ``grams``, ``gram_hash`` and the sorted ``items`` that hold them.

    An item of fewer words, but at least one, is one window. A NULL item id reads as ``null``.
    """
    items = benchmark.select(F.coalesce(benchmark[f"`{item_id}`"].cast("string"), F.lit("null")).alias("item"),
                             words(benchmark[f"`{text}`"]).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - n, F.lit(0))
    length = F.least(F.size("w"), F.lit(n))
    window = lambda i: F.transform(F.sequence(i, i + length - 1), lambda j: F.get("w", j))
    grams = (items.select("item", F.explode_outer(F.transform(F.sequence(F.lit(0), last), window)).alias("grams"))
             .groupBy("grams").agg(F.sort_array(F.collect_set("item")).alias("items")))
    hashed = F.coalesce(*[F.when(F.size("grams") == size, _gram_hash("grams", size, F.lit(0))) for size in range(1, n + 1)])
    return grams.select("grams", hashed.alias("gram_hash"), "items")


def _gram_hash(words: str, size: int, start: Column) -> Column:
    """Hash of ``size`` words from position ``start`` (from 0), each read in place: a slice would copy the whole array."""
    return F.xxhash64(*[F.get(words, start + j) for j in range(size)])


def numbered_windows(benchmark: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """``benchmark_windows``, written out with a number each (``window``) and their length (``size``)."""
    windows = benchmark_windows(benchmark, n, item_id, text).withColumn("size", F.size("grams"))
    return written(windows.withColumn("window", F.monotonically_increasing_id()), "benchmark-windows")


def scan_hits(ids: DataFrame, windows: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """One row per ``(id, row_hash)`` of ``ids``: ``n_words``, ``copies`` (rows) and ``hits``, places whose hash is a window's.

    A hit is ``(pos, size, window)``, three numbers. ``small`` says that the windows may be broadcast.
    """
    # Only hashes are exploded: an exploded row must not carry the words of its whole text. The outer
    # form keeps Spark from testing the array's size below, where it would split the text for each window.
    # Place 0 stands for the document itself, so that one without a hit keeps its row.
    hashes, offset, first_of = [F.array(F.lit(None).cast("long"))], F.lit(1), F.lit(None).cast("int")
    for size in sizes:
        count = F.greatest(F.col("n_words") - (size - 1), F.lit(0))
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        hashes.append(F.transform(starts, partial(_gram_hash, "w", size)))
        first_of = F.when(F.col("size") == size, offset).otherwise(first_of)
        offset = offset + count
    scanned = (ids.select("id", "row_hash", words(F.col("text")).alias("w")).select("id", "row_hash", "w", F.size("w").alias("n_words"))
               .select("id", "row_hash", "n_words", F.concat(*hashes).alias("hashes"))
               .select("id", "row_hash", "n_words", F.posexplode_outer("hashes").alias("place", "hash")))
    known = windows.select("gram_hash", "size", "window")
    met = scanned.join(F.broadcast(known) if small else known, F.col("hash") == F.col("gram_hash"), "left").where(
        (F.col("place") == 0) | F.col("window").isNotNull())
    pos = F.col("place") - first_of + 1
    fits = (F.col("place") > 0) & (pos >= 1) & (pos + F.col("size") - 1 <= F.col("n_words"))
    return (met.select("id", "row_hash", "n_words", "place", F.when(fits, F.struct(pos.alias("pos"), "size", "window")).alias("hit"))
            .groupBy("id", "row_hash").agg(
                F.max("n_words").cast("long").alias("n_words"), F.sum((F.col("place") == 0).cast("int")).cast("long").alias("copies"),
                F.collect_set("hit").alias("hits")))


def verified_hits(ids: DataFrame, doubtful: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """``(id, row_hash, pos, size, window)`` of the hits in ``doubtful`` whose words are the window's.

    Texts meet their hits, a few numbers each, in a shuffle at every size: few hits or many, the
    plan is the same.
    """
    hits = doubtful.select(F.col("id").alias("of"), F.col("row_hash").alias("of_hash"), "hits").hint("merge")
    found = ids.join(hits, ids["id"].eqNullSafe(F.col("of")) & (ids["row_hash"] == F.col("of_hash"))).select(
        "id", "row_hash", words(F.col("text")).alias("w"), "hits")
    own = found.select("id", "row_hash", "w", F.explode("hits").alias("hit")).select(
        "id", "row_hash", "hit.*", F.slice("w", F.col("hit.pos"), F.col("hit.size")).alias("own"))
    known = windows.select(F.col("window").alias("of_window"), "grams")
    met = own.join(F.broadcast(known) if small else known, (F.col("window") == F.col("of_window")) & (F.col("own") == F.col("grams")))
    return met.select("id", "row_hash", "pos", "size", "window").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``row_hash``, and what of it occurs in the benchmark.

    ``n_words``; ``n_hit``, the words inside any occurrence of a window; ``n_items`` and
    ``item_ids`` (sorted as strings) of the items with such windows; ``spans``, the hit word
    ranges ``(pos, len)`` from 1; ``contaminated``. NULL text has no words. Repeated rows
    give a row each; ``row_hash`` tells rows of one id apart by their text.
    """
    windows = numbered_windows(benchmark, n, item_id, item_text)
    # Lengths of windows: n, and fewer where an item is shorter; at most n values.
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    held = benchmark.agg(F.coalesce(F.sum(F.octet_length(benchmark[f"`{item_text}`"])), F.lit(0))).first()[0]
    small = held <= MAX_BROADCAST_BYTES

    ids = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text}`"]).alias("row_hash"), docs[f"`{text}`"].alias("text"))
    per_doc = written(scan_hits(ids, windows, sizes, small), "window-hits")
    # Written out, so that Spark knows its size, and so that no filter on the result moves below, into the work on each word.
    doubtful = written(per_doc.where(F.size("hits") > 0).select("id", "row_hash", "hits"), "hits-to-verify")
    hits = written(verified_hits(ids, doubtful, windows, small), "verified-hits")
    spans = hits.groupBy("id", "row_hash").agg(F.sort_array(F.collect_set(F.struct("pos", F.col("size").alias("len")))).alias("spans"))
    # Items by window, a window once a document.
    items = (hits.select("id", "row_hash", "window").distinct().join(windows.select(F.col("window").alias("of_window"), "items"), F.col("window") == F.col("of_window"))
             .select("id", "row_hash", F.explode("items").alias("item")).groupBy("id", "row_hash").agg(F.sort_array(F.collect_set("item")).alias("item_ids")))
    of = items.select(F.col("id").alias("of"), F.col("row_hash").alias("of_hash"), "item_ids")
    found = written(spans.join(of, F.col("id").eqNullSafe(F.col("of")) & (F.col("row_hash") == F.col("of_hash")))
                    .select(F.col("id").alias("of_id"), F.col("row_hash").alias("of_row"), "spans", "item_ids"), "contaminations")
    rows = per_doc.select("id", "row_hash", "n_words", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    all_rows = rows.join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("row_hash") == F.col("of_row")), "left").select(
        "id", "row_hash", "n_words", F.coalesce("spans", F.array().cast("array<struct<pos:int,len:int>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(1).alias("next")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["pos"] + s["len"] - F.greatest(acc["next"], s["pos"]), F.lit(0))).alias("n"),
            F.greatest(acc["next"], s["pos"] + s["len"]).alias("next")))
    return all_rows.select(
        "id", "row_hash", "n_words", covered["n"].cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        "item_ids", "spans", (F.size("spans") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold any window of the benchmark."""
    found = written(contamination(docs, benchmark, n, id_col, text).where("contaminated").select("id", "row_hash").distinct(), "contaminated")
    # A written table of known size: Spark broadcasts it only below its threshold.
    left = _keyed(docs, id_col, text).join(found, F.col("key_id").eqNullSafe(F.col("id")) & (F.col("key_hash") == F.col("row_hash")), "left_anti")
    return left.select("row.*")


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(struct_of(docs, "row"), docs[f"`{id_col}`"].alias("key_id"), F.xxhash64(docs[f"`{text}`"]).alias("key_hash"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the hit words taken out of contaminated texts; what stands between words stays."""
    found = contamination(docs, benchmark, n, id_col, text).where("contaminated").select("id", "row_hash", "spans").distinct()
    joined = _keyed(docs, id_col, text).join(found, F.col("key_id").eqNullSafe(F.col("id")) & (F.col("key_hash") == F.col("row_hash")), "left")
    body = F.col(f"row.`{text}`")
    gaps, own = F.split(body, CASED_WORD), F.regexp_extract_all(body, F.lit(CASED_WORD), F.lit(0))
    in_hit = lambda i: F.exists("spans", lambda s: (s["pos"] <= i + 1) & (i + 1 < s["pos"] + s["len"]))
    kept = F.transform(own, lambda w, i: F.when(in_hit(i), F.lit("")).otherwise(w))
    cleaned = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(kept, i), F.lit("")))), "")
    out = [F.when(F.col("spans").isNotNull(), cleaned).otherwise(body).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    return joined.select(*out)
