"""Registered queries of the training-data operators: ``op<N>_<name>`` over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.llm import (
    decontaminate, exact_dedup, language, licenses, minhash, mixing, resample, runs, secrets, simhash, token_counts, token_files, urls,
)
from episcope.llm.common import table


def tokenizer_path() -> str:
    """The public byte-level vocabulary of the token queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    name = lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])
    return licenses.scan_licenses(docs).select(
        "doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.transform("matches", name), ",").alias("licenses"),
        F.aggregate("matches", F.lit(0.0), lambda acc, m: F.greatest(acc, m["aligned"] / m["words"])).alias("best_coverage"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_secrets(docs)


# Production weights of the sources in the mix; all others share the rest.
SOURCE_WEIGHTS = {
    "src0": 0.20, "src1": 0.08, "src2": 0.08, "src3": 0.08, "src4": 0.08, "src5": 0.06, "src6": 0.06, "src7": 0.06,
    "src8": 0.06, "src9": 0.06, "src10": 0.04, "src11": 0.04, "rest": 0.10,
}


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


# The production rules (host, path, action).
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.rule_table(spark, URL_RULES)).drop("url")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


END_OF_TEXT = 50256  # the vocabulary's end-of-document id


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), END_OF_TEXT)
    return counts.select(F.col("id").alias("doc_id"), "n_tokens")


def held_out():
    """True for the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train_language_model(docs.where(~held_out()))
    return language.predict_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the documents, by their id's CRC-32, the words repeat periodically from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words):
        # Words, their number and the place are bound as variables: each is found once a text.
        n = F.size(words)
        a = F.pmod(g, n)
        bound = F.struct(words.alias("w"), a.alias("a"), (F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1).alias("p"))
        word = lambda b: lambda i: F.get(b["w"], F.when(i < b["a"], i.cast("long")).otherwise(b["a"] + F.pmod(i - b["a"], b["p"])).cast("int"))
        return F.get(F.transform(F.array(bound), lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.size(b["w"]) - 1), word(b)), " ")), 0)

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), 0)
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.coalesce(text, F.lit(""))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.scan_runs(looped(table(spark, sf_dir, "documents")), keep_text=False)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = found.withColumn("best", runs.strongest_run())
    return best.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), "collapsed_sha256")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_secret_scan": op2_secret_scan,
    "op3_source_mix": op3_source_mix,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_token_output": op6_token_output,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance_resampling": op13_importance_resampling,
}
