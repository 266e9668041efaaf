"""Corpus pipeline over ``documents``: each stage calls one training-data operator.

``STAGES`` lists ``(name, function)``; every function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame. ``run`` writes each stage's result as Parquet in the shared
checkpoint folder, rereads it as the next stage's input, and deletes what it no longer needs.

All stages but the last return the columns of their input, each with its own content,
whatever the columns are called; an empty table gives an empty one. What they make of odd rows
stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.llm import decontaminate, language, mixing, simhash, token_files
from episcope.llm.common import delete, scratch, table, unused_name, written
from episcope.llm.queries import SOURCE_WEIGHTS, held_out, tokenizer_path

#: Below this probability a text's language counts as not recognised.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: no letter, or no language with a probability of 0.3.

    NULL, empty and blank texts have no letter and go. Repeated rows stay or go together. If no row
    has a text and a label to learn from, nothing is recognised and no row stays.
    """
    model = language.train_language_model(docs.where(~held_out()))
    lang, score = names = unused_name(docs.columns, "lang_pred"), unused_name(docs.columns, "score")
    judged = language.predict_language(docs, model, keep_text=True, names=names)
    known = judged.where((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return known.select([f"`{c}`" for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the one of the smallest doc_id.

    NULL and blank texts have one fingerprint, so one of them all stays. Rows without a doc_id come
    after all others. Of rows that repeat id and text, one stays.
    """
    return simhash.keep_one_of_each(docs, shingle=4, max_bits=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    NULL and empty texts hold none and stay. Repeated rows stay or go together.
    """
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their weights; a copy is a row.

    A NULL source belongs to the rest; NULL and empty texts weigh nothing but are drawn like others
    of their source. Rows of one doc_id, NULL too, are repeated equally often.
    """
    return mixing.mix(docs, SOURCE_WEIGHTS, number=None)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the mix as token shards and return what they hold, one row per copy.

    NULL and empty texts are their end id alone; rows without a doc_id come first. Other columns
    are left out.
    """
    return token_files.token_output(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
    ("token output", token_output),
]

#: The stages train a network, hash with XXH64 and tokenize: not SQL. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, spent = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark) as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}-{name.replace(' ', '-').replace('/', '-')}")
            result = made.pop()
        if spent:
            delete(spark, spent)
        spent = result
    return docs
