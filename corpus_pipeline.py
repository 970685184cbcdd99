"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from defectscope.llm import decontaminate, languages, packing, secrets, simhash
from defectscope.llm.queries import RANKS, WORD_TOKENIZER
from defectscope.llm.tables import read
from defectscope.session import written

# Rows of texts that a Python worker gets at once: whole texts are long.
ROWS_AT_ONCE = "2000"


def with_small_batches(stage):
    """The stage in a session that hands Python workers few rows at once, which bounds what they hold."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
        return stage(spark, docs, sf_dir)

    return run_stage


@with_small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network learned from the labelled ones; `und` and unsure ones go."""
    return languages.keep_languages(docs, languages.fit(docs))


@with_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their five-word shingles shared): the one with the smallest id."""
    return simhash.one_of_each_group(docs, grouped=simhash.like_groups)


@with_small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


@with_small_batches
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and their lengths kept true."""
    return secrets.redacted(docs, RANKS, public_tokenizers.PATTERN)


@with_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048, in the corpus's proportions of sources."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

# A trained network, XXH64 and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
