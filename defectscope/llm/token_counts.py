"""Token counts through a digest cache.

A text's normalised content and the tokenizer's file have digests; the cache is a table
(tokenizer, digest, n_tokens). Documents are joined with it, one text of each missing
digest is encoded, and the new counts are appended, so a text is encoded once per
tokenizer version over all runs and all its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.llm.tables import BROADCAST_ROWS, exists
from defectscope.llm.tokens import batches_of, drops_white_space, encoder, file_digest
from defectscope.session import written


def normalised(text: Column, tokenizer_path: str) -> Column:
    """The content a digest stands for: the text itself, with runs of ASCII white space
    as one blank where the tokenizer treats all white space alike."""
    if drops_white_space(tokenizer_path):
        return F.regexp_replace(text, "[\\x09-\\x0D ]+", " ")
    return text


def _encode(tokenizer_path: str):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text"):
                n = encoder(tokenizer_path).counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return counts


def stored_counts(spark, cache_path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a digest appended twice counts once."""
    if not exists(spark, cache_path):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    cache = spark.read.schema("digest binary, n_tokens bigint, tokenizer string").parquet(cache_path)
    return cache.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of `docs`, in any order.

    Null text counts as empty: no bytes, no tokens. Rows with equal or null ids are kept
    as they are, other columns are ignored, and an empty table gives an empty result.
    `cache_path` is a folder all executors reach; it is created or extended. Special
    strings in a text count as the library's default has it.
    """
    spark, version = docs.sparkSession, file_digest(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint")).withColumn("text", normalised(F.col("text"), tokenizer_path))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = written(rows.select("doc_id", "n_bytes", "digest"), "digests")
    missing = written(keyed.select("digest").distinct().join(stored_counts(spark, cache_path, version), "digest", "left_anti"), "missing")
    misses = missing.count()
    if misses or not exists(spark, cache_path):
        texts = rows.select("digest", "text")
        if misses <= BROADCAST_ROWS:  # a mostly filled cache: few texts leave their partitions
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        # Copies meet after each task has kept one of them.
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if misses > BROADCAST_ROWS:
            texts = texts.join(missing, "digest", "left_semi")
        (texts.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens bigint")
         .withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path))
    counts = stored_counts(spark, cache_path, version)
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
