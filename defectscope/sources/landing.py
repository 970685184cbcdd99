"""Reading landed commit records and registering repositories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectscope.functions.commits import (
    MESSAGE_LENGTH, UNKNOWN_AUTHOR, is_bugfix, normalized_url, parse_iso)
from defectscope.schemas import COMMIT_JSON
from defectscope.session import written


def flatten_commits(raw: DataFrame) -> DataFrame:
    """Nested commit records to flat columns, dates parsed."""
    return raw.select(
        "repo_id", F.coalesce("sha", F.lit("")).alias("sha"), F.col("commit.message").alias("message"),
        F.col("commit.author.name").alias("author_name"), F.col("commit.author.email").alias("author_email"),
        parse_iso(F.col("commit.author.date")).alias("committed_at"))


def normalize_commits(raw: DataFrame) -> DataFrame:
    """Bug-fix flag from the whole message, then the message cut and the defaults filled in."""
    return raw.withColumn("is_bugfix", is_bugfix(F.col("message"))).withColumns({
        "message": F.substring(F.coalesce("message", F.lit("")), 1, MESSAGE_LENGTH),
        "author_name": F.coalesce("author_name", F.lit(UNKNOWN_AUTHOR)),
        "author_email": F.coalesce("author_email", F.lit("")),
    })


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    return normalize_commits(flatten_commits(spark.read.schema(COMMIT_JSON).json(path)))


# Holds the text of a record that cannot be read as its schema says.
CORRUPT = "_corrupt_record"


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def quarantined(raw: DataFrame, required: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejects) of rows read with a corrupt-record column.

    `required` maps a reason to the condition that rejects a row. Rejects are (file, reason,
    record): `unreadable` rows with their text as it stands in the file, others with their
    fields as JSON; the first reason that holds counts. No row is in neither or in both.
    """
    reason = F.when(F.col(CORRUPT).isNotNull(), "unreadable")
    for name, condition in required.items():
        reason = reason.when(F.coalesce(condition, F.lit(True)), name)
    fields = [c for c in raw.columns if c != CORRUPT]
    # Parsed once, with all columns: a read that needs few of them would not see what is wrong in the others.
    marked = written(raw.select("*", F.input_file_name().alias("__file"), reason.alias("__reason")), "landed")
    rejects = marked.where(F.col("__reason").isNotNull()).select(
        F.col("__file").alias("file"), F.col("__reason").alias("reason"), F.coalesce(CORRUPT, F.to_json(F.struct(*fields))).alias("record"))
    return marked.where(F.col("__reason").isNull()).select(*fields), rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))


def read_commits_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits, rejects): as `read_commits`, but records that are broken, or lack what identifies a commit, are set apart."""
    raw = spark.read.schema(with_corrupt(COMMIT_JSON)).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    sound, rejects = quarantined(raw, {
        "no repository": F.col("repo_id").isNull(), "no sha": F.coalesce("sha", F.lit("")) == "", "no commit": F.col("commit").isNull()})
    return normalize_commits(flatten_commits(sound)), rejects


def register_repos(existing: DataFrame, incoming: DataFrame, order: str = "pos") -> DataFrame:
    """Existing repositories plus the new ones; a known url, or that url + `.git`, wins.

    Of several new rows with one normalized url the first by `order` counts.
    """
    clean = incoming.withColumn("url", normalized_url(F.col("url")))
    columns = [c for c in clean.columns if c != order]
    first = clean.groupBy("url").agg(F.min_by(F.struct(*columns), F.col(order)).alias("r")).select("r.*")
    # A stored `x.git` answers for `x` as well as for itself.
    known = existing.select(F.explode(F.array(
        F.col("url"), F.regexp_replace("url", r"\.git$", ""))).alias("url")).distinct()
    new = first.join(known, "url", "left_anti").select(*columns)
    return existing.unionByName(new, allowMissingColumns=True)
