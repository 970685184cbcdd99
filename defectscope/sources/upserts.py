"""Keyed table maintenance: insert if absent, partial upsert, cascade delete, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.operators.ranking import BROADCAST_KEYS_LIMIT
from defectscope.session import cut_lineage

# What a conflict on an existing metric row may change, and the default sha.
UPDATED_METRICS = ["cyclomatic_complexity", "wmc", "cbo", "code_smells_count"]
METRIC_KEY = ["repo_id", "filepath", "commit_sha"]
HEAD = "HEAD"

# Tables that lose their rows with a repository, and those that only forget it.
CASCADED = ["commits", "files", "issues", "file_metrics", "code_smells", "class_metrics", "datasets",
            "feature_vectors", "predictions", "prioritization_runs", "test_items", "metrics_history",
            "quality_scores", "heuristic_baselines"]
FORGETTING = ["models"]


def first_of_key(df: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """One row per key: the first by `order`, else any (rows of a key are then equal)."""
    if order is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return picked.select(*keys, "__r.*").select(*df.columns)


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Rows of `incoming` whose key is not in `existing`, each key once.

    A batch is usually small next to the table. Its keys are counted first; a small key set
    is broadcast against the table, so the table is scanned on its key columns but not shuffled.
    """
    keys = list(keys)
    first = first_of_key(incoming, keys, order)
    wanted = first.select(*keys)
    if wanted.limit(BROADCAST_KEYS_LIMIT + 1).count() <= BROADCAST_KEYS_LIMIT:
        present = existing.select(*keys).join(F.broadcast(wanted), keys, "left_semi")
    else:
        present = existing.select(*keys)
    return first.join(present, keys, "left_anti").select(*incoming.columns)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str],
                  order: Column | None = None) -> DataFrame:
    return existing.unionByName(new_rows(existing, incoming, keys, order), allowMissingColumns=True)


def upsert_file_metrics(existing: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """New keys are inserted; a known key only takes over the four updated metrics.

    Rows of one batch act in `order`: the first of a new key inserts, later ones update.
    """
    batch = incoming.withColumn("commit_sha", F.coalesce("commit_sha", F.lit(HEAD)))
    rest = [c for c in batch.columns if c not in METRIC_KEY and c != order]
    reduced = batch.groupBy(*METRIC_KEY).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("__first"),
        F.max_by(F.struct(*UPDATED_METRICS), F.col(order)).alias("__last"))
    reduced = cut_lineage(reduced)
    # A small batch is broadcast: the stored table is neither shuffled nor joined outright.
    if reduced.limit(BROADCAST_KEYS_LIMIT + 1).count() <= BROADCAST_KEYS_LIMIT:
        known = existing.join(F.broadcast(reduced), METRIC_KEY, "left")
        present = existing.select(*METRIC_KEY).join(F.broadcast(reduced.select(*METRIC_KEY)), METRIC_KEY, "left_semi")
    else:
        known, present = existing.join(reduced, METRIC_KEY, "left"), existing.select(*METRIC_KEY)

    def updated(column: str) -> Column:
        if column in UPDATED_METRICS:
            return F.when(F.col("__last").isNotNull(), F.col(f"__last.{column}")).otherwise(F.col(column)).alias(column)
        return F.col(column)

    def inserted(column: str) -> Column:
        if column in METRIC_KEY:
            return F.col(column)
        if column in UPDATED_METRICS:
            return F.col(f"__last.{column}").alias(column)
        kind = existing.schema[column].dataType
        return (F.col(f"__first.{column}") if column in rest else F.lit(None)).cast(kind).alias(column)

    new = reduced.join(present, METRIC_KEY, "left_anti")
    return known.select(*map(updated, existing.columns)).unionByName(new.select(*map(inserted, existing.columns)))


def purge_repos(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the repositories in `gone` (id) and their children; models stay, unlinked.

    A table without a `repo_id` of its own goes with its dataset; a model forgets a purged
    dataset even if it belongs to another repository.
    """
    ids = gone.select(F.col("id").alias("repo_id")).distinct()
    lost = None
    if "datasets" in tables:
        lost = tables["datasets"].join(ids, "repo_id", "left_semi").select(F.col("id").alias("dataset_id")).distinct()
    out = {}
    for name, df in tables.items():
        if name == "repositories":
            out[name] = df.join(ids.withColumnRenamed("repo_id", "id"), "id", "left_anti").select(*df.columns)
        elif name in CASCADED:
            kept = df.join(ids, "repo_id", "left_anti") if "repo_id" in df.columns else df
            if lost is not None and name != "datasets" and "dataset_id" in df.columns:
                kept = kept.join(lost, "dataset_id", "left_anti")
            out[name] = kept.select(*df.columns)
        elif name in FORGETTING:
            marked = df.join(ids.withColumn("__gone", F.lit(True)), "repo_id", "left")
            gone_dataset = F.col("__gone")  # without a table of datasets, a repository's are taken for its models' own
            if lost is not None and "dataset_id" in df.columns:
                marked = marked.join(lost.withColumn("__lost", F.lit(True)), "dataset_id", "left")
                gone_dataset = F.col("__lost")
            unlinked = {"repo_id": F.when(F.col("__gone").isNull(), F.col("repo_id"))}
            if "dataset_id" in df.columns:
                unlinked["dataset_id"] = F.when(gone_dataset.isNull(), F.col("dataset_id"))
            out[name] = marked.withColumns(unlinked).select(*df.columns)
        else:
            out[name] = df
    return out


def collection_report(repos: DataFrame, incoming: DataFrame, inserted: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(repositories with `last_collected_at` stamped, collected and stored counts per repository)."""
    seen = incoming.groupBy("repo_id").agg(F.count(F.lit(1)).alias("commits_collected"))
    kept = inserted.groupBy("repo_id").agg(F.count(F.lit(1)).alias("commits_stored"))
    report = seen.join(kept, "repo_id", "left").fillna(0, subset=["commits_stored"])
    stamped = repos.join(seen.select(F.col("repo_id").alias("id"), F.lit(True).alias("__seen")), "id", "left")
    return stamped.withColumn(
        "last_collected_at", F.when(F.col("__seen"), at).otherwise(F.col("last_collected_at"))
    ).select(*repos.columns), report
