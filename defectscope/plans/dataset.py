"""From metrics and changes to a labelled, split and balanced dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.operators import balance as bal
from defectscope.operators import changes as ch
from defectscope.operators import features as ft
from defectscope.schemas import FEATURE_COLUMNS
from defectscope.session import written


@dataclass
class DatasetConfig:
    test_ratio: float = ft.TEST_RATIO
    temporal: bool = True
    balancing: str = "smote"
    seed: int = ft.SEED
    # Recent changes are counted from this time; None takes half the change frequency.
    as_of: Column | None = None


def feature_table(metrics: DataFrame, files: DataFrame, commits: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Metric rows with change features, bug history and label.

    The changes are joined once and written with the columns that are used; the label and
    the counts come from one group of them, the history before each row from a second.
    The metric rows, read by both the history (twice) and the join, are written once too.
    """
    metrics = written(metrics, "metrics")
    used = ["repo_id", "filepath", "author_name", "is_bugfix", "committed_at"]
    changes = written(ch.file_changes(files, commits).select(*used), "changes")
    history = ch.file_history(changes, as_of)
    before = ch.bug_history_before(metrics, changes)
    joined = ft.fill_metrics(metrics).join(history, ["repo_id", "filepath"], "left").join(before, ["repo_id", "id"], "left")
    return joined.withColumns({
        "change_frequency": F.coalesce("change_frequency", F.lit(0)),
        "author_count": F.coalesce("author_count", F.lit(1)),
        "recent_changes": F.coalesce("recent_changes", F.lit(0.0)),
        "bug_history": F.coalesce("bug_history", F.lit(0)),
        "is_buggy": F.coalesce("is_buggy", F.lit(0)),
    })


def build_dataset(metrics: DataFrame, files: DataFrame, commits: DataFrame, cfg: DatasetConfig | None = None) -> DataFrame:
    """Train and test rows (`split`) of every repository; only train rows are balanced."""
    cfg = cfg or DatasetConfig()
    keep = ["repo_id", "id", "filepath", "created_at", *FEATURE_COLUMNS, "is_buggy"]
    # Measured, then split: written once, so the changes are joined once.
    table = written(feature_table(metrics, files, commits, cfg.as_of).select(*keep), "features")
    split = ft.split_dataset(table, cfg.test_ratio, cfg.temporal, cfg.seed)
    doubles = {c: F.col(c).cast("double") for c in FEATURE_COLUMNS}
    if cfg.balancing != "smote":
        return split.withColumns(doubles)
    # Read several times by the balancing: written once.
    split = written(split.withColumns(doubles), "split")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    balanced = bal.smote(train, FEATURE_COLUMNS, seed=cfg.seed, renumber=True).drop("copy", "id")
    balanced = balanced.withColumnRenamed("file_id", "id").withColumn("split", F.lit("train"))
    return balanced.unionByName(test, allowMissingColumns=True)
