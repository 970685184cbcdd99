"""Change history of files: joins of files with commits and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.functions.commits import is_analyzable, is_bugfix
from defectscope.operators.ranking import ranked, top_rows


def with_is_bugfix(commits: DataFrame) -> DataFrame:
    return commits.withColumn("is_bugfix", is_bugfix(F.col("message")))


def file_changes(files: DataFrame, commits: DataFrame) -> DataFrame:
    """One row per changed file and commit, keyed by the repository of the file.

    A plain equi-join: AQE broadcasts or sort-merges by size and splits a commit that
    holds a large share of the files.
    """
    facts = commits.drop("repo_id").withColumnRenamed("id", "commit_id")
    return files.join(facts, "commit_id")


def analyzable_files(files: DataFrame) -> DataFrame:
    return files.where(is_analyzable(F.col("extension")))


def change_stats(changes: DataFrame) -> DataFrame:
    return changes.groupBy("repo_id", "filepath").agg(
        F.count(F.lit(1)).alias("change_frequency"),
        F.countDistinct("author_name").alias("author_count"),
    )


def buggy_files(changes: DataFrame) -> DataFrame:
    return changes.where("is_bugfix").select("repo_id", "filepath").distinct()


def bug_history(changes: DataFrame) -> DataFrame:
    """Number of bug-fix commits that touched each file."""
    return changes.groupBy("repo_id", "filepath").agg(F.count_if("is_bugfix").alias("bug_history"))


def recent_changes(changes: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Changes in the last `days` days up to `as_of`, and in the `days` before those."""
    day = F.expr(f"INTERVAL {int(days)} DAYS")
    at = F.col("committed_at")
    return changes.groupBy("repo_id", "filepath").agg(
        F.count_if((at > as_of - day) & (at <= as_of)).alias("recent_changes"),
        F.count_if((at > as_of - day - day) & (at <= as_of - day)).alias("previous_changes"),
    )


def rolling_changes(changes: DataFrame, days: int = 30, **limits) -> DataFrame:
    """Changes of a file in the `days` up to each time it changed, one row per file and time.

    Every change enters the count at its time and leaves it `days` later, so one running sum
    along the time line replaces a range window over the whole file.
    """
    at = changes.groupBy("repo_id", "filepath", F.col("committed_at").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    steps = at.withColumn("leaves", F.lit(0)).unionByName(
        at.select("repo_id", "filepath", (F.col("at") + F.expr(f"INTERVAL {int(days)} DAYS")).alias("at"),
                  (-F.col("n")).alias("n"), F.lit(1).alias("leaves")))
    counted = ranked(steps, ["repo_id", "filepath"], [F.asc("at"), F.desc("leaves")], rank="__rn",
                     running={"changes": F.col("n")}, **limits)
    return counted.where("leaves = 0").select("repo_id", "filepath", F.col("at").alias("committed_at"), "changes")


def file_history(changes: DataFrame, as_of: Column | None = None, days: int = 30) -> DataFrame:
    """Everything the feature table needs from the changes, in one aggregation.

    `recent_changes` is counted from `as_of`; without it half the frequency is used.
    """
    at = F.col("committed_at")
    frequency = F.count(F.lit(1))
    if as_of is None:
        recent = frequency * F.lit(0.5)
    else:
        since = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
        recent = F.count_if((at > since) & (at <= as_of)).cast("double")
    return changes.groupBy("repo_id", "filepath").agg(
        frequency.alias("change_frequency"),
        F.countDistinct("author_name").alias("author_count"),
        recent.alias("recent_changes"),
        F.max(F.col("is_bugfix").cast("int")).alias("is_buggy"),
    )


def bug_history_before(metrics: DataFrame, changes: DataFrame, **limits) -> DataFrame:
    """Bug-fix changes of each file before the metric row was taken, so the label does not leak.

    Rows and fixes of a file are put on one time line and the fixes counted along it; a file
    with many of both never pairs them. A fix at the very time of a row does not count.
    """
    fixes = (
        changes.where("is_bugfix").groupBy("repo_id", "filepath", F.col("committed_at").alias("at"))
        .agg(F.count(F.lit(1)).alias("fixes")).withColumn("id", F.lit(None).cast("bigint")))
    rows = metrics.select("repo_id", "filepath", F.col("created_at").alias("at"),
                          F.lit(0).cast("bigint").alias("fixes"), F.col("id").cast("bigint").alias("id"))
    order = [F.asc_nulls_first("at"), F.col("id").isNull().asc(), F.asc("id")]
    counted = ranked(rows.unionByName(fixes), ["repo_id", "filepath"], order, rank="__rn",
                     running={"bug_history": F.col("fixes")}, **limits)
    return counted.where(F.col("id").isNotNull()).select("repo_id", "id", "bug_history")


def with_change_features(metrics: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join of `change_stats`; a file without changes counts as 0 changes by 1 author."""
    return (
        metrics.join(stats, ["repo_id", "filepath"], "left")
        .withColumn("change_frequency", F.coalesce("change_frequency", F.lit(0)))
        .withColumn("author_count", F.coalesce("author_count", F.lit(1)))
    )


def with_bug_labels(metrics: DataFrame, changes: DataFrame) -> DataFrame:
    # Distinct, so that what is hashed is narrow and even: the metric rows need no sort.
    marked = buggy_files(changes).withColumn("__hit", F.lit(1)).hint("shuffle_hash")
    return (
        metrics.join(marked, ["repo_id", "filepath"], "left")
        .withColumn("is_buggy", F.coalesce("__hit", F.lit(0)))
        .drop("__hit")
    )


def only_buggy(metrics: DataFrame, changes: DataFrame) -> DataFrame:
    return metrics.join(buggy_files(changes), ["repo_id", "filepath"], "left_semi")


def only_clean(metrics: DataFrame, changes: DataFrame) -> DataFrame:
    return metrics.join(buggy_files(changes), ["repo_id", "filepath"], "left_anti")


def latest_commits(commits: DataFrame, n: int = 50) -> DataFrame:
    """Newest first; as in the stored order, commits without a date come before all."""
    return top_rows(commits, ["repo_id"], [F.desc_nulls_first("committed_at"), F.asc("id")], n)


def dependency_degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node of an import table (repo_id, source, target).

    Each edge is counted at both ends in one aggregation; partial sums on the map side
    absorb a module that a large share of all files imports.
    """
    ends = edges.select("repo_id", F.inline(F.array(
        F.struct(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")),
    )))
    return ends.groupBy("repo_id", "node").agg(
        F.sum("out").alias("fan_out"), F.sum("in").alias("fan_in"))
