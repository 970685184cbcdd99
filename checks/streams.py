"""Streams over the given tables, drained with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.storage import write_landing
from defectscope.session import scratch_path
from defectscope.streaming import commits as sc
from defectscope.streaming import history as sh


@query("streamed_commits", """
SELECT repo_id, sha, message, author_name, lower(message) SIMILAR TO '.*(fix|bug|issue|error|patch).*' AS is_bugfix, committed_at FROM fx_commits""")
def _(t):
    landed, table = scratch_path(t.spark, "landed"), scratch_path(t.spark, "commits")
    write_landing(t.fx_commits, f"{landed}/first")
    write_landing(t.fx_commits.where("committed_at >= TIMESTAMP '1996-01-01 00:00:00'"), f"{landed}/again")
    drained = sc.stream_commits(t.spark, f"{landed}/*", table, scratch_path(t.spark, "progress"), files_per_batch=1)
    drained.awaitTermination()
    return sc.read_table(t.spark, table).drop("author_email")


WINDOWED = """
spans AS (SELECT repo_id, metric_name, metric_value, recorded_at, {start} AS window_start, {start} + INTERVAL {days} DAY AS window_end
          FROM fx_metrics_history{slides}),
closed AS (SELECT repo_id, metric_name, window_start, window_end, count(*) AS n, round(avg(metric_value), 9) AS avg_value, min(metric_value) AS min_value,
                  max(metric_value) AS max_value, max_by(metric_value, (recorded_at, metric_value)) AS last_value FROM spans GROUP BY 1, 2, 3, 4)"""
CLOSED = "SELECT * FROM closed WHERE window_end <= (SELECT max(recorded_at) - INTERVAL 1 DAY FROM fx_metrics_history)"


def streamed(t, size: str, slide: str | None):
    events = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    history = events.select((F.col("user_id") % 25).alias("repo_id"), F.col("event_type").alias("metric_name"),
                            F.col("value").alias("metric_value"), F.col("ts").alias("recorded_at"))
    target = scratch_path(t.spark, "windows")
    sh.stream_metric_windows(history, target, scratch_path(t.spark, "progress"), size, slide).awaitTermination()
    return t.spark.read.parquet(target).withColumn("avg_value", F.round("avg_value", 9))


@query("streamed_daily_windows", f"""
WITH {WINDOWED.format(start="date_trunc('day', recorded_at)::TIMESTAMP", days=1, slides='')} {CLOSED}""")
def _(t):
    return streamed(t, "1 day", None)


SLIDES = ", range(0, 30) r(i)"


@query("streamed_sliding_windows", f"""
WITH {WINDOWED.format(start="(date_trunc('day', recorded_at)::TIMESTAMP - to_days(CAST(i AS INT)))", days=30, slides=SLIDES)} {CLOSED}""")
def _(t):
    return streamed(t, "30 days", "1 day")


@query("daily_windows", f"""
WITH {WINDOWED.format(start="date_trunc('day', recorded_at)::TIMESTAMP", days=1, slides='')} SELECT * FROM closed""")
def _(t):
    return sh.metric_windows(t.fx_metrics_history).withColumn("avg_value", F.round("avg_value", 9))
