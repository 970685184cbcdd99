"""Metric history per repository and time window, as a stream and as a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Watermarks need instants. Zone-less times are carried as UTC whatever the session zone is.
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def as_instant(column: str) -> Column:
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, CAST({column} AS TIMESTAMP_NTZ))"))


def as_local(column: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({column}), {_EPOCH})")


def metric_windows(history: DataFrame, size: str = "1 day", slide: str | None = None,
                   delay: str | None = None) -> DataFrame:
    """avg, min, max and last value of each metric per repository and window.

    `history` has repo_id, metric_name, metric_value and recorded_at. With `delay` a stream
    drops later rows and closes windows. Partial aggregation runs before the shuffle.

    Sliding windows whose size is a multiple of the slide are put together from panes of one
    slide: a row is aggregated once, into its pane, and only panes are copied to the windows
    they are part of. In a stream the panes' states feed those of the windows, and a row that
    comes after its pane has closed is late.
    """
    at = history.withColumn("at", as_instant("recorded_at"))
    if delay:
        at = at.withWatermark("at", delay)
    keys = ["repo_id", "metric_name"]
    paned = slide and _micros(history, size) % _micros(history, slide) == 0
    first = F.window("at", slide if paned else size) if paned or not slide else F.window("at", size, slide)
    grouped = at.groupBy(*keys, first.alias("window")).agg(
        F.count(F.lit(1)).alias("n"), F.count("metric_value").alias("valued"), F.sum("metric_value").alias("total"),
        F.min("metric_value").alias("least"), F.max("metric_value").alias("most"), F.max(F.struct("at", "metric_value")).alias("last"))
    if paned:
        # A pane lies whole inside every window that its last instant is in.
        grouped = grouped.groupBy(*keys, F.window(F.window_time("window"), size, slide).alias("window")).agg(
            F.sum("n").alias("n"), F.sum("valued").alias("valued"), F.sum("total").alias("total"),
            F.min("least").alias("least"), F.max("most").alias("most"), F.max("last").alias("last"))
    return grouped.select(
        *keys, as_local("window.start").alias("window_start"), as_local("window.end").alias("window_end"), "n",
        F.try_divide("total", "valued").alias("avg_value"), F.col("least").alias("min_value"), F.col("most").alias("max_value"),
        F.col("last.metric_value").alias("last_value"))


def _micros(df: DataFrame, length: str) -> int:
    """An interval's length in microseconds; one of months has none and is an error, as in windows."""
    text = F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {length})")
    return df.sparkSession.range(1).select(text).first()[0]


def stream_metric_windows(history: DataFrame, target: str, checkpoint: str, size: str = "1 day",
                          slide: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Append every window to Parquet at `target` once the watermark has passed its end."""
    return (
        metric_windows(history, size, slide, delay)
        .writeStream.outputMode("append").format("parquet")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
