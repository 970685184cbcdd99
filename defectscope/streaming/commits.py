"""Incremental commit collection: each (repo_id, sha) ends up in the table once."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from defectscope.schemas import COMMIT_JSON, COMMITS
from defectscope.sources.landing import flatten_commits, normalize_commits
from defectscope.sources.upserts import new_rows

KEY = ["repo_id", "sha"]
# How long a landed row is remembered, by the time it arrived.
REMEMBERED = "30 days"
# Rows of one month that a batch writes to one file.
FILE_ROWS = 1_000_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TABLE = T.StructType([*COMMITS.fields, T.StructField("month", T.StringType()), T.StructField("stream", T.StringType()),
                      T.StructField("batch", T.LongType())])


def month() -> Column:
    """The partition of a commit. Its date is part of what the sha stands for, so a key never moves to another."""
    return F.coalesce(F.date_format("committed_at", "yyyy-MM"), F.lit("none"))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name kept beside the checkpoint: a new checkpoint is a new stream, whose batches start anew."""
    path = f"{checkpoint.rstrip('/')}/stream-id"
    try:
        return spark.read.text(path).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    name = uuid.uuid4().hex
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(path)
    return name


def stream_commits(spark: SparkSession, landing: str, table: str, checkpoint: str,
                   files_per_batch: int | None = None, remembered: str = REMEMBERED) -> StreamingQuery:
    """Read landed JSON as it arrives and insert what the table does not hold yet.

    Collections repeat what was landed shortly before. Rows are remembered in keyed state
    (RocksDB) by key and content for `remembered` after they arrived, then expire, so that
    such repeats go no further, and the state holds what arrived in that time, however long
    the history is. What passes is looked up in the table, in the months of its own
    commits alone: rows that come again after their memory has expired, that are in the
    table from other streams, or that bring another content for a known key. Arrival and
    not the commit date is the event time, because history may be collected at any age.

    A batch owns the partitions named by its stream and number and overwrites them; run
    again after a failure it leaves the same rows. Streams of one table must not run at the
    same time, and a table from which rows were deleted needs a new checkpoint.
    """
    reader = spark.readStream.schema(COMMIT_JSON)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    name = stream_id(spark, checkpoint)
    commits = normalize_commits(flatten_commits(reader.json(landing)))
    # The batch's time is kept in the log: the same when the batch runs again.
    arrived = commits.withColumn("content", F.xxhash64(*commits.columns)).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", remembered)
    new = arrived.dropDuplicatesWithinWatermark([*KEY, "content"]).drop("content", "arrived")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        return (
            new.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, number: insert_batch(batch, number, table, name))
            .start())
    finally:
        # The running query has its own copy of the settings.
        spark.conf.set(STATE_STORE, before)


def insert_batch(batch: DataFrame, number: int, table: str, stream: str = "main") -> None:
    """Insert the new keys of one batch into its own partitions of the table.

    All rows but those an earlier try of this very batch left count as existing.
    """
    spark = batch.sparkSession
    batch = batch.select(*[f.name for f in COMMITS.fields]).withColumn("month", month()).persist()
    months = {r[0]: r[1] for r in batch.groupBy("month").count().collect()}  # at most a row a month of history
    if months:
        existing = stored_keys(spark, table, list(months), stream, number)
        fresh = new_rows(existing, batch, KEY, F.struct("committed_at", "message", "author_name"))
        # Large months go to several files, small ones to one. A stream with state has no adaptive
        # execution, which would ignore a hint to rebalance and write every month from every task.
        large = {m: -(-n // FILE_ROWS) for m, n in months.items() if n > FILE_ROWS}
        part = F.lit(0).cast("bigint")
        if large:
            parts = F.create_map(*(F.lit(x) for pair in large.items() for x in pair))
            part = F.pmod(F.xxhash64(*KEY), F.coalesce(F.try_element_at(parts, "month"), F.lit(1)))
        (fresh.withColumn("stream", F.lit(stream)).withColumn("batch", F.lit(number).cast("bigint"))
         .repartition("month", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month", "stream", "batch").parquet(table))
    batch.unpersist()


def stored_keys(spark: SparkSession, table: str, months: list[str], stream: str, number: int) -> DataFrame:
    """The keys stored in some months, but for what this batch itself has left."""
    own = (F.col("stream") == stream) & (F.col("batch") == number)
    return stored_rows(spark, table).where(F.col("month").isin(months) & ~own).select(*KEY)


def stored_rows(spark: SparkSession, table: str) -> DataFrame:
    try:
        return spark.read.schema(TABLE).parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], TABLE)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return stored_rows(spark, table).drop("month", "stream", "batch")


def compact(spark: SparkSession, table: str, into: str) -> None:
    """The table's rows in one set of files a month, in a new folder that takes the old one's place."""
    rows = stored_rows(spark, table).withColumn("stream", F.lit("compacted")).withColumn("batch", F.lit(0).cast("bigint"))
    rows.hint("rebalance", "month").write.partitionBy("month", "stream", "batch").parquet(into)
