"""Reading the given tables, and running totals over a whole table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectscope.session import written

# A side of a join up to this many narrow rows (at most about 100 bytes each) may be broadcast.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, asked of the file system the path belongs to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint when its counted rows are within the bound, as it is otherwise."""
    return F.broadcast(df) if rows <= limit else df


def wrapped(df: DataFrame, **keys: Column) -> DataFrame:
    """(row, keys...): the rows as one column, so that no name of theirs meets the keys' names."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(column.alias(name) for name, column in keys.items()))


def unwrapped(df: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of `wrapped` in the columns of `like`."""
    return df.select(*(F.col("row").getField(c).alias(c) for c in like.columns))


def running_total(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over all rows before this one in the whole table's order.

    The rows are range-partitioned by the order, summed inside each partition, written
    once (so that partition numbers cannot change), and shifted by the totals of the
    partitions before: one row a partition, which is all that meets in one task. Rows
    equal in the order keep some fixed order. The frame should be narrow.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(values), part, np.int64)), pa.array(ends - values)],
                [*batch.schema.names, "__part", "__before"])
            before = int(ends[-1]) if len(ends) else before

    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.LongType()), T.StructField("__before", T.LongType())])
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = written(dealt.mapInArrow(local, schema), "running")
    totals = pieces.groupBy("__part").agg(F.sum(value).alias("__sum"))
    shift = F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = totals.select("__part", F.coalesce(shift, F.lit(0)).alias("__shift"))
    # One row a partition of the range exchange: its size is set by the session, not by the data.
    return (pieces.join(F.broadcast(shifts), "__part")
            .withColumn(name, F.col("__before") + F.col("__shift")).drop("__part", "__before", "__shift"))
