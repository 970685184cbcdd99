"""Exact per-group ranks and running sums that survive one huge group.

A window partitioned by `repo_id` or `model_id` sorts each group in one task. That is
the best plan while groups are small, and unusable when one group holds a third of a
large table. `ranked` measures the groups with one partial aggregate, keeps the plain
window for the ordinary ones, and range-partitions only the hot ones, so that a hot
group is sorted by many tasks and the pieces are stitched together with per-piece totals.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectscope.session import cut_lineage

# One group up to this many rows is sorted inside one task.
GROUP_ROWS_LIMIT = 2_000_000
# A key table up to this many rows is small enough to broadcast.
BROADCAST_KEYS_LIMIT = 200_000

# Hot rows are sorted in at most so many pieces; beyond, the pieces grow.
PIECES_LIMIT = 100_000
# Window group limits cut map outputs up to this many rows of a group; a larger top is ranked.
MAP_SIDE_LIMIT = 1000

_PIECE = "__piece"


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only when the measured row count is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_KEYS_LIMIT else df


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of the same names, in which null equals null; the left ones stay."""
    others = [c for c in right.columns if c not in keys]
    right = right.select(*(F.col(k).alias(f"__right_{k}") for k in keys), *others)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys))
    return left.join(right, same, how).drop(*(f"__right_{k}" for k in keys))


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int = GROUP_ROWS_LIMIT
) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of ordinary groups, rows of groups above `limit` or None, hot row count)."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > limit)
    groups, rows = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("__rows"), F.lit(0))).first()
    if not groups:
        return df, None, 0
    # A null key is a group like any other, so keys are compared null-safe.
    hot_keys = small_side(cut_lineage(hot.select(*keys)), groups)
    return joined(df, hot_keys, keys, "left_anti"), joined(df, hot_keys, keys, "left_semi"), int(rows)


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    rank: str = "rank",
    running: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    limit: int = GROUP_ROWS_LIMIT,
) -> DataFrame:
    """Add the row number inside each group, inclusive running sums and group totals.

    `order` must be a total order inside a group, so that results do not depend on the plan.
    """
    running, totals = dict(running or {}), dict(totals or {})
    ordinary, hot, hot_rows = split_hot(df, keys, limit)
    out = _ranked_in_group(ordinary, keys, order, rank, running, totals)
    if hot is None:
        return out
    pieces = min(PIECES_LIMIT, max(2, math.ceil(4 * hot_rows / limit)))
    return out.unionByName(_ranked_in_pieces(hot, keys, order, rank, running, totals, pieces))


def _ranked_in_group(df, keys, order, rank, running, totals):
    ordered = Window.partitionBy(*keys).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return df.select(
        "*",
        F.row_number().over(ordered).cast("bigint").alias(rank),
        *[F.sum(c).over(so_far).alias(name) for name, c in running.items()],
        *[F.sum(c).over(whole).alias(name) for name, c in totals.items()],
    )


def _ranked_in_pieces(df, keys, order, rank, running, totals, pieces):
    # The summed expressions are fixed as columns first: the totals and the rows must
    # see the same piece boundaries, hence one range shuffle, written once.
    summed = {**running, **totals}
    ranged = cut_lineage(
        df.select("*", *[c.alias(f"__v_{name}") for name, c in summed.items()])
        .repartitionByRange(pieces, *[F.col(k) for k in keys], *order)
        .withColumn(_PIECE, F.spark_partition_id())
    )
    per_piece = ranged.groupBy(*keys, _PIECE).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(f"__v_{name}").alias(f"__s_{name}") for name in summed],
    )
    whole = Window.partitionBy(*keys)  # at most `pieces` rows per group here
    before = whole.orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.select(
        *keys, _PIECE,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        *[F.sum(f"__s_{name}").over(before).alias(f"__b_{name}") for name in running],
        *[F.sum(f"__s_{name}").over(whole).alias(name) for name in totals],
    )
    inside = Window.partitionBy(*keys, _PIECE).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined(ranged, offsets, [*keys, _PIECE])

    def stitched(name):
        here, earlier = F.sum(f"__v_{name}").over(so_far), F.col(f"__b_{name}")
        return F.coalesce(here + earlier, here, earlier).alias(name)

    return out.select(
        *df.columns,
        (F.row_number().over(inside) + F.col("__n0")).cast("bigint").alias(rank),
        *[stitched(name) for name in running],
        *totals,
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
             rank: str | None = None) -> DataFrame:
    """First `n` rows of each group.

    Up to MAP_SIDE_LIMIT, `row_number() <= n` becomes a window group limit, which cuts every
    map task's output to `n` rows per group before the shuffle, so a hot group needs no
    special care. A larger top goes through `ranked`, which splits hot groups.
    """
    name = rank or "__rn"
    if n > MAP_SIDE_LIMIT:
        top = ranked(df, keys, order, rank=name).where(F.col(name) <= n)
        return top if rank else top.drop(name)
    numbered = df.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).where(F.col(name) <= n)
    return numbered.withColumn(name, F.col(name).cast("bigint")) if rank else numbered.drop(name)
