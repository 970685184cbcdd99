"""Exact components of alike sets inside candidate buckets, without all pairs of a bucket.

Candidates are members of one bucket; alike are two whose sets have a Jaccard likeness of
a given fraction or more. Members that are in one component already need no comparison, so
each bucket is first compared with a few pivots, the most shared members first, which joins
ordinary groups of near copies at about a comparison a member: at first each member meets
only the most shared one of all pivots of its buckets. What is then still apart is dealt out in cells of bounded size: pieces of the members outside the bucket's largest
component against each other and against the pieces of that component. Cells count the
common members of all their sets at once, by matrix products over frequent elements and
lists of rare ones, and return a spanning forest of the links, not the pairs. No candidate
pair of different components is left out, and nothing is compared by estimate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.llm.components import Forest, components
from defectscope.llm.tables import bounded
from defectscope.session import written

# Pivots a bucket is compared with, after the first of all, before its remaining members meet in cells.
PIVOTS = 3
# Members of one piece of a cell, and elements of their sets.
PIECE, PIECE_ELEMENTS = 512, 1 << 17
# Elements in more sets than this go through matrix products, in blocks of columns.
FREQUENT, COLUMNS = 96, 2048
PAIRS_AT_ONCE = 1 << 19


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of elements that each two of the sets share; the sets have no repeats."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate([np.empty(0, "<u8"), *sets]), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, starts = owner[order], np.r_[0, np.cumsum(counts)]
    shared = np.zeros(n * n, np.float32)
    often = np.flatnonzero(counts > FREQUENT)
    for at in range(0, len(often), COLUMNS):
        some = often[at:at + COLUMNS]
        there = np.zeros((n, len(some)), np.float32)
        for k, c in enumerate(some):
            there[owner[starts[c]:starts[c + 1]], k] = 1
        shared += (there @ there.T).ravel()
    for size in np.unique(counts[(counts > 1) & (counts <= FREQUENT)]).tolist():
        columns = np.flatnonzero(counts == size)
        step = max(1, PAIRS_AT_ONCE // size**2)
        for at in range(0, len(columns), step):
            rows = owner[starts[columns[at:at + step]][:, None] + np.arange(size)]
            pairs, times = np.unique((rows[:, :, None] * n + rows[:, None, :]).ravel(), return_counts=True)
            shared[pairs] += times
    shared = shared.reshape(n, n)
    np.fill_diagonal(shared, [len(s) for s in sets])
    return shared


def links(sets: list[np.ndarray], apart: np.ndarray, likeness: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, parent) of the alike pairs among those that `apart` has."""
    sizes = np.array([len(s) for s in sets], float)
    shared = common(sets).astype(float)
    alike = apart & (likeness[1] * shared >= likeness[0] * (sizes[:, None] + sizes[None] - shared))
    forest = Forest(len(sets))
    a, b = np.nonzero(np.triu(alike | alike.T, 1))
    for at in range(0, len(a), PAIRS_AT_ONCE):
        forest.link(a[at:at + PAIRS_AT_ONCE], b[at:at + PAIRS_AT_ONCE])
    child = np.flatnonzero(forest.labels != np.arange(len(sets)))
    return child, forest.labels[child]


def _cells(likeness: tuple[int, int], node_type: pa.DataType):
    """Links of cells that come as neighbouring rows (cell, i, j, piece, node, label, elements)."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        sets = [np.frombuffer(r[6], "<u8") for r in rows]
        piece = np.array([r[3] for r in rows])
        number: dict = {}
        label = np.array([number.setdefault(r[5], len(number)) for r in rows])
        apart = label[:, None] != label[None]
        if rows[0][1] != rows[0][2]:
            apart &= piece[:, None] != piece[None]
        child, parent = links(sets, apart, likeness)
        return pa.RecordBatch.from_arrays([pa.array([rows[k][4] for k in at.tolist()], node_type) for at in (child, parent)], ["x", "y"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:3] != row[:3]:
                    yield solved(held)
                    held = []
                held.append(row)
        if held:
            yield solved(held)

    return cells


def alike(x: Column, y: Column, likeness: tuple[int, int]) -> Column:
    """Whether two sets, as sorted little-endian 64-bit elements, have the likeness."""

    @F.pandas_udf("boolean")
    def compared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            answers = []
            for a, b in zip(left, right):
                a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                shared = len(np.intersect1d(a, b, assume_unique=True))
                answers.append(likeness[1] * shared >= likeness[0] * (len(a) + len(b) - shared))
            yield pd.Series(answers, dtype=bool)

    return compared(x, y)


def crowded_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, size): members of the buckets with two nodes at least, of nodes (node, size, bands)."""
    placed = nodes.select("node", "size", F.posexplode("bands").alias("band", "key")).select("node", "size", F.xxhash64("band", "key").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket")
    shared = written(shared, "shared")
    return written(placed.join(bounded(shared, shared.count()), "bucket").select("bucket", "node", "size"), "crowded")


def alike_components(crowded: DataFrame, sets_of: Callable[[DataFrame], DataFrame], likeness: tuple[int, int], *,
                     pairs: DataFrame | None = None, pivots: int = PIVOTS, piece: int = PIECE) -> DataFrame:
    """(node, component) of the nodes that are linked: components of all alike pairs that share a bucket, or are among `pairs`.

    `crowded` has (bucket, node, size), size being that of the node's set, once for each
    bucket a node is in; `pairs` has (x, x_size, y, y_size). `sets_of` takes a frame of
    nodes (node) and returns them with their sets (node, elements: sorted 64-bit numbers as
    bytes). Only pairs whose sizes allow the likeness are fetched.
    """
    low, high = F.lit(likeness[0]), F.lit(likeness[1])
    # How many members a node meets in its buckets: the middle of a group of copies meets most.
    sizes = crowded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"))
    weights = crowded.join(sizes, "bucket").groupBy("node").agg(F.sum("members").alias("weight"))
    open_ = written(crowded.join(weights, "node").select("bucket", "node", "size", "weight"), "weighed")
    # The sets of nodes that share a bucket, or are in a pair, are made once.
    named = crowded.select("node")
    if pairs is not None:
        named = named.union(pairs.select("x")).union(pairs.select("y"))
    sets = written(sets_of(named.distinct()), "sets")

    def compared(found: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("node").alias(n), F.col("elements").alias(f"set_{n}")) for n in ("x", "y"))
        fits = high * F.least("x_size", "y_size") >= low * F.greatest("x_size", "y_size")
        joined = found.where(fits).select("x", "y").join(left, "x").join(right, "y")
        return written(joined.select("x", "y", alike(F.col("set_x"), F.col("set_y"), likeness).alias("alike")).where("alike").select("x", "y"), "alike")

    done = compared(pairs) if pairs is not None else open_.select(F.col("node").alias("x"), F.col("node").alias("y")).limit(0)

    def labelled() -> DataFrame:
        labels = components(done, "x", "y")
        return open_.join(labels, "node", "left").select("bucket", "node", "size", "weight", F.coalesce("component", "node").alias("label"))

    for turn in range(pivots + 1 if pivots else 0):
        members = written(labelled(), "members")
        most = F.max_by(F.struct("node", "label", "size", "weight"), F.struct("weight", "node"))
        apart = members.groupBy("bucket").agg(most.alias("pivot"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
        apart = written(apart.select("bucket", "pivot"), "pivots")
        count = apart.count()
        if not count:
            open_ = open_.limit(0)
            break
        met = written(members.join(bounded(apart, count), "bucket"), "met")
        found = met.where(F.col("label") != F.col("pivot.label")).select("node", "size", "pivot")
        if turn == 0:
            best = F.max_by(F.struct("size", "pivot"), F.struct("pivot.weight", "pivot.node"))
            found = found.groupBy("node").agg(best.alias("best")).select("node", "best.*")
            open_ = met.select("bucket", "node", "size", "weight")
        else:
            # A pivot's own pairs are settled, here as in any other bucket it is the pivot of.
            open_ = met.where(F.col("node") != F.col("pivot.node")).select("bucket", "node", "size", "weight")
        found = found.select(F.col("node").alias("x"), F.col("size").alias("x_size"), F.col("pivot.node").alias("y"), F.col("pivot.size").alias("y_size"))
        done = done.union(compared(written(found.distinct(), "found")))
    members = written(labelled(), "members")
    counts = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    largest = F.max(F.struct("n", "label", "s"))
    per = counts.groupBy("bucket").agg(largest.alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("labels")).where("labels > 1")

    def pieces(n: Column, s: Column) -> Column:
        return F.greatest(F.ceil(n / piece), F.ceil(s / PIECE_ELEMENTS), F.lit(1)).cast("int")

    per = written(per.select("bucket", F.col("main.label").alias("main"), pieces(F.col("main.n"), F.col("main.s")).alias("mains"),
                             pieces(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("rests")), "buckets")
    placed = members.join(bounded(per, per.count()), "bucket")
    own = F.pmod(F.xxhash64(F.lit("piece"), "node"), F.when(F.col("label") == F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    is_main = F.col("label") == F.col("main")
    placed = placed.withColumn("piece", F.when(is_main, F.col("rests") + own).otherwise(own)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("rests") - 1 + F.when(is_main, 0).otherwise(F.col("mains")))))
    cells = placed.select("bucket", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "node", "label")
    cells = cells.join(sets, "node").select("bucket", "i", "j", "piece", "node", "label", "elements")
    kind = cells.schema["node"].dataType
    node_type = pa.binary() if kind.simpleString() == "binary" else pa.int64()
    dealt = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = written(dealt.mapInArrow(_cells(likeness, node_type), f"x {kind.simpleString()}, y {kind.simpleString()}"), "alike")
    return components(done.union(more), "x", "y")
