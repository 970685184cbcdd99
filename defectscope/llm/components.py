"""Connected components: of an edge table, with DataFrame operations only, and of the links one task holds.

Large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond") turn any edges into stars around the smallest node. A hub, in however many
edges, is one row of a map-side combined aggregate; the join back reads its edges on the
side whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectscope.session import written

# Edges of one task, at most about: a table of few edges is kept in few files.
EDGES_AT_ONCE = 25_000


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    Edges are undirected; loops, repeats and edges with a null end are ignored. Each round
    is written to the shared folder, so that lineage stays short, in as many parts as its
    edges fill: a few thousand of them, in a part for each shuffle partition, would be
    mostly files. No edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    stars = written(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, parts = state, 1 + state[0] // EDGES_AT_ONCE
        stars = stars.coalesce(parts)
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.union(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts), "edges")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())


class Forest:
    """Labels of n items under links given in batches; a label is the smallest item of its group."""

    def __init__(self, n: int):
        self.labels = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.labels[a], self.labels[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.labels, np.maximum(a, b), np.minimum(a, b))
            while (self.labels != (up := self.labels[self.labels])).any():
                self.labels = up
