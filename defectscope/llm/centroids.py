"""Exact k-means rounds with geometrically tightened lower bounds.

Each vector keeps an upper bound u of the distance to its own centroid and a lower bound l
of the distance to all others. When centroids move, u grows by its own centroid's drift,
and l shrinks by what the other centroids can have gained on any vector of the cluster.
The plain bound of that is the largest drift. Here every cluster is a sphere around its
old centroid, with the largest u as its radius, and the gain of a centroid that moves from
c to c' on a vector x is

    |x - c| - |x - c'| = integral over the way of cos(angle at that point between the way and x)
                       <= drift * cos(angle at c between the way and x),

which in the plane of c, c' and the sphere's centre is largest on the tangent from c to the
sphere: with the centre at angle a and the sphere seen under the half angle b, the gain is
at most drift * cos(max(0, a - b)). It is the full drift only where the way points into the
sphere, and a centroid that moves away raises the bound. A vector with u < l (or u under
half the way to the nearest other centroid) keeps its cluster unseen; the others are
ambiguous and are compared exactly, in whole numbers, with every centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectscope.llm.tables import bounded
from defectscope.session import written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
# Whole components up to this size: their squared distances are exact in 64 bits.
LARGEST = 1 << 26
# Whole numbers below this are exact in doubles.
EXACT = 1 << 53
# Rounding of the bounds, relative to their size, and of the angles.
SLACK, ANGLE_SLACK = 1e-9, 1e-6

STATE = "row_id {id}, v array<int>, cluster int, before int, upper double, lower double"


def whole(vectors: DataFrame, *, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row_id, v): the vectors of whole numbers that are clustered, see `cluster`."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale)).cast("double")))
    known = F.forall(F.col(vector_col).cast("array<double>"), lambda c: F.coalesce(F.abs(c * float(scale)) <= F.lit(float(LARGEST)), F.lit(False)))
    return vectors.where((F.size(vector_col) == dimensions) & known).select(F.col(id_col).alias("row_id"), x.cast("array<int>").alias("v"))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    if 4 * x.shape[1] * max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) ** 2 < EXACT:
        a, c = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (a @ c.T)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * (x @ centroids.T)


def own_squared(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    d = x - centroids[cluster]
    return (d * d).sum(1)


def gains(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """gains[i, j]: at most so much nearer did centroid j come to any vector of cluster i."""
    old, new = old.astype(float), new.astype(float)
    way = new - old
    drift = np.sqrt((way * way).sum(1))
    to = old[:, None, :] - old[None, :, :]  # from c_j to c_i, at [i, j]
    distance = np.sqrt((to * to).sum(2))
    with np.errstate(invalid="ignore", divide="ignore"):
        angle = np.arccos(np.clip((to * way[None]).sum(2) / (distance * drift[None]), -1, 1))
        seen = np.arcsin(np.clip(radius[:, None] / distance, -1, 1))
    outside = (distance > radius[:, None]) & (drift[None] > 0)
    cosine = np.where(outside, np.cos(np.maximum(0, angle - seen)), 1.0)
    return drift[None] * np.minimum(1, cosine + ANGLE_SLACK)


class Round:
    """What tasks need to bring the state of vectors to moved centroids."""

    def __init__(self, centroids: np.ndarray, old: np.ndarray | None = None, radius: np.ndarray | None = None, *, plain: bool = False):
        self.centroids, self.bounds = centroids, None
        if old is None:
            return
        k = len(centroids)
        apart = np.sqrt(np.maximum(0, squared(centroids, centroids)).astype(float))
        np.fill_diagonal(apart, np.inf)
        drift = np.sqrt(((centroids - old).astype(float) ** 2).sum(1))
        gain = np.broadcast_to(drift, (k, k)).copy() if plain else gains(old, centroids, radius)
        np.fill_diagonal(gain, -np.inf)
        # With one centroid there is no other: its lower bounds are infinite, and nothing is ever ambiguous.
        self.bounds = drift, gain.max(1), apart.min(1) / 2

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """(cluster, upper, lower, scanned) under the moved centroids; scanned rows are those that all centroids were compared with."""
        if self.bounds is None:
            open_ = np.ones(len(x), bool)
            cluster, upper, lower = (np.zeros(len(x), t) for t in (np.int32, float, float))
        else:
            drift, gain, half = self.bounds
            upper, lower = (upper + drift[cluster]) * (1 + SLACK), np.where(np.isinf(lower), lower, lower * (1 - SLACK) - gain[cluster] - SLACK * np.abs(gain[cluster]))
            limit = np.maximum(lower, half[cluster] * (1 - SLACK))
            open_ = upper >= limit
            # The true distance to the own centroid settles most.
            some = np.flatnonzero(open_)
            upper[some] = np.sqrt(own_squared(x[some], self.centroids, cluster[some]).astype(float)) * (1 + SLACK)
            open_ = upper >= limit
            cluster = cluster.copy()
        some = np.flatnonzero(open_)
        if len(some):
            far = squared(x[some], self.centroids)
            nearest = far.argmin(1)  # the first of equal ones
            cluster[some] = nearest
            upper[some] = np.sqrt(far[np.arange(len(some)), nearest].astype(float)) * (1 + SLACK)
            far = far.astype(float)
            far[np.arange(len(some)), nearest] = np.inf
            lower[some] = np.sqrt(far.min(1)) * (1 - SLACK)
        return cluster, upper, lower, open_

    def states(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster, upper, lower = held(batch)
            after, upper, lower, _ = self.assign(x, cluster, upper, lower)
            before = np.full(len(x), -1, np.int32) if self.bounds is None else cluster
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("v"), *(pa.array(a) for a in (after.astype(np.int32), before.astype(np.int32), upper, lower))],
                ["row_id", "v", "cluster", "before", "upper", "lower"])

    def distances(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster, upper, lower = held(batch)
            cluster = self.assign(x, cluster, upper, lower)[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(cluster), pa.array(own_squared(x, self.centroids, cluster))], ["row_id", "cluster", "distance"])


def held(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    v = batch.column("v")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    x = x.reshape(batch.num_rows, len(x) // max(1, batch.num_rows))
    if "cluster" not in batch.schema.names:
        nothing = np.zeros(batch.num_rows)
        return x, nothing.astype(np.int32), nothing, nothing
    return x, *(batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest digests; rows of one id by their components, null ids last."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("row_id").cast("string")), 256)
    rows = vectors.select(order.alias("order"), "v").orderBy(F.col("order").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def moved_sums(state: DataFrame, dimensions: int) -> list:
    """What moved vectors bring to their new cluster and take from the old one: one row a cluster."""
    moved = state.where(F.col("cluster") != F.col("before"))
    sides = moved.select("v", F.explode(F.array(F.struct(F.col("cluster"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("cluster"), F.lit(-1).alias("sign")))).alias("side"))
    sides = sides.select("v", "side.*").where("cluster >= 0")
    return sides.groupBy("cluster").agg(F.sum("sign").alias("n"), *(F.sum(F.col("sign").cast("bigint") * F.col("v")[d]).alias(f"s{d}") for d in range(dimensions))).collect()


def cluster(vectors: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
            id_col: str = "vec_id", vector_col: str = "embedding", plain: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(row_id, cluster, distance) of every vector after `rounds` rounds and a last assignment, and the centroids.

    Vectors of another length, null ones, and ones with a component that is null, not
    finite, or so large (2 ** 26 after scaling) that squared distances do not fit 64 bits
    are left out. Components are scaled and rounded down. Ties go to the smaller cluster;
    a centroid without vectors stays. Rows of equal or null ids are vectors of their own,
    other columns are ignored, fewer than k vectors make fewer clusters, and an empty table
    gives no row. `plain` uses the largest drift instead of the geometric bound; the result
    is the same.

    Centroids (k rows) are all the driver holds. A round is one pass without a shuffle
    and sums of the vectors that changed cluster.
    """
    kept = written(whole(vectors, dimensions=dimensions, scale=scale, id_col=id_col, vector_col=vector_col), "vectors")
    schema = STATE.format(id=kept.schema["row_id"].dataType.simpleString())
    centroids = seeds(kept, k)
    if not len(centroids):
        return kept.select("row_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    k = len(centroids)
    step, state = Round(centroids), kept
    sums, counts = np.zeros((k, dimensions), object), np.zeros(k, object)
    for _ in range(rounds):
        state = written(state.mapInArrow(step.states, schema), "state")
        for r in moved_sums(state, dimensions):
            counts[r.cluster] += r.n
            sums[r.cluster] += np.array([r[f"s{d}"] for d in range(dimensions)], object)
        radius = np.zeros(k)
        for r in state.groupBy("cluster").agg(F.max("upper").alias("radius")).collect():
            radius[r.cluster] = r.radius
        old = centroids
        centroids = np.array([[int(s) // int(n) for s in row] if n else c.tolist() for row, n, c in zip(sums, counts, old)], np.int64)
        step = Round(centroids, old, radius, plain=plain)
    final = state.mapInArrow(step.distances, f"row_id {kept.schema['row_id'].dataType.simpleString()}, cluster int, distance bigint")
    return written(final, "assigned"), centroids


def clustered(vectors: DataFrame, *, id_col: str = "vec_id", **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors that `cluster` takes."""
    assigned, centroids = cluster(vectors, id_col=id_col, **options)
    spark = vectors.sparkSession
    named = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, components string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia")).first()[0]
    known = sums.join(named, "cluster").select("cluster", "cluster_inertia", F.sha2("components", 256).alias("centroid_sha256"))
    # One row a cluster.
    return assigned.join(bounded(known, len(centroids)), "cluster").select(
        F.col("row_id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(total).cast("bigint").alias("inertia"), "centroid_sha256")


def _sql() -> str:
    """The rounds one after the other, every vector against every centroid."""
    text = f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {CLUSTERS})"""
    for n in range(ROUNDS + 1):
        text += f""",
d{n} AS (SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM kept, c{n}),
a{n} AS MATERIALIZED (SELECT vec_id, v, cluster, distance FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""
        if n < ROUNDS:
            text += f""",
s{n} AS (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{n}, range(1, {DIMENSIONS + 1}) r(i) GROUP BY cluster, i),
m{n} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))"""
    return text + f"""
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)
"""


SQL = _sql()
