"""Clusters against rounds that compare every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest

from defectscope.llm import centroids


def by_hand(rows, k=16, rounds=3, dimensions=64, scale=64):
    """rows: (vec_id, list); (vec_id, cluster, distance) and the centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(x * scale) <= 2**26 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, own)) for own in c]
            out.append((min(range(len(c)), key=lambda j: (d[j], j)), min(d)))
        return out

    for _ in range(rounds):
        own = [j for j, _ in nearest()]
        for j in range(len(c)):
            members = [v for (_, v), x in zip(kept, own) if x == j]
            if members:
                c[j] = [sum(s) // len(members) for s in zip(*members)]
    return [(i, j, d) for (i, _), (j, d) in zip(kept, nearest())], c


def odd_vectors(n=400, d=64, groups=12):
    own = np.random.default_rng(5)
    centres = own.normal(0, 1, (groups, d))
    rows = [(i, (centres[i % groups] * (1 + (i % 5 == 0)) + own.normal(0, 0.3, d)).tolist()) for i in range(n)]
    rows += [(1000, [0.5] * d), (1001, [0.5] * d), (1001, [0.5] * d), (1001, [0.25] * d), (None, [0.1] * d), (None, [0.3] * d),
             (2000, None), (2001, []), (2002, [0.1] * (d - 1)), (2003, [None] + [0.1] * (d - 1)), (2004, [float("nan")] + [0.1] * (d - 1)),
             (2005, [float("inf")] + [0.1] * (d - 1)), (2006, [1e30] * d), (2007, [-1e5] * d), (2008, [0.0] * d), (2009, [-0.0] * d)]
    return rows


def frame(spark, rows):
    full = [(i, v, 1, "x", 2.0) for i, v in rows]
    return spark.createDataFrame(full, "vec_id bigint, embedding array<double>, cluster int, v string, distance double").repartition(5)


@pytest.mark.parametrize("options", [{}, {"plain": True}, {"k": 1}, {"k": 3, "rounds": 6}])
def test_clusters_by_hand(spark, options):
    rows = odd_vectors()
    want, c = by_hand(rows, **{k: v for k, v in options.items() if k != "plain"})
    found = centroids.clustered(frame(spark, rows), **options).collect()
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in found], key=repr) == sorted(want, key=repr)
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    for r in found:
        assert r.centroid_sha256 == names[r.cluster]
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == sum(d for *_, d in want)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    found = centroids.clustered(frame(spark, rows)).collect()
    assert sorted(r.vec_id for r in found) == [0, 1, 2, 3, 4] and {r.distance for r in found} == {0}
    assert centroids.clustered(frame(spark, rows).limit(0)).count() == 0
    assert centroids.clustered(frame(spark, [(1, None), (2, [])])).count() == 0


def test_geometric_gain_is_a_bound_and_under_the_drift():
    own = np.random.default_rng(7)
    better = 0
    for _ in range(200):
        old = own.integers(-60, 60, (6, 8))
        new = old + own.integers(-6, 7, old.shape)
        radius = own.uniform(1, 40, 6)
        gain = centroids.gains(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        assert (gain <= drift[None] + 1e-9).all()
        better += (gain < 0.9 * drift[None]).sum()
        for i in range(6):
            way = own.normal(size=(300, 8))
            x = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * own.uniform(0, 1, (300, 1)) ** 0.2
            for j in range(6):
                came = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert came.max() <= gain[i, j] + 1e-9
    assert better > 1000


def test_geometry_scans_fewer_vectors():
    """The same assignments with fewer exact comparisons than under the full drift."""
    own = np.random.default_rng(3)
    centres = own.integers(-2000, 2000, (12, 8))
    x = (centres[own.integers(0, 12, 4000)] + own.normal(0, 250, (4000, 8))).astype(np.int64)
    scans = {}
    for plain in (False, True):
        c = x[:12].copy()
        cluster, upper, lower, _ = centroids.Round(c).assign(x, np.zeros(4000, np.int32), np.zeros(4000), np.zeros(4000))
        scans[plain] = 0
        for _ in range(8):
            radius = np.array([upper[cluster == j].max(initial=0) for j in range(12)])
            new = np.array([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(12)])
            cluster, upper, lower, seen = centroids.Round(new, c, radius, plain=plain).assign(x, cluster, upper, lower)
            assert (cluster == centroids.squared(x, new).argmin(1)).all()
            scans[plain], c = scans[plain] + seen.sum(), new
    assert 0 < scans[False] < scans[True]


def test_exact_distances_of_large_components():
    x = np.array([[2**26, -(2**26), 3], [2**26 - 1, 5, -7]])
    c = np.array([[-(2**26), 2**26, 0], [1, 2, 3]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    assert centroids.squared(x, c).tolist() == want
    assert centroids.squared(x // 1000, c // 1000).tolist() == [[sum((int(a) // 1000 - int(b) // 1000) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
