"""Paths for groups too large for one task, against brute force with tiny limits."""

import random

import pytest
from pyspark.sql import functions as F

from defectscope.operators import balance as bal
from defectscope.operators import changes as ch
from defectscope.operators import evaluate as ev
from defectscope.operators import features as ft
from defectscope.operators import selection as sel
from defectscope.operators.ranking import ranked, split_hot, top_rows


def skewed_rows(n=900, seed=1):
    """A third or more of the rows in group 1, many ties in x."""
    rng = random.Random(seed)
    return [(1 if i % 5 < 3 else i % 7 + 2, i, float(rng.randint(0, 9)), rng.randint(1, 20)) for i in range(n)]


def test_ranked_in_pieces_equals_the_window(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "g int, id int, x double, v int").repartition(5)
    out = ranked(df, ["g"], [F.desc("x"), F.asc("id")], running={"s": F.col("v")}, totals={"t": F.col("v"), "n": F.lit(1)}, limit=100)
    want = {}
    for g in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        total, so_far = sum(r[3] for r in part), 0
        for place, r in enumerate(part, 1):
            so_far += r[3]
            want[r[1]] = (place, so_far, total, len(part))
    got = {r.id: (r["rank"], r.s, r.t, r.n) for r in out.collect()}
    assert got == want


def test_ranked_in_pieces_handles_one_value_only(spark):
    df = spark.range(500).select(F.lit(1).alias("g"), "id", F.lit(0.5).alias("x"))
    out = ranked(df, ["g"], [F.desc("x"), F.asc("id")], limit=50)
    assert all(r["rank"] == r.id + 1 for r in out.collect())


def test_split_hot_keeps_every_row(spark):
    df = spark.createDataFrame(skewed_rows(), "g int, id int, x double, v int")
    ordinary, hot, rows = split_hot(df, ["g"], 100)
    assert rows == hot.count() and ordinary.count() + hot.count() == 900
    assert {r.g for r in hot.select("g").distinct().collect()} == {1}
    assert split_hot(df, ["g"], 1000)[1] is None


def test_no_single_partition_and_group_limit_in_plans(spark):
    df = spark.createDataFrame(skewed_rows(), "g int, id int, x double, v int")
    plan = ranked(df, ["g"], [F.desc("x"), F.asc("id")], limit=100)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    limited = top_rows(df, ["g"], [F.desc("x"), F.asc("id")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in limited


def walk(items, budget):
    """Plain walk: (score desc, pos), take what fits."""
    left, taken = budget, set()
    for score, pos, effort in sorted(items, key=lambda i: (-i[0], i[1])):
        if effort <= left:
            taken.add(pos)
            left -= effort
    return taken


@pytest.mark.parametrize("seed,budget,low", [(1, 300, 1), (2, 5000, 1), (4, 100000, 1), (6, 400, -3)])
def test_greedy_in_rounds_equals_the_walk(spark, seed, budget, low):
    rng = random.Random(seed)
    rows = [(1 if i % 3 else 2, i, float(rng.randint(0, 50)), float(rng.randint(low, 60))) for i in range(600)]
    rows += [(3, 1000 + i, float(i), 10.0) for i in range(8)]
    df = spark.createDataFrame(rows, "repo_id int, pos int, priority_score double, effort double").repartition(4)
    everything = sel.greedy_select(df, budget, limit=50).collect()
    got = [r for r in everything if r.selected]
    assert len(everything) == len(rows)
    want = {(g, p) for g in (1, 2, 3) for p in walk([(s, p, e) for r, p, s, e in rows if r == g], budget)}
    assert {(r.repo_id, r.pos) for r in got} == want


def test_greedy_result_is_within_budget_and_maximal(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.random(), float(rng.randint(1, 30))) for i in range(200)]
    df = spark.createDataFrame(rows, "repo_id int, pos int, priority_score double, effort double")
    out = sel.greedy_select(df, 500).collect()
    used = sum(r.effort for r in out if r.selected)
    assert used <= 500
    assert all(r.effort > 500 - used for r in out if not r.selected)


def knn(rows, k):
    out = {}
    for g, i, v in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for h, j, w in rows if h == g and j != i)
        out[i] = [(j, d) for d, j in near[:k]]
    return out


@pytest.mark.parametrize("seed,copies", [(1, 0), (2, 200)])
def test_neighbours_by_cells_equal_brute_force(spark, seed, copies):
    rng = random.Random(seed)
    rows = [(1 if i % 3 else 2, i, (float(rng.randint(0, 30)), float(rng.randint(0, 30)), float(rng.randint(0, 5)))) for i in range(400)]
    rows += [(1, 1000 + i, (7.0, 7.0, 1.0)) for i in range(copies)]
    df = spark.createDataFrame([(g, i, *v) for g, i, v in rows], "repo_id bigint, id bigint, a double, b double, c double")
    out = bal.minority_knn(df, ["a", "b", "c"], 4, group_limit=150, block_rows=40).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append((r.neighbour, r.d2))
    assert got == knn(rows, 4)


@pytest.mark.parametrize("cell_rows", [8, 30])
def test_neighbours_by_boxes_equal_brute_force(spark, cell_rows):
    """Many boxes, ties across them, a far row, a group of one value, and vectors that are not finite."""
    rng = random.Random(3)
    rows = [(1, i, (float(rng.randint(0, 12)), float(rng.randint(0, 12)), 5.0)) for i in range(300)] + [(1, 900, (1e6, -1e6, 0.0))]
    rows += [(2, 2000 + i, (3.0, 3.0, 3.0)) for i in range(120)] + [(2, 2500, (4.0, 3.0, 3.0))]
    df = spark.createDataFrame([(g, i, *v) for g, i, v in rows] + [(1, 5000, float("nan"), 0.0, 0.0)], "repo_id bigint, id bigint, a double, b double, c double")
    got = {}
    for r in sorted(bal.minority_knn(df, ["a", "b", "c"], 4, group_limit=3, block_rows=50, cell_rows=cell_rows).collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append((r.neighbour, r.d2))
    assert got == knn(rows, 4)


def test_neighbours_of_many_axes_stay_packed(spark):
    """Where boxes rule nothing out, all cells meet, and what the search hands on is a row for a pair of cells, not for a query and cell."""
    rng = random.Random(4)
    rows = [(1, i, tuple(rng.gauss(0, 1) for _ in range(24))) for i in range(200)]
    cols = [f"e{i}" for i in range(24)]
    df = spark.createDataFrame([(g, i, *v) for g, i, v in rows], "repo_id bigint, id bigint, " + ", ".join(f"{c} double" for c in cols))
    handed = []
    visits = bal._visits()

    def counted(frames):
        for frame in visits(frames):
            handed.append(len(frame))
            yield frame

    cells = bal._own_cell(3)
    import numpy as np
    import pandas as pd

    packed = pd.concat([cells(pd.DataFrame({"repo_id": [1], "cell": [c], "ids": [np.array([r[1] for r in rows[c::4]]).tobytes()], "vecs": [np.array([r[2] for r in rows[c::4]]).tobytes()],
                                            "heads": [np.ones(50, bool).tobytes()]})) for c in range(4)])
    boxes = [packed[["cell", "low", "high"]].to_dict("records")] * 4
    list(counted(iter([packed.assign(boxes=boxes)])))
    assert len(handed) <= 12 and set(handed) == {1}
    got = {}
    for r in sorted(bal.minority_knn(df, cols, 3, group_limit=50, block_rows=60, cell_rows=50).collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == {i: [j for j, _ in near] for i, near in knn(rows, 3).items()}


def test_top_share_cuts_through_ties_in_id_order(spark):
    rng = random.Random(3)
    rows = [("m", i, float(rng.randint(0, 3)) / 4, rng.randint(0, 1)) for i in range(97)]
    df = spark.createDataFrame(rows, "model_id string, id int, probability double, label int").repartition(3)
    table = ev.score_table(df, limit=2)
    got = ev.top_share(df, table, 0.2, limit=5).first()
    ordered = sorted(rows, key=lambda r: (-r[2], r[1]))
    want = sum(r[3] for r in ordered[:int(97 * 0.2)]) / sum(r[3] for r in rows)
    assert got.recall_top == pytest.approx(want) and got.popt == pytest.approx(want)


def test_fixes_before_a_row_of_a_hot_file(spark):
    rng = random.Random(4)
    rows = [(1, "hot" if i % 3 else f"f{i % 5}", i, rng.randint(0, 40)) for i in range(300)] + [(1, "hot", 999, None)]
    fixes = [(1, "hot" if i % 2 else f"f{i % 5}", rng.randint(0, 40), rng.random() < .6) for i in range(300)]
    metrics = spark.createDataFrame(rows, "repo_id int, filepath string, id bigint, created_at int")
    changed = spark.createDataFrame(fixes, "repo_id int, filepath string, committed_at int, is_bugfix boolean")
    got = {r.id: r.bug_history for r in ch.bug_history_before(metrics, changed, limit=50).collect()}
    assert got == {i: sum(b and g == f and at is not None and c < at for _, g, c, b in fixes) for _, f, i, at in rows}


def test_small_repositories_are_split_at_random(spark):
    rows = [(1, i) for i in range(10)] + [(2, i) for i in range(11)] + [(3, 0)]
    df = spark.createDataFrame(rows, "repo_id int, id int").withColumn("created_at", F.col("id"))
    got = {}
    for r in ft.split_dataset(df, 0.2).collect():
        got.setdefault(r.repo_id, {"train": [], "test": []})[r.split].append(r.id)
    assert sorted(got[2]["train"]) == list(range(8)) and sorted(got[2]["test"]) == [8, 9, 10]
    assert (len(got[1]["train"]), len(got[1]["test"])) == (8, 2)
    assert (len(got[3]["train"]), len(got[3]["test"])) == (0, 1)
    random_cut = {(r.repo_id, r.id, r.split) for r in ft.split_dataset(df, 0.2, temporal=False).collect()}
    assert {(r.repo_id, r.id, r.split) for r in ft.random_split(df, 0.2).collect()} == random_cut


def test_splits_of_a_hot_repository(spark):
    rows = [(1 if i % 4 else 2, i, i % 3 % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "repo_id int, id int, is_buggy int").withColumn("created_at", (F.col("id") % 50))
    for cut in (ft.temporal_split(df, limit=60), ft.random_split(df, limit=60), ft.stratified_split(df, limit=60)):
        plain = {(r.id, r.split) for r in cut.collect()}
        assert len(plain) == 400 and len({i for i, _ in plain}) == 400
    hot = {(r.id, r.split) for r in ft.temporal_split(df, limit=60).collect()}
    assert hot == {(r.id, r.split) for r in ft.temporal_split(df).collect()}
    folds = {(r.id, r.fold) for r in ft.with_folds(df, limit=60).collect()}
    assert folds == {(r.id, r.fold) for r in ft.with_folds(df).collect()}


def test_fractional_efforts_fit_alike_at_any_limit(spark):
    rows = [(1, i, f"t{i}", 1.0 - i / 1000, e) for i, e in enumerate([0.1, 0.2, 0.3, 0.1])]
    rows += [(2, i, f"u{i}", float((i * 7919) % 1000), ((i * 31) % 97 + 1) / 10) for i in range(400)] + [(2, 400, "none", 9999.0, None)]
    items = spark.createDataFrame(rows, "repo_id int, pos int, id string, score double, effort double")

    def chosen(repo, budget, limit):
        plan = sel.greedy_select(items.where(F.col("repo_id") == repo), budget, "score", limit=limit)
        return sorted(r.id for r in plan.where("selected").collect())

    assert chosen(1, 0.6, 100_000) == chosen(1, 0.6, 2) == ["t0", "t1", "t2"]
    assert chosen(2, 100.1, 100_000) == chosen(2, 100.1, 150) and "none" not in chosen(2, 100.1, 150)


def test_a_hot_null_group_is_split(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"), "id")
    ordinary, hot, rows = split_hot(df, ["k"], 1000)
    assert rows == 2000 and hot.count() == 2000 and ordinary.count() == 1000
    out = ranked(df, ["k"], [F.asc("v")], running={"s": F.lit(1)}, totals={"n": F.lit(1)}, limit=100).collect()
    assert len(out) == 3000 and all(r["rank"] == r.s for r in out)
    assert sorted(r["rank"] for r in out if r.k is None) == list(range(1, 2001))
    assert {r.n for r in out if r.k is None} == {2000}


def test_a_large_top_is_ranked(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"))
    top = top_rows(df, ["k"], [F.asc("v")], 2000, rank="place").collect()
    want = sorted((r.k, r.v) for r in df.collect())
    assert sorted((r.k, r.v) for r in top) == sorted(x for k in (0, 1) for x in [w for w in want if w[0] == k][:2000])


def test_settled_neighbours_are_not_ranked_again(spark):
    """Queries whose neighbours all lie in their own cell leave it as finished lists; the others stay rows."""
    rng = random.Random(4)
    rows = [(1, c * 1000 + i, (c * 1e6 + rng.randint(0, 50), c * 1e6 + rng.randint(0, 50))) for c in range(4) for i in range(100)]
    df = spark.createDataFrame([(g, i, list(v), True) for g, i, v in rows], "repo_id bigint, id bigint, vec array<double>, head boolean")
    settled, ranked_rows = bal._by_cells(df, 3, 50, 100)
    found = {r.q: [(x.id, x.d2) for x in r.near] for r in settled.collect()}
    assert ranked_rows.count() == 4 * (400 - len(found)) and len(found) >= 300
    want = knn(rows, 3)
    assert all(near[0] == (q, 0.0) or (q, 0.0) in near for q, near in found.items())
    assert all([x for x in near if x[0] != q][:3] == want[q] for q, near in found.items() if near[0][1] == 0 and near[1][1] > 0)


@pytest.mark.parametrize("group_limit", [20, 5000])
def test_neighbours_with_copies_and_repeated_ids(spark, group_limit):
    """Copies beyond those that can be neighbours, ids that stand twice, and null ids and repositories."""
    rng = random.Random(6)
    rows = [(1, i, (float(rng.randint(0, 6)), float(rng.randint(0, 6)))) for i in range(200)]
    schema = "repo_id bigint, id bigint, a double, b double"
    df = spark.createDataFrame([(g, i, *v) for g, i, v in rows] + [(None, 900, 1.0, 1.0)], schema)
    got = {}
    for r in sorted(bal.minority_knn(df, ["a", "b"], 3, group_limit=group_limit, block_rows=40, cell_rows=16).where("repo_id = 1").collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append((r.neighbour, r.d2))
    assert got == knn(rows, 3)
    twice = df.where("repo_id = 1").unionByName(df.where("id = 7"))
    again = bal.minority_knn(twice, ["a", "b"], 3, group_limit=group_limit, block_rows=40, cell_rows=16)
    assert {(r.id, r.place) for r in again.collect()} == {(i, p) for i in range(200) for p in (1, 2, 3)} and again.count() == 600


def test_rows_do_not_move_to_meet_the_facts_of_their_repository(spark):
    """A row a repository is broadcast: a join of all rows by repository would bring each to a few tasks."""
    rows = [(g, g * 100 + i, int(i % 4 == 0), float(i)) for g in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "repo_id bigint, id bigint, is_buggy int, a double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bal.minority_rows(df)._jdf.queryExecution().executedPlan().toString()
        balanced = bal.smote(df, ["a"])
        counts = {(r.repo_id, r.is_buggy): r["count"] for r in balanced.groupBy("repo_id", "is_buggy").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert counts == {(g, b): 30 for g in range(3) for b in (0, 1)}
    assert bal.minority_rows(df).count() == 30


def test_labels_need_no_sort_of_the_metric_rows(spark):
    metrics = spark.createDataFrame([(1, i, f"f{i}") for i in range(9)], "repo_id bigint, id bigint, filepath string")
    changes = spark.createDataFrame([(1, "f1", True), (1, "f1", True), (1, "f2", False)], "repo_id bigint, filepath string, is_bugfix boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ch.with_bug_labels(metrics, changes)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.is_buggy for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert got == {i: int(i == 1) for i in range(9)}


def test_feature_table_reads_the_metrics_once(spark):
    """The history before each row measures its groups, then counts: the metric rows behind it are worked out once."""
    from defectscope.plans.dataset import feature_table

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    metrics = spark.createDataFrame([(1, i, f"f{i % 3}", 1.0) for i in range(6)], "repo_id bigint, id bigint, filepath string, wmc double")
    metrics = metrics.mapInArrow(counted, metrics.schema).withColumn("created_at", F.lit("2024-01-02").cast("timestamp_ntz"))
    files = spark.createDataFrame([(1, 1, "f1")], "commit_id bigint, repo_id bigint, filepath string")
    commits = spark.createDataFrame([(1, 1, "x", True)], "id bigint, repo_id bigint, author_name string, is_bugfix boolean")
    commits = commits.withColumn("committed_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.id: (r.bug_history, r.is_buggy) for r in feature_table(metrics, files, commits).collect()}
    assert got == {i: (1, 1) if i % 3 == 1 else (0, 0) for i in range(6)}
    assert seen.value == 6
