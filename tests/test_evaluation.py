"""Rank metrics and selections with values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from defectscope.operators import balance as bal
from defectscope.operators import evaluate as ev
from defectscope.operators import selection as sel


def preds(spark, labels, probabilities):
    rows = [("m", i, y, p) for i, (y, p) in enumerate(zip(labels, probabilities))]
    return spark.createDataFrame(rows, "model_id string, id bigint, label int, probability double")


def test_areas_with_ties(spark):
    table = ev.score_table(preds(spark, [1, 0, 1, 0, 1], [.9, .9, .5, .2, .2]))
    assert ev.roc_auc(table).first().roc_auc == pytest.approx(0.5)
    assert ev.average_precision(table).first().pr_auc == pytest.approx(0.5888888888)


def test_area_equals_pair_counting(spark):
    rng = random.Random(5)
    y = [rng.randint(0, 1) for _ in range(60)]
    p = [rng.randint(0, 9) / 10 for _ in y]
    pairs = [(a, b) for a, ya in zip(p, y) if ya for b, yb in zip(p, y) if not yb]
    want = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert ev.roc_auc(ev.score_table(preds(spark, y, p))).first().roc_auc == pytest.approx(want)


def test_one_class_and_no_positives(spark):
    df = preds(spark, [0, 0, 0], [.9, .4, .1])
    table = ev.score_table(df)
    assert ev.roc_auc(table).first().roc_auc == 0.0
    assert ev.roc_auc(table, one_class=0.5).first().roc_auc == 0.5
    row = ev.classification_metrics(ev.confusion(table)).first()
    assert (row.tn, row.fp, row.fn, row.tp, row.precision, row.recall, row.f1) == (2, 1, 0, 0, 0.0, 0.0, 0.0)
    assert row.matrix == [[2, 1], [0, 0]]
    top = ev.top_share(df, table).first()
    assert (top.recall_top, top.popt) == (0.0, 0.0)
    assert ev.optimal_threshold(table).first().threshold == 0.5


@pytest.mark.parametrize("n,popt_items", [(4, 0), (5, 1), (9, 1), (10, 2)])
def test_top_share_boundaries(spark, n, popt_items):
    df = preds(spark, [1] * n, [1 - i / 20 for i in range(n)])
    top = ev.top_share(df, ev.score_table(df)).first()
    assert top.popt == pytest.approx(popt_items / n)
    assert top.recall_top == pytest.approx(max(1, popt_items) / n)


@pytest.mark.parametrize("metric", ["f1", "accuracy"])
def test_threshold_equals_a_plain_sweep(spark, metric):
    rng = random.Random(7)
    y = [rng.randint(0, 1) for _ in range(80)]
    p = [min(1.0, max(0.0, rng.gauss(.35 + .3 * v, .25))) for v in y] 
    grid = [0.1 + i * ((0.9 - 0.1) / 49) for i in range(49)] + [0.9]
    p[:3] = [grid[10], grid[20], grid[49]]
    best, at = 0, 0.5
    for t in grid:
        tp = sum(v and q >= t for v, q in zip(y, p))
        fp = sum((not v) and q >= t for v, q in zip(y, p))
        fn = sum(y) - tp
        score = (2 * tp / (2 * tp + fp + fn) if tp else 0) if metric == "f1" else (len(y) - fp - fn) / len(y)
        if score > best:
            best, at = score, t
    got = ev.optimal_threshold(ev.score_table(preds(spark, y, p)), metric).first()
    assert got.threshold == at and got.best_score == pytest.approx(best)


def items(spark, rows):
    df = spark.createDataFrame(rows, "repo_id int, pos int, id string, risk double, effort double, criticite double, coverage_gap double, mandatory boolean, excluded boolean")
    return sel.with_priority_score(df)


def plan_of(spark, rows, budget):
    out = sel.with_reason(sel.constrained_select(items(spark, rows), budget), budget)
    return {r.id: (r["rank"], r.selected, r.selection_reason) for r in out.collect()}


def test_five_items_all_fit(spark):
    rows = [(1, i, f"f{i}", r, e, c, 0.0, False, False) for i, (r, e, c) in enumerate(
        [(.85, 150., 1.5), (.72, 200., 1.2), (.65, 100., 1.0), (.58, 80., .8), (.45, 120., 1.1)])]
    got = plan_of(spark, rows, 1000)
    scores = {f"f{i}": (r + .5 * c) / e ** .5 for i, (r, e, c) in enumerate(
        [(.85, 150., 1.5), (.72, 200., 1.2), (.65, 100., 1.0), (.58, 80., .8), (.45, 120., 1.1)])}
    order = sorted(scores, key=lambda k: -scores[k])
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1][0])] == order
    assert {v[1:] for v in got.values()} == {(True, "Selected by optimization")}
    summary = sel.plan_summary(sel.greedy_select(items(spark, rows), 1000), 1000).first()
    assert (summary.effort_selected, summary.items_selected, summary.items_total, summary.utilization_pct) == (650.0, 5, 5, 65.0)


def test_skip_and_continue(spark):
    rows = [(1, 0, "a", 9.0, 60.0, 0.0, 0.0, False, False), (1, 1, "b", 5.0, 50.0, 0.0, 0.0, False, False), (1, 2, "c", 1.0, 40.0, 0.0, 0.0, False, False)]
    got = plan_of(spark, rows, 100)
    assert [got[k][1] for k in "abc"] == [True, False, True]
    assert got["b"][2] == "Budget exceeded"


def test_equal_scores_keep_list_order(spark):
    rows = [(1, 5, "late", 1.0, 10.0, 1.0, 0.0, False, False), (1, 2, "early", 1.0, 10.0, 1.0, 0.0, False, False)]
    got = plan_of(spark, rows, 10)
    assert got["early"][:2] == (1, True) and got["late"][:2] == (2, False)


def test_constraints_and_reasons(spark):
    rows = [(1, 0, "must", 0.1, 80.0, 0.0, 0.0, True, False), (1, 1, "never", 9.0, 10.0, 0.0, 0.0, False, True),
            (1, 2, "fits", 5.0, 20.0, 0.0, 0.0, False, False), (1, 3, "big", 4.0, 50.0, 0.0, 0.0, False, False)]
    got = {k: v[1:] for k, v in plan_of(spark, rows, 100).items()}
    # Reasons go by the effort selected so far in rank order, so `big` does not yet see `must`.
    assert got == {"must": (True, "Mandatory item"), "never": (False, "Excluded by constraint"),
                   "fits": (True, "Selected by optimization"), "big": (False, "Lower priority")}


def test_infeasible_constraints_are_ignored(spark):
    both = [(1, 0, "both", 1.0, 10.0, 0.0, 0.0, True, True), (1, 1, "x", 2.0, 95.0, 0.0, 0.0, False, True)]
    assert {k: v[1] for k, v in plan_of(spark, both, 100).items()} == {"both": True, "x": False}
    heavy = [(1, 0, "m", 0.1, 200.0, 0.0, 0.0, True, False), (1, 1, "x", 2.0, 95.0, 0.0, 0.0, False, True)]
    assert {k: v[1] for k, v in plan_of(spark, heavy, 100).items()} == {"m": False, "x": True}


def test_missing_values_and_weights(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.5, 0.25, None, None)], "repo_id int, pos int, id string, risk double, effort double, criticite double, coverage_gap double")
    assert sel.with_priority_score(df).first().priority_score == pytest.approx(0.5 + 0.5)
    assert sel.with_priority_score(df, {"crit": 0.0}).first().priority_score == pytest.approx(0.5)


def test_predictions_become_items(spark):
    df = spark.createDataFrame([(1, i, f"f{i}", None if i == 1 else i / 100, 0.4 if i < 2 else None) for i in range(60)],
                               "repo_id int, pos int, id string, probability double, risk_score double")
    out = sel.predictions_to_items(df).collect()
    assert len(out) == 50 and {r.effort for r in out} == {100.0} and {r.pos for r in out} == set(range(1, 51))
    assert {r.id: r.risk for r in out}["f1"] == 0.4


def rows_for_smote(pos, neg):
    rng = random.Random(1)
    return [(1, i, int(i < pos), rng.random() * 10, rng.random()) for i in range(pos + neg)]


SMOTE = "repo_id bigint, id bigint, is_buggy int, a double, b double"


def test_oversampling_balances_between_neighbours(spark):
    df = spark.createDataFrame(rows_for_smote(7, 40), SMOTE)
    new = bal.synthetic_rows(df, ["a", "b"]).collect()
    base = {r.id: r for r in df.collect()}
    assert len(new) == 33
    for r in new:
        x, y = base[r.base], base[r.neighbour]
        assert x.is_buggy == y.is_buggy == 1 and x.id != y.id
        for c in "ab":
            assert min(x[c], y[c]) - 1e-9 <= r[c] <= max(x[c], y[c]) + 1e-9
    again = bal.synthetic_rows(df.repartition(7), ["a", "b"]).collect()
    assert sorted(map(tuple, new)) == sorted(map(tuple, again))


@pytest.mark.parametrize("pos,neg", [(1, 9), (9, 1), (2, 3), (5, 5)])
def test_oversampling_leaves_small_or_even_classes(spark, pos, neg):
    df = spark.createDataFrame(rows_for_smote(pos, neg), SMOTE)
    assert bal.synthetic_rows(df, ["a", "b"]).count() == 0


def test_oversampling_few_rows_needing_many_copies(spark):
    df = spark.createDataFrame(rows_for_smote(2, 25_000), SMOTE)
    out = bal.smote(df, ["a", "b"], renumber=False)
    assert {r.is_buggy: r["count"] for r in out.groupBy("is_buggy").count().collect()} == {0: 25_000, 1: 25_000}


def test_renumbered_dataset(spark):
    df = spark.createDataFrame(rows_for_smote(7, 20), SMOTE).withColumn("filepath", F.lit("p"))
    out = bal.smote(df, ["a", "b"], renumber=True).collect()
    assert sorted(r.file_id for r in out) == list(range(40))
    assert {r.filepath for r in out} == {f"synthetic_{i}" for i in range(40)}


def test_synthetic_rows_are_numbered_by_copy_and_id(spark):
    """The numbers that sorting originals and copies by (copy, id) gives, without sorting the copies."""
    rows = rows_for_smote(7, 40)
    out = bal.smote(spark.createDataFrame(rows, SMOTE).withColumn("filepath", F.lit("p")), ["a", "b"], renumber=True).collect()
    for repo in {r.repo_id for r in out}:
        own = sorted((r.copy, r.id, r.file_id) for r in out if r.repo_id == repo)
        assert [n for *_, n in own] == list(range(len(own)))


def test_copies_are_made_after_the_last_shuffle_and_the_search_runs_once(spark):
    df = spark.createDataFrame(rows_for_smote(7, 400), SMOTE)
    plan = bal.synthetic_rows(df, ["a", "b"])._jdf.queryExecution().sparkPlan().toString().split("\n")
    copies = next(i for i, line in enumerate(plan) if "explode(sequence(first" in line)
    # Above the copies there are only projections; below them no search, but what it has left.
    assert not any(x in line for line in plan[:copies] for x in ("Exchange", "Join", "Aggregate", "Window", "Sort"))
    assert not any(x in line for line in plan for x in ("Pandas", "Arrow"))


def test_cuts_are_broadcast_to_the_raw_predictions(spark):
    """Only rows at a cut leave their partitions."""
    preds = spark.range(0, 3000, 1, 4).select((F.col("id") % 3).alias("model_id"), "id", (F.col("id") % 5 == 0).cast("int").alias("label"), ((F.col("id") * 37) % 50 / 50).alias("probability"))
    plan = ev.top_share(preds, ev.score_table(preds))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_statistics_of_groups_need_their_keys(spark):
    from defectscope.operators import features as ft

    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "repo_id bigint, a double")
    stats = ft.fit_scaler(df, ["a"], ["repo_id"])
    assert sorted(r.a for r in ft.scale(df, ["a"], stats, ["repo_id"]).collect()) == [-1.0, 0.0, 1.0]
    with pytest.raises(ValueError, match="repo_id"):
        ft.scale(df, ["a"], stats)


def test_selection_bound_is_above_every_selection(spark):
    """Against all subsets of small groups, with constraints, ties, free items and missing efforts."""
    from itertools import product

    from defectscope.operators import selection as sel

    own = random.Random(4)
    rows = []
    for repo in range(12):
        for pos in range(9):
            effort = own.choice([0.0, 10.0, 25.5, 40.0, 70.0, None]) if repo % 3 else float(own.randint(5, 60))
            rows.append((repo, pos, f"i{pos}", own.choice([0.0, 0.3, 0.5, 1.7, 2.0, -0.4]), effort, repo % 4 == 1 and pos < 2, repo % 4 == 2 and pos == 4))
    rows.append((99, 0, "x", 0.0, None, False, False))
    items = spark.createDataFrame(rows, "repo_id bigint, pos bigint, id string, priority_score double, effort double, mandatory boolean, excluded boolean")
    for limits in ({}, {"limit": 4}):
        found = {r.repo_id: r for r in sel.selection_gap(sel.constrained_select(items, 100.0), 100.0, **limits).collect()}
        assert len(found) == 13
        for repo in range(12):
            own_rows = [r for r in rows if r[0] == repo]
            ok = sum(r[4] or 0 for r in own_rows if r[5]) <= 100
            best = 0.0
            for picks in product((0, 1), repeat=9):
                taken = [r for r, p in zip(own_rows, picks) if p]
                if any(r[4] is None and not (ok and r[5]) for r in taken) or sum(r[4] or 0 for r in taken) > 100:
                    continue
                if ok and (any(r[6] for r in taken) or any(r[5] for r, p in zip(own_rows, picks) if not p)):
                    continue
                best = max(best, sum(r[3] for r in taken))
            r = found[repo]
            largest = max((x[3] for x in own_rows), default=0)
            assert r.bound >= best - 1e-9 and r.bound >= r.selected_score - 1e-9 and r.gap >= -1e-9
            assert r.bound <= best + largest + 1e-9  # one item cut
