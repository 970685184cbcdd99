"""Properties of datasets, fits, scores and the whole flow on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from checks.learning import flow, halves
from checks.registry import Tables
from defectscope.plans import flow as fl
from defectscope.plans import training as tr
from defectscope.schemas import FEATURE_COLUMNS
from defectscope.sources import registry

SF = "/root/testdata/sf0.001"
# Small forests keep these tests short.
SMALL = {"n_estimators": 10, "max_depth": 5}


@pytest.fixture(scope="module")
def split(spark):
    train, test = halves(Tables(spark, SF))
    return train.persist(), test.persist()


@pytest.fixture(scope="module")
def model(split):
    return tr.fit(tr.prepared(split[0], FEATURE_COLUMNS), FEATURE_COLUMNS, "rf", SMALL)


def test_training_reports_consistent_metrics(spark, split):
    train, test = split
    _, metrics, chosen = tr.train_auto(train, test, tr.TrainConfig(family="auto", n_trials=0, params={"n_estimators": 3, "max_depth": 3}), FEATURE_COLUMNS)
    row = metrics.first()
    assert chosen["family"] == "xgb"
    assert row.tn + row.fp + row.fn + row.tp == test.count()
    assert row.accuracy == pytest.approx((row.tn + row.tp) / test.count())
    for name in ("roc_auc", "pr_auc", "recall_top", "popt", "f1"):
        assert 0.0 <= row[name] <= 1.0


def test_training_without_a_test_frame(spark, split):
    _, metrics, _ = tr.train_auto(split[0], None, tr.TrainConfig(family="rf", n_trials=0, params=SMALL), FEATURE_COLUMNS)
    row = metrics.first()
    assert 0 < row.tn + row.fp + row.fn + row.tp < split[0].count()


def test_a_fit_reads_even_partitions_on_every_core(spark, split, model):
    train = tr.prepared(split[0], FEATURE_COLUMNS).coalesce(1)
    cores, rows = spark.sparkContext.defaultParallelism, train.count()
    sizes = [len(part) for part in tr.dealt(train, FEATURE_COLUMNS, rows).select("label").rdd.glom().collect()]
    assert len(sizes) == cores and sum(sizes) == rows and max(sizes) - min(sizes) <= cores
    assert tr.dealt(train, FEATURE_COLUMNS, cores * tr.PARTITION_ROWS + 1).rdd.getNumPartitions() == 2 * cores
    # Kept node numbers are bounded.
    assert model.stages[-1].getCacheNodeIds()
    assert not tr.make_estimator("rf", {"n_estimators": 400}, tr.KEPT_NODES // 400 + 1).getCacheNodeIds()


def test_tuning_is_repeatable_and_survives_bad_trials(spark, split):
    train = tr.prepared(split[0], FEATURE_COLUMNS)
    best, trials = tr.tune(train, FEATURE_COLUMNS, "rf", n_trials=2, folds=2, fixed={"n_estimators": 3, "max_depth": 3})
    again, same = tr.tune(train, FEATURE_COLUMNS, "rf", n_trials=2, folds=2, fixed={"n_estimators": 3, "max_depth": 3})
    assert best == again and trials == same and all(0 < t["score"] <= 1 for t in trials)
    _, bad = tr.tune(train, FEATURE_COLUMNS, "rf", n_trials=1, folds=3, fixed={"max_depth": 99})
    assert bad[0]["score"] == 0.0
    assert tr.tune(train, FEATURE_COLUMNS, "rf", n_trials=0) == ({}, [])


def test_search_ranges():
    import random

    rng = random.Random(1)
    for _ in range(200):
        boosted, forest, linear = (tr.sample_params(f, rng) for f in ("xgb", "rf", "logreg"))
        assert 50 <= boosted["n_estimators"] <= 300 and 3 <= boosted["max_depth"] <= 10 and .01 <= boosted["learning_rate"] <= .3
        assert 50 <= forest["n_estimators"] <= 300 and 3 <= forest["max_depth"] <= 20 and 0.01 <= linear["C"] <= 10


def test_scores_and_uncertainty(spark, split, model):
    out = tr.score(split[1], model, 0.3, FEATURE_COLUMNS, uncertainty=True).collect()
    assert len(out) == split[1].count()
    for r in out:
        assert r.prediction == int(r.probability >= 0.3) and r.risk_score == r.probability
        assert r.uncertainty == pytest.approx(1 - 2 * abs(r.probability - 0.5))
        assert r.id.startswith("src/")


def test_importance_falls_back_for_linear_models(spark, split, model):
    top = tr.feature_importance(spark, model, FEATURE_COLUMNS, 5).collect()
    assert len(top) == 5 and top == sorted(top, key=lambda r: -abs(r.importance))
    linear = tr.fit(tr.prepared(split[0], FEATURE_COLUMNS), FEATURE_COLUMNS, "logreg")
    rows = tr.feature_importance(spark, linear, FEATURE_COLUMNS, 3).collect()
    assert [(r.feature, r.importance) for r in rows] == [(c, 1 / (i + 1)) for i, c in enumerate(FEATURE_COLUMNS[:3])]


def test_saved_model_scores_alike(spark, split, model, tmp_path):
    registry.save_model(model, str(tmp_path / "m"), FEATURE_COLUMNS, 0.4)
    loaded, cols, threshold = registry.load_model(spark, str(tmp_path / "m"))
    assert cols == FEATURE_COLUMNS and threshold == 0.4
    a = tr.score(split[1], model, threshold, cols).agg(F.sum("probability")).first()[0]
    assert tr.score(split[1], loaded, threshold, cols).agg(F.sum("probability")).first()[0] == pytest.approx(a)


def test_best_of_families_keeps_the_highest_accuracy(spark, split):
    _, table, best = tr.train_best(*split, "auto", cols=FEATURE_COLUMNS, overrides=dict.fromkeys(tr.CANDIDATES, {"n_estimators": 2, "max_depth": 2}), refit_trees=3)
    rows = table.collect()
    assert [r.family for r in rows][:4] == ["xgb", "lgbm", "rf", "gb"] and rows[4].family.endswith("_refit")
    assert best["accuracy"] == max(r.accuracy for r in rows)
    assert tr.candidate_families("logreg") == ["plain"]


def test_a_failing_family_leaves_the_others(spark, split):
    small = {"n_estimators": 2, "max_depth": 2}
    overrides = {"xgb": {"max_depth": 99}, "lgbm": small, "rf": small, "gb": {"n_estimators": -1}}
    _, table, _ = tr.train_best(*split, "auto", target=0, cols=FEATURE_COLUMNS, overrides=overrides)
    assert [r.family for r in table.collect()] == ["lgbm", "rf"]
    with pytest.raises(Exception):
        tr.train_best(*split, "xgb", cols=FEATURE_COLUMNS, overrides=overrides)


def test_scaler_is_part_of_the_model(spark, split):
    model = tr.fit(tr.prepared(split[0], FEATURE_COLUMNS), FEATURE_COLUMNS, "rf", SMALL, scaled=True)
    scaled = model.stages[0].transform(tr.prepared(split[0], FEATURE_COLUMNS))
    row = scaled.agg(F.avg("loc__scaled").alias("m"), F.stddev_pop("loc__scaled").alias("s")).first()
    assert row.m == pytest.approx(0, abs=1e-9) and row.s == pytest.approx(1)
    assert tr.score(split[1], model, 0.5, FEATURE_COLUMNS).count() == split[1].count()


def test_flow_reports_every_step(spark):
    result = flow(Tables(spark, SF))
    assert [(s, r) for s, r, _ in result.steps] == [(s, "success") for s in ("features", "training", "prediction", "prioritization")]
    plan = result.plan.where("selected").groupBy("repo_id").agg(F.sum("effort").alias("e"), F.count("*").alias("n")).collect()
    assert all(r.e <= 1000 and r.n <= 10 for r in plan)
    assert result.plan.count() == result.predictions.count()


def test_flow_keeps_earlier_steps_when_training_fails(spark):
    t = Tables(spark, SF)
    cfg = fl.FlowConfig(training=tr.TrainConfig(family="rf", n_trials=0, params={"max_depth": 99}))
    from checks.relational import commits

    result = fl.run_flow(spark, t.fx_file_metrics, t.fx_files, commits(t), cfg)
    assert [(s, r) for s, r, _ in result.steps] == [("features", "success"), ("training", "failed")]
    assert result.dataset.count() > 0 and result.plan is None


def test_a_flow_resumes_at_the_step_that_failed(spark, tmp_path, monkeypatch):
    from checks.relational import commits

    t = Tables(spark, SF)
    cfg = fl.FlowConfig(training=tr.TrainConfig(family="rf", n_trials=0, params=SMALL), store=str(tmp_path / "store"))

    def run(cfg=cfg):
        result = fl.run_flow(spark, t.fx_file_metrics, t.fx_files, commits(t), cfg)
        return result, [(s, r) for s, r, _ in result.steps]

    def stopped(*args, **options):
        raise RuntimeError("stopped")

    steps = ("features", "training", "prediction", "prioritization")
    real = fl.sel.greedy_select
    monkeypatch.setattr(fl.sel, "greedy_select", stopped)
    first, status = run()
    assert status == [*((s, "success") for s in steps[:3]), ("prioritization", "failed")]
    monkeypatch.setattr(fl.sel, "greedy_select", real)
    # From here on nothing may be built, fitted or scored again.
    for name in ("build_dataset", "train_auto", "score"):
        monkeypatch.setattr(fl, name, stopped)
    second, status = run()
    assert status == [(s, "success") for s in steps]
    assert second.steps[:3] == first.steps[:3]
    assert second.metrics.first() == first.metrics.first() and second.predictions.count() == first.predictions.count() == second.plan.count()
    # A finished flow is read, and records no second run, model or dataset.
    third, status = run()
    assert status == [(s, "success") for s in steps] and sorted(third.plan.collect()) == sorted(second.plan.collect())
    repos = second.plan.select("repo_id").distinct().count()
    assert registry.read_runs(spark, f"{cfg.store}/runs").count() == repos and spark.read.parquet(f"{cfg.store}/registry").count() == 1
    # Other settings are another flow.
    _, status = run(fl.FlowConfig(training=tr.TrainConfig(family="rf", n_trials=0, params=SMALL, seed=1), store=cfg.store))
    assert status == [("features", "failed")]


def test_a_logistic_fit_is_its_optimum(spark, split, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.feature import VectorAssembler

    cols = ["change_frequency", "author_count", "fan_in"]
    train = tr.prepared(split[0], cols)
    n = train.count()
    model = tr.fit(train, cols, "logreg", {"C": 0.05})
    own = model.stages[-1]
    assert isinstance(own, LogisticRegressionModel) and own.getRegParam() == pytest.approx(1 / (0.05 * n)) and own.numFeatures == 3
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(train)
    theirs = LogisticRegression(regParam=1 / (0.05 * n), maxIter=1000, tol=1e-12, standardization=False).fit(data)
    assert own.coefficients.toArray() == pytest.approx(theirs.coefficients.toArray(), abs=1e-5) and own.intercept == pytest.approx(theirs.intercept, abs=1e-5)
    # Spark's search has no part in it: a search that may not move still gives the optimum.
    assert tr.fit_logistic(train, cols, LogisticRegression(maxIter=0), 0.05).coefficients.toArray() == pytest.approx(own.coefficients.toArray())
    registry.save_model(model, str(tmp_path / "m"), cols, 0.5)
    loaded = registry.load_model(spark, str(tmp_path / "m"))[0]
    assert sorted(tr.score(split[1], loaded, 0.5, cols).collect()) == sorted(tr.score(split[1], model, 0.5, cols).collect())
    # One class has no optimum: left to Spark.
    assert tr.fit_logistic(train.where("label = 1"), cols, LogisticRegression(), 1.0) is None
    assert tr.fit(train.where("label = 1"), cols, "logreg").transform(tr.prepared(split[1], cols)).where("prediction = 0").count() == 0
