"""One model a repository: against a plain Newton method, Spark ML, and across the ways to fit."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from defectscope.plans import repo_models as rm

COLS = ["a", "b", "c"]


def rows(spark, repos=6, n=120, seed=1):
    own = np.random.default_rng(seed)
    out = []
    for repo in range(repos):
        x = own.normal(0, 1, (n + 10 * repo, 3)) * [1, 50, 0.01] + [0, 7, 3]
        z = (x[:, 0] * (repo - 2) + x[:, 1] / 50) + own.normal(0, 1, len(x))
        out += [(repo, repo * 10_000 + k, int(v > 0.5), *map(float, r)) for k, (r, v) in enumerate(zip(x, z))]
    out += [(100, 1_000_000 + k, 1, 1.0, float(k), 2.0) for k in range(5)]  # one class
    out += [(101, 1_100_000 + k, 0, 1.0, float(k), 2.0) for k in range(3)]
    out += [(102, 1_200_000 + k, k % 2, 5.0, None if k % 3 else float("nan"), float("inf") if k == 4 else 1.0) for k in range(30)]
    out += [(None, 5, 1, 1.0, 2.0, 3.0), (0, 6, None, 1.0, 2.0, 3.0)]
    return spark.createDataFrame(out, "repo_id bigint, id bigint, is_buggy int, a double, b double, c double")


def optimum(x, y, c):
    """Plain Newton on standardized columns."""
    d = x.std(0)
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / np.where(d == 0, 1, d)])
    beta, penalty = np.zeros(x.shape[1]), np.r_[0, np.ones(x.shape[1] - 1)] / c
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-12), x.T @ (p - y) + penalty * beta)
    return beta


def test_models_are_the_optimum_of_each_repository(spark):
    frame = rows(spark)
    data = frame.where("repo_id < 100 and is_buggy is not null").toPandas()
    for block_rows in (20_000, 40):  # one block a repository, and several
        found = {r.repo_id: r for r in rm.fit_repo_models(frame, COLS, c=0.7, block_rows=block_rows).collect()}
        assert set(found) == {0, 1, 2, 3, 4, 5, 100, 101, 102}
        for repo, own in data.groupby("repo_id"):
            want = optimum(own[COLS].to_numpy(), own.is_buggy.to_numpy(), 0.7)
            assert np.allclose([found[repo].intercept, *found[repo].coefficients], want, atol=1e-7)
            assert found[repo].converged and (found[repo].n, found[repo].positives) == (len(own), own.is_buggy.sum())
        assert (found[100].intercept, found[101].intercept) == (float("inf"), float("-inf")) and found[100].coefficients == [0, 0, 0]
        assert found[102].converged


def test_models_equal_spark_ml(spark):
    frame = rows(spark).where("repo_id = 4")
    n = frame.count()
    own = rm.fit_repo_models(frame, COLS, c=1.0)
    scored = rm.score_repo_models(frame, own, COLS).select("id", "probability")
    mean = frame.select([F.avg(c).alias(c) for c in COLS]).first()
    std = frame.select([F.stddev_pop(c).alias(c) for c in COLS]).first()
    scaled = VectorAssembler(inputCols=COLS, outputCol="features").transform(
        frame.withColumns({c: (F.col(c) - mean[c]) / std[c] for c in COLS}).withColumn("label", F.col("is_buggy").cast("double")))
    theirs = LogisticRegression(regParam=1 / n, standardization=False, maxIter=500, tol=1e-12).fit(scaled).transform(scaled)
    theirs = {r.id: r.probability[1] for r in theirs.select("id", "probability").collect()}
    assert all(abs(theirs[r.id] - r.probability) < 1e-5 for r in scored.collect())


def test_search_is_the_same_in_one_block_and_in_many(spark):
    frame = rows(spark, repos=3)
    a, b = ({r.repo_id: r for r in rm.fit_repo_models(frame, COLS, n_trials=4, folds=3, block_rows=size).collect()} for size in (20_000, 50))
    assert set(a) == set(b)
    for repo in (0, 1, 2):
        assert a[repo].c == b[repo].c and a[repo].cv_auc == pytest.approx(b[repo].cv_auc, abs=1e-9)
        assert np.allclose(a[repo].coefficients, b[repo].coefficients, atol=1e-7)
        assert 0.5 < a[repo].cv_auc <= 1


def test_search_of_many_blocks_begins_near_its_optima_and_is_spread(spark, monkeypatch):
    frame, states, tables, written, spread_out = rows(spark, repos=2, n=1500), [], {}, rm.written, rm._spread_out

    def kept(df, name):
        tables[name] = written(df, name)
        return tables[name]

    def watched(*given):
        states.append(spread_out(*given))
        return states[-1]

    monkeypatch.setattr(rm, "written", kept)
    monkeypatch.setattr(rm, "_spread_out", watched)
    found = rm.fit_repo_models(frame.where("repo_id < 2"), COLS, n_trials=4, folds=3, block_rows=100)
    assert {r.converged for r in found.collect()} == {True}
    guide, search, final = (s.agg(F.count(F.lit(1)), F.max("iterations"), F.min("done")).first() for s in states)
    assert (guide[0], search[0], final[0]) == (2, 2 * 4 * 3, 2) and guide[2] and search[2] and final[2]
    assert search[1] < guide[1] and final[1] < guide[1]
    # Few bytes, a lot of arithmetic: one small file would be one task.
    assert len(tables["blocks"].inputFiles()) > 4


def test_search_takes_the_best_trial(spark):
    from defectscope.operators.features import clean_numeric, with_folds

    frame = rows(spark, repos=2).where("repo_id < 2 and is_buggy is not null")
    found = {r.repo_id: r for r in rm.fit_repo_models(frame, COLS, n_trials=5, folds=3).collect()}
    folded = with_folds(clean_numeric(frame, COLS, "bound"), 3).toPandas()
    import random

    own = random.Random(42)
    draws = [rm.sample_params("logreg", own)["C"] for _ in range(5)]
    for repo, data in folded.groupby("repo_id"):
        x, y, fold = data[COLS].to_numpy(), data.is_buggy.to_numpy(), data.fold.to_numpy()
        x = (x - x.mean(0)) / x.std(0)
        scores = []
        for c in draws:
            areas = []
            for k in range(3):
                beta = rm.solved(rm.Block(np.column_stack([np.ones(len(x)), x]), y.astype(float), fold.astype(np.int32)), [c], [k], 60).accepted[:, 0]
                z = np.column_stack([np.ones(len(x)), x])[fold == k] @ beta
                pos, neg = z[y[fold == k] == 1], z[y[fold == k] == 0]
                areas.append(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))
            scores.append(np.mean(areas))
        assert found[repo].c == draws[int(np.argmax(scores))] and found[repo].cv_auc == pytest.approx(max(scores), abs=1e-9)


def test_train_and_measure(spark):
    frame = rows(spark)
    train, test = frame.where("id % 4 > 0"), frame.where("id % 4 = 0")
    models, metrics = rm.train_repo_models(train, test, COLS, n_trials=3, folds=3)
    found = {r.model_id: r for r in metrics.collect()}
    assert {"repo_0", "repo_5"} <= set(found) and models.count() == 9
    for repo in (0, 4, 5):
        r = found[f"repo_{repo}"]
        assert r.tn + r.fp + r.fn + r.tp == test.where(f"repo_id = {repo} and is_buggy is not null").count() or repo == 0
        assert r.roc_auc > 0.6
    assert rm.fit_repo_models(frame.limit(0), COLS).count() == 0


def test_no_jobs_for_each_repository(spark):
    """As many jobs for forty repositories as for four."""
    jobs = []
    for repos in (4, 40):
        frame = rows(spark, repos=repos, n=40)
        before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
        rm.fit_repo_models(frame, COLS, n_trials=3, folds=3).write.format("noop").mode("overwrite").save()
        jobs.append(spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before)
    assert abs(jobs[0] - jobs[1]) <= 2


def test_areas_of_many_pieces_are_exact(spark, monkeypatch):
    """Scores in pieces by value, with ties and a fold of one class."""
    from defectscope.operators import evaluate as ev
    from defectscope.session import written

    monkeypatch.setattr(rm, "SCORES_A_PIECE", 7)
    own, out, models = np.random.default_rng(3), [], []
    for repo, n in ((1, 90), (2, 300)):
        x = np.round(own.normal(0, 1, (n, 2)), 1 if repo == 1 else 6)
        y, fold = (x[:, 0] + own.normal(0, 1, n) > 0).astype(int), own.integers(0, 3, n)
        if repo == 1:
            y[fold == 2] = 1
        out += [(repo, k % 4, 4, int(k), [float(v) for v in x[k]], int(y[k]), int(fold[k])) for k in range(n)]
        models += [(repo, m, m % 3, np.array([0.1, *own.normal(0, 1, 2)]).tobytes()) for m in range(6)]
    rows_ = spark.createDataFrame(out, "repo_id bigint, block bigint, blocks bigint, id bigint, x array<double>, y int, fold int")
    blocks = written(rows_.groupBy("repo_id", "block").applyInPandas(
        rm.packed, "repo_id bigint, block bigint, blocks bigint, n bigint, x binary, y binary, fold binary"), "blocks")
    known = spark.createDataFrame(models, "repo_id bigint, model int, fold int, accepted binary").groupBy("repo_id").agg(
        F.sort_array(F.collect_list(F.struct("model", "fold", "accepted"))).alias("models"))
    found = {(r.repo_id, r.model): r.roc_auc for r in rm._areas(blocks, known, 100, 3).collect()}
    scores = [(f"{repo}|{m}", int(k), float(np.array([1.0, *x]) @ np.frombuffer(beta)), y)
              for repo, m, f, beta in models for r, _, _, k, x, y, fold in out if r == repo and fold == f]
    preds = spark.createDataFrame(scores, "model_id string, id bigint, probability double, label int")
    want = {r.model_id: r.roc_auc for r in ev.roc_auc(ev.score_table(preds), one_class=float("nan")).collect() if r.roc_auc == r.roc_auc}
    assert {f"{repo}|{m}" for repo, m in found} == set(want) and len(want) == 10
    assert all(a == pytest.approx(want[f"{repo}|{m}"], abs=1e-12) for (repo, m), a in found.items())


def test_scores_are_packed(spark, monkeypatch):
    """A row a piece of a model, never a row a score; the pieces of one model are cut by value."""
    monkeypatch.setattr(rm, "SCORES_A_PIECE", 50)
    seen, pairs = [], rm._pairs

    def watched(parts):
        assert {len(set(own["piece"])) for _, own in parts.groupby("model")} == {1}
        return pairs(parts)

    monkeypatch.setattr(rm, "_pairs", watched)
    real = rm._areas
    monkeypatch.setattr(rm, "_areas", lambda *given: seen.append(real(*given)) or seen[-1])
    frame = rows(spark, repos=2, n=1500).where("repo_id < 2")
    assert rm.fit_repo_models(frame, COLS, n_trials=4, folds=3, block_rows=100).count() == 2
    assert seen[0].count() == 2 * 4 * 3
