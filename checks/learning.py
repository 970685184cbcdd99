"""Datasets and classifiers. A fit has no SQL form: SQL gives the rows it covers, the query whether its figures hold together."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.relational import CHANGES, commits
from checks.registry import query
from checks.storage import SPLIT
from defectscope.plans import dataset as dp
from defectscope.plans import flow as fl
from defectscope.plans import repo_models as rm
from defectscope.plans import training as tr
from defectscope.plans.search import TRIALS
from defectscope.schemas import FEATURE_COLUMNS
from defectscope.session import scratch_path, written
from defectscope.sources import registry


@query("feature_table", f"""
WITH {CHANGES}, fixes AS (SELECT m.repo_id, m.id, count(*) AS bug_history FROM fx_file_metrics m JOIN changes c
    ON c.repo_id = m.repo_id AND c.filepath = m.filepath AND c.is_bugfix AND c.committed_at < m.created_at GROUP BY 1, 2)
SELECT m.repo_id, m.id, coalesce(m.cbo, 0) AS cbo, wmc, change_frequency, author_count, change_frequency * 0.5e0 AS recent_changes,
       coalesce(x.bug_history, 0) AS bug_history, CASE WHEN b.filepath IS NULL THEN 0 ELSE 1 END AS is_buggy
FROM fx_file_metrics m JOIN stats s ON s.repo_id = m.repo_id AND s.filepath = m.filepath
LEFT JOIN fixes x ON x.repo_id = m.repo_id AND x.id = m.id LEFT JOIN buggy b ON b.repo_id = m.repo_id AND b.filepath = m.filepath""")
def _(t):
    out = dp.feature_table(t.fx_file_metrics, t.fx_files, commits(t))
    return out.select("repo_id", "id", "cbo", "wmc", "change_frequency", "author_count", "recent_changes", "bug_history", "is_buggy")


def dataset(t, balancing: str = "none"):
    return dp.build_dataset(t.fx_file_metrics, t.fx_files, commits(t), dp.DatasetConfig(balancing=balancing))


def halves(t, balancing: str = "none"):
    rows = written(dataset(t, balancing), "dataset")
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@query("balanced_dataset", f"""
WITH {CHANGES}, labeled AS (SELECT m.repo_id, m.id, m.created_at, CASE WHEN b.filepath IS NULL THEN 0 ELSE 1 END AS is_buggy
  FROM fx_file_metrics m LEFT JOIN buggy b ON b.repo_id = m.repo_id AND b.filepath = m.filepath),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY repo_id ORDER BY created_at NULLS LAST, id)
        <= floor(count(*) OVER (PARTITION BY repo_id) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM labeled),
c AS (SELECT repo_id, split, is_buggy, count(*) AS n FROM s GROUP BY 1, 2, 3)
SELECT repo_id, split, is_buggy, CASE WHEN split = 'train' THEN max(n) OVER (PARTITION BY repo_id, split) ELSE n END AS n FROM c""")
def _(t):
    return dataset(t, "smote").groupBy("repo_id", "split", "is_buggy").agg(F.count(F.lit(1)).alias("n"))


# What SQL can say of a fit: the rows it was measured on, and that all figures hold together.
MEASURED = f"WITH {SPLIT} SELECT count(*) AS n, CAST(sum(is_buggy) AS BIGINT) AS positives, true AS sound FROM s WHERE split = 'test'"
SCORED = f"WITH {SPLIT} SELECT repo_id, id AS pos, filepath AS id, true AS sound FROM s WHERE split = 'test'"
FOREST = tr.TrainConfig(family="rf", n_trials=0)  # the family's own defaults; tuning has a query of its own


def measured(metrics):
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    sound = F.abs(F.col("accuracy") - (F.col("tn") + F.col("tp")) / n) < 1e-9
    for c in ("accuracy", "precision", "recall", "f1", "roc_auc"):
        sound = sound & F.col(c).between(0, 1)
    return metrics.select(n.cast("bigint").alias("n"), (F.col("tp") + F.col("fn")).cast("bigint").alias("positives"), sound.alias("sound"))


def checked(scores, threshold):
    p = F.col("probability")
    sound = p.between(0, 1) & (F.col("risk_score") == p) & (F.col("prediction") == (p >= F.lit(float(threshold))).cast("int"))
    if "uncertainty" in scores.columns:
        sound = sound & (F.abs(F.col("uncertainty") - (1 - 2 * F.abs(p - 0.5))) < 1e-12)
    return scores.select("repo_id", "pos", "id", sound.alias("sound"))


@query("trained_classifier", MEASURED)
def _(t):
    train, test = halves(t)
    _, metrics, _ = tr.train_auto(train, test, FOREST, FEATURE_COLUMNS)
    return measured(metrics)


@query("trained_logistic_regression", MEASURED)
def _(t):
    train, test = halves(t)
    _, metrics, _ = tr.train_auto(train, test, tr.TrainConfig(family="logreg"), FEATURE_COLUMNS)
    return measured(metrics)


@query("tuned_classifier", f"SELECT CAST(i AS INT) AS trial, true AS sound FROM range(0, {TRIALS}) r(i)")
def _(t):
    train, _ = halves(t)
    prepared = tr.prepared(train, FEATURE_COLUMNS)
    _, trials = tr.tune(prepared, FEATURE_COLUMNS, "logreg")
    rows = [(i, 0.01 <= x["params"]["C"] <= 10 and 0 < x["score"] <= 1) for i, x in enumerate(trials)]
    return t.spark.createDataFrame(rows, "trial int, sound boolean")


# Newton's method on two standardized features, a row of coefficients a repository and round.
NEWTON = f"""
WITH RECURSIVE {SPLIT}, h AS (SELECT repo_id, filepath, count(*) AS change_frequency FROM changes GROUP BY 1, 2),
r AS (SELECT s.repo_id, CAST(s.is_buggy AS DOUBLE) AS y, CAST(coalesce(s.wmc, 0) AS DOUBLE) AS u, CAST(coalesce(h.change_frequency, 0) AS DOUBLE) AS v
      FROM s LEFT JOIN h ON h.repo_id = s.repo_id AND h.filepath = s.filepath WHERE split = 'train'),
m AS (SELECT repo_id, avg(u) AS mu, CASE WHEN stddev_pop(u) = 0 THEN 1 ELSE stddev_pop(u) END AS su, avg(v) AS mv, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS sv,
             count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM r GROUP BY repo_id HAVING sum(y) BETWEEN 1 AND count(*) - 1),
z AS MATERIALIZED (SELECT repo_id, y, (u - mu) / su AS a, (v - mv) / sv AS b FROM r JOIN m USING (repo_id)),
t(i, repo_id, b0, b1, b2) AS (
  SELECT 0, repo_id, 0e0, 0e0, 0e0 FROM m
  UNION ALL
  SELECT i + 1, repo_id, b0 - (g0 * (d * f - e * e) - g1 * (k * f - e * l) + g2 * (k * e - d * l)) / w,
         b1 - (-g0 * (k * f - e * l) + g1 * (c * f - l * l) - g2 * (c * e - k * l)) / w,
         b2 - (g0 * (k * e - d * l) - g1 * (c * e - k * l) + g2 * (c * d - k * k)) / w
  FROM (SELECT *, c * (d * f - e * e) - k * (k * f - e * l) + l * (k * e - d * l) AS w
        FROM (SELECT i, repo_id, b0, b1, b2, sum(p - y) AS g0, sum((p - y) * a) + b1 AS g1, sum((p - y) * b) + b2 AS g2,
                     sum(q) AS c, sum(q * a) AS k, sum(q * b) AS l, sum(q * a * a) + 1 AS d, sum(q * a * b) AS e, sum(q * b * b) + 1 AS f
              FROM (SELECT t.*, y, a, b, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS p, p * (1 - p) AS q FROM t JOIN z USING (repo_id) WHERE i < 25) x
              GROUP BY i, repo_id, b0, b1, b2) y) x)"""


@query("models_per_repo", f"""{NEWTON}
SELECT t.repo_id, n, positives, round(b0, 6) + 0e0 AS intercept, round(b1, 6) + 0e0 AS on_wmc, round(b2, 6) + 0e0 AS on_changes,
       round((SELECT sum(ln(1 + exp(b0 + b1 * a + b2 * b)) - y * (b0 + b1 * a + b2 * b)) FROM z WHERE z.repo_id = t.repo_id) + (b1 * b1 + b2 * b2) / 2, 4) AS loss
FROM t JOIN m USING (repo_id) WHERE i = 25""")
def _(t):
    train, _ = halves(t)
    models = rm.fit_repo_models(train, ["wmc", "change_frequency"])
    return models.where((F.col("positives") > 0) & (F.col("positives") < F.col("n"))).select(
        "repo_id", "n", "positives", (F.round("intercept", 6) + 0.0).alias("intercept"), (F.round(F.col("coefficients")[0], 6) + 0.0).alias("on_wmc"),
        (F.round(F.col("coefficients")[1], 6) + 0.0).alias("on_changes"), F.round("loss", 4).alias("loss"))


@query("tuned_models_per_repo", f"""
WITH {SPLIT}, r AS (SELECT repo_id, count(*) AS n, CAST(sum(is_buggy) AS BIGINT) AS positives FROM s WHERE split = 'train' GROUP BY repo_id),
e AS (SELECT repo_id, count(*) AS tested FROM s WHERE split = 'test' GROUP BY repo_id)
SELECT repo_id, n, positives, round(-(positives * ln(positives / n) + (n - positives) * ln(1 - positives / n)), 4) AS constant_loss,
       {TRIALS} AS trials, tested, true AS converged, true AS better_than_constant
FROM r JOIN e USING (repo_id) WHERE positives BETWEEN 1 AND n - 1""")
def _(t):
    """Thirty trials over five folds for every repository, all features; a constant model is never better than its log loss."""
    train, test = halves(t)
    models, metrics = rm.train_repo_models(train, test, FEATURE_COLUMNS)
    share = F.col("positives") / F.col("n")
    constant = -(F.col("positives") * F.log(share) + (F.col("n") - F.col("positives")) * F.log(1 - share))
    tested = metrics.select(F.expr("cast(substring(model_id, 6) as bigint)").alias("repo_id"), (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).cast("bigint").alias("tested"))
    sizes = F.col("coefficients")
    penalty = F.aggregate(sizes, F.lit(0.0), lambda s, w: s + w * w) / (2 * F.col("c"))
    return models.where((F.col("positives") > 0) & (F.col("positives") < F.col("n"))).join(tested, "repo_id").select(
        "repo_id", "n", "positives", F.round(constant, 4).alias("constant_loss"), F.size("cv_aucs").alias("trials"), "tested", "converged",
        ((F.col("loss") - penalty < constant - 1e-6) & (F.aggregate(sizes, F.lit(0.0), lambda s, w: s + F.abs(w)) > 1e-6) & F.col("cv_auc").between(0.0, 1.0)).alias("better_than_constant"))


@query("best_of_families", MEASURED)
def _(t):
    """The forest and, below the target accuracy, its larger refit; tests cover all families together."""
    train, test = halves(t)
    _, table, best = tr.train_best(train, test, "rf", cols=FEATURE_COLUMNS)
    return measured(table.where(F.col("accuracy") == best["accuracy"]).limit(1))


@query("scored_files", SCORED)
def _(t):
    train, test = halves(t)
    model = tr.fit(tr.prepared(train, FEATURE_COLUMNS), FEATURE_COLUMNS, "rf")
    return checked(tr.score(test, model, 0.5, FEATURE_COLUMNS, uncertainty=True), 0.5)


@query("feature_importance", f"SELECT CAST(10 AS BIGINT) AS n, CAST({len(FEATURE_COLUMNS)} AS BIGINT) AS of_all, true AS sound")
def _(t):
    train, _ = halves(t)
    model = tr.fit(tr.prepared(train, FEATURE_COLUMNS), FEATURE_COLUMNS, "rf")
    top = tr.feature_importance(t.spark, model, FEATURE_COLUMNS)
    everything = tr.feature_importance(t.spark, model, FEATURE_COLUMNS, len(FEATURE_COLUMNS))
    total = everything.agg(F.count(F.lit(1)).alias("of_all"), F.sum("importance").alias("total"), F.max("importance").alias("most"))
    return (top.agg(F.count(F.lit(1)).alias("n"), F.max("importance").alias("top")).join(F.broadcast(total))
            .select("n", "of_all", ((F.abs(F.col("total") - 1) < 1e-6) & (F.col("top") == F.col("most"))).alias("sound")))


@query("reloaded_model_scores", SCORED)
def _(t):
    train, test = halves(t)
    model, metrics, chosen = tr.train_auto(train, test, FOREST, FEATURE_COLUMNS)
    path = scratch_path(t.spark, "model")
    registry.save_model(model, path, chosen["cols"], metrics.first()["threshold"])
    loaded, cols, threshold = registry.load_model(t.spark, path)
    return checked(tr.score(test, loaded, threshold, cols), threshold)


@query("scored_by_best_model", SCORED)
def _(t):
    """Two registered models; the one with the higher ROC-AUC scores."""
    train, test = halves(t)
    store = scratch_path(t.spark, "store")
    areas = {}
    for cfg in (FOREST, tr.TrainConfig(family="logreg", n_trials=0)):
        model, metrics, chosen = tr.train_auto(train, test, cfg, FEATURE_COLUMNS)
        metrics = written(metrics, "metrics")
        row = metrics.first()
        registry.save_model(model, f"{store}/{row.model_id}", chosen["cols"], row.threshold)
        registry.register_model(metrics, f"{store}/registry", model_type=cfg.family, model_family="auto", hyperparameters={}, model_path=f"{store}/{row.model_id}")
        areas[row.model_id] = row.roc_auc
    scores = tr.score_stored(test, f"{store}/registry")
    threshold = registry.load_model(t.spark, f"{store}/{max(areas, key=areas.get)}")[2]
    return checked(scores.where(F.col("model_id") == max(areas, key=areas.get)), threshold)


def flow(t, store: str | None = None) -> fl.FlowResult:
    return fl.run_flow(t.spark, t.fx_file_metrics, t.fx_files, commits(t), fl.FlowConfig(training=FOREST, store=store))


# Rows of the balanced dataset, of its test split, and repositories in either.
FLOW_ROWS = f"""
{SPLIT}, c AS (SELECT repo_id, split, is_buggy, count(*) AS n FROM s GROUP BY 1, 2, 3),
b AS (SELECT repo_id, split, CASE WHEN split = 'train' THEN max(n) OVER (PARTITION BY repo_id, split) ELSE n END AS n FROM c),
f AS (SELECT CAST(sum(n) AS BIGINT) AS everything, CAST(sum(n) FILTER (WHERE split = 'test') AS BIGINT) AS tests, count(DISTINCT repo_id) AS repos,
             count(DISTINCT CASE WHEN split = 'test' THEN repo_id END) AS test_repos FROM b)"""


@query("flow_report", f"""
WITH {FLOW_ROWS} SELECT 'features' AS step, 'success' AS status, everything AS n FROM f UNION ALL SELECT 'training', 'success', tests FROM f
UNION ALL SELECT 'prediction', 'success', tests FROM f UNION ALL SELECT 'prioritization', 'success', tests FROM f""")
def _(t):
    result = flow(t)
    metrics = result.metrics.first()
    rows = {"features": result.dataset.count(), "training": int(metrics.tn + metrics.fp + metrics.fn + metrics.tp),
            "prediction": result.predictions.count(), "prioritization": result.plan.count()}
    count = F.element_at(F.create_map(*(F.lit(x) for pair in rows.items() for x in pair)), F.col("step")).cast("bigint")
    return result.report(t.spark).select("step", "status", count.alias("n"))


@query("flow_persisted_tables", f"""
WITH {FLOW_ROWS} SELECT 'datasets' AS kept, everything AS n FROM f UNION ALL SELECT 'catalog', repos FROM f UNION ALL SELECT 'registry', 1
UNION ALL SELECT 'runs', test_repos FROM f UNION ALL SELECT 'planned', tests FROM f UNION ALL SELECT 'scored', tests FROM f""")
def _(t):
    store = scratch_path(t.spark, "store")
    result = flow(t, store)
    read = t.spark.read.parquet
    tables = {
        "datasets": read(f"{store}/datasets"), "catalog": read(f"{store}/catalog"), "registry": read(f"{store}/registry"),
        "runs": registry.read_runs(t.spark, f"{store}/runs"),
        "planned": registry.decode_json(registry.read_pages(t.spark, f"{store}/runs")).select(F.inline("plan")),
        "scored": tr.score_stored(result.dataset.where("split = 'test'"), f"{store}/registry")}
    out = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kept"), "n")
        out = row if out is None else out.unionByName(row)
    return out
