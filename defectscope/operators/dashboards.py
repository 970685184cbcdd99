"""Summaries, listings and filters behind the dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectscope.functions.scoring import coverage_band, ratio_or_zero, risk_badge, risk_bucket
from defectscope.operators.ranking import top_rows

# Accuracy of a repository without models, attention limits, chart defaults.
NO_MODEL_ACCURACY = 0.85
HIGH_RISK, LOW_COVERAGE = 0.7, 70
RADAR_DEFAULTS = {"popt_20": 0.65, "recall_top_20": 0.72}
RADAR_METRICS = ["accuracy", "f1_score", "roc_auc", "pr_auc", "popt_20", "recall_top_20"]


def js_round(value: Column) -> Column:
    """Round half up, as dashboards do."""
    return F.floor(value + 0.5).cast("bigint")


def analysis_summary(metrics: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Averages and totals per repository; with `repos`, those without rows say `no_data`."""
    def avg(c):
        return F.coalesce(F.avg(c), F.lit(0.0))

    summary = metrics.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"), avg("cyclomatic_complexity").alias("avg_complexity"),
        F.coalesce(F.max("cyclomatic_complexity"), F.lit(0.0)).alias("max_complexity"),
        avg("wmc").alias("avg_wmc"), avg("cbo").alias("avg_cbo"), avg("lcom").alias("avg_lcom"),
        F.coalesce(F.sum("code_smells_count"), F.lit(0)).alias("total_smells"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"))
    if repos is None:
        return summary.withColumn("status", F.lit("analyzed"))
    status = F.when(F.col("total_files").isNull(), "no_data").otherwise("analyzed")
    return repos.select(F.col("id").alias("repo_id")).join(summary, "repo_id", "left").withColumn("status", status)


def repo_metrics(repos: DataFrame, commits: DataFrame, issues: DataFrame, metrics: DataFrame) -> DataFrame:
    """Commit, issue and metric totals of every repository, zeros where there is nothing.

    Each source is reduced to one row per repository before anything is joined.
    """
    c = commits.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("commits_total"), F.count_if("is_bugfix").alias("commits_bugfixes"))
    i = issues.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("issues_total"), F.count_if("is_bug").alias("issues_bugs"))
    m = metrics.groupBy("repo_id").agg(
        F.avg("cyclomatic_complexity").alias("avg_complexity"), F.avg("wmc").alias("avg_wmc"),
        F.avg("cbo").alias("avg_cbo"), F.sum("code_smells_count").alias("total_smells"),
        F.count(F.lit(1)).alias("total_files"))
    out = repos.select(F.col("id").alias("repo_id"))
    for part in (c, i, m):
        out = out.join(part, "repo_id", "left")
    return out.fillna(0)


def repo_model_quality(repos: DataFrame, models: DataFrame) -> DataFrame:
    accuracy = models.groupBy("repo_id").agg(F.avg(F.coalesce("accuracy", F.lit(0.0))).alias("avg_accuracy"))
    joined = repos.join(accuracy, repos.id == accuracy.repo_id, "left").drop("repo_id")
    filled = joined.withColumn("avg_accuracy", F.coalesce("avg_accuracy", F.lit(NO_MODEL_ACCURACY)))
    return filled.withColumn("coverage", js_round(F.col("avg_accuracy") * 100))


def overview_cards(repos: DataFrame, models: DataFrame) -> DataFrame:
    """One row: repository and model counts, mean coverage, open defects, and their tones."""
    r = repos.agg(F.count(F.lit(1)).alias("repo_count"),
                  F.sum(F.coalesce("coverage", F.lit(0))).alias("__coverage"),
                  F.coalesce(F.sum("open_defects"), F.lit(0)).alias("open_defects"))
    m = models.agg(F.count(F.lit(1)).alias("model_count"),
                   F.avg(F.coalesce("accuracy", F.lit(0.0))).alias("avg_accuracy"))
    coverage, defects = F.col("avg_coverage"), F.col("open_defects")
    # Two single-row frames side by side.
    both = r.join(F.broadcast(m))
    return both.select(
        "repo_count", "model_count", "open_defects",
        js_round(ratio_or_zero(F.col("__coverage"), F.col("repo_count"))).alias("avg_coverage"),
        js_round(F.coalesce("avg_accuracy", F.lit(0.0)) * 100).alias("accuracy_pct"),
    ).withColumns({
        "coverage_tone": F.when(coverage >= 80, "good").when(coverage >= 60, "warn").otherwise("bad"),
        "models_tone": F.when(F.col("model_count") > 0, "good").otherwise("warn"),
        "repos_tone": F.when(F.col("repo_count") > 0, "good").otherwise("warn"),
        "defects_tone": F.when(defects > 20, "bad").when(defects > 10, "warn").otherwise("good"),
        "defects_trend": F.when(defects > 10, "Need attention").otherwise("Under control"),
    })


def module_totals(modules: DataFrame) -> DataFrame:
    return modules.groupBy("repo_id").agg(
        F.avg("coverage").alias("avg_coverage"), F.sum("defects").alias("total_defects"))


def module_bands(modules: DataFrame) -> DataFrame:
    return modules.withColumns({
        "coverage_band": coverage_band(F.col("coverage")), "risk_badge": risk_badge(F.col("risk"))})


def filter_modules(modules: DataFrame, min_risk: float = 0.5, module: str = "all",
                   date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    out = modules.where(F.col("risk") >= min_risk)
    if module != "all":
        out = out.where(F.col("module") == module)
    if date_from:
        out = out.where(F.col("recorded_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        out = out.where(F.col("recorded_at") < F.lit(date_to).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return out


def attention_list(modules: DataFrame) -> DataFrame:
    return modules.where((F.col("risk") >= HIGH_RISK) & (F.col("coverage") < LOW_COVERAGE))


def risk_distribution(preds: DataFrame) -> DataFrame:
    return preds.groupBy("repo_id", risk_bucket(F.col("risk_score")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("files"), F.avg("risk_score").alias("mean_risk"))


def dataset_profile(df: DataFrame, n_features: int) -> DataFrame:
    buggy = F.sum(F.col("is_buggy").cast("bigint"))
    return df.groupBy("repo_id", "split").agg(
        F.count(F.lit(1)).alias("samples"), F.lit(n_features).cast("bigint").alias("n_features"),
        buggy.alias("buggy"), ratio_or_zero(buggy, F.count(F.lit(1))).alias("buggy_ratio"))


def model_radar(models: DataFrame, n: int = 5, types: Sequence[str] | None = None) -> DataFrame:
    """Six metrics (x100) of the newest models, one column per model type; the last model of a type wins."""
    newest_first = [F.desc("created_at"), F.asc("model_id")]
    newest = models.orderBy(*newest_first).limit(n)
    # A window over the `n` rows left by the limit.
    placed = newest.withColumn("place", F.row_number().over(Window.orderBy(*newest_first)))
    values = placed.select("model_type", "place", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"),
                 (F.coalesce(m, F.lit(RADAR_DEFAULTS.get(m, 0.0))) * 100).alias("value"))
        for m in RADAR_METRICS])))
    return values.groupBy("metric").pivot("model_type", types).agg(F.max_by("value", "place"))


def trend_delta(series: DataFrame, keys: Sequence[str] = ("repo_id", "metric_name")) -> DataFrame:
    """Latest value of each series and its change from the one before (none or 0: no change)."""
    order = [F.desc("recorded_at"), F.desc("id")]
    two = top_rows(series, list(keys), order, 2, rank="__rn")
    latest = F.max(F.when(F.col("__rn") == 1, F.col("metric_value")))
    previous = F.max(F.when(F.col("__rn") == 2, F.col("metric_value")))
    basis = F.when(F.coalesce(previous, F.lit(0.0)) == 0, latest).otherwise(previous)
    return two.groupBy(*keys).agg(latest.alias("latest"), (latest - basis).alias("change"))


def active(df: DataFrame) -> DataFrame:
    return df.where("is_active")


def by_id(df: DataFrame, value, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def best_model(models: DataFrame, tie_f1: bool = False) -> DataFrame:
    """The active model with the highest ROC-AUC (nulls last, then F1 if asked for)."""
    order = [F.desc_nulls_last("roc_auc")] + ([F.desc_nulls_last("f1_score")] if tie_f1 else [])
    best = active(models).orderBy(*order, F.asc("model_id")).limit(1)
    return best.withColumn("accuracy_percent", F.round(F.col("accuracy") * 100, 2)) if tie_f1 else best


def best_model_per_repo(models: DataFrame) -> DataFrame:
    order = [F.desc_nulls_last("roc_auc"), F.desc_nulls_last("f1_score"), F.asc("model_id")]
    return top_rows(active(models), ["repo_id"], order, 1)


def list_models(models: DataFrame) -> DataFrame:
    """Newest first, with the metrics as one struct."""
    names = [m for m in ["accuracy", "precision_score", "recall", *RADAR_METRICS[1:]] if m in models.columns]
    rest = [c for c in models.columns if c not in names]
    return models.select(*rest, F.struct(*names).alias("metrics")).orderBy(F.desc("created_at"), F.asc("model_id"))


def model_metrics(models: DataFrame, model_id: str) -> DataFrame:
    names = {"accuracy": "accuracy", "precision_score": "precision", "recall": "recall", "f1_score": "f1",
             "roc_auc": "roc_auc", "pr_auc": "pr_auc", "popt_20": "popt_20", "recall_top_20": "recall_top_20"}
    return by_id(models, model_id, "model_id").select(
        *[F.col(c).alias(a) for c, a in names.items() if c in models.columns])


def latest_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(runs, ["repo_id"], [F.desc("created_at"), F.desc("id")], n)


def policies(df: DataFrame) -> DataFrame:
    """Active policies, default first, then by name; weights as one struct."""
    weights = {"risk": "risk_weight", "criticite": "criticite_weight", "effort": "effort_weight",
               "coverage": "coverage_weight", "recency": "recency_weight"}
    return active(df).orderBy(F.desc("is_default"), F.asc("name")).select(
        "id", "name", F.struct(*[F.col(c).alias(a) for a, c in weights.items()]).alias("weights"),
        "default_budget", "max_items", "is_default")


def top_risky(preds: DataFrame, n: int = 10) -> DataFrame:
    return preds.orderBy(F.desc("risk_score"), F.asc("id")).limit(n)


def top_risky_per_repo(preds: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(preds, ["repo_id"], [F.desc("risk_score"), F.asc("id")], n, rank="place")


def list_repos(repos: DataFrame) -> DataFrame:
    return repos.orderBy(F.desc("created_at"), F.asc("id"))


def get_repo(repos: DataFrame, repo_id: int) -> DataFrame:
    return by_id(repos, repo_id)

