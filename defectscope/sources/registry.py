"""Model registry, fitted models and prioritization runs."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectscope.operators.selection import exact_sum
from defectscope.schemas import CONFUSION

# JSON columns of the stored tables and what they hold.
JSON_COLUMNS = {
    "labels": "array<string>", "feature_names": "array<string>", "deps": "array<string>",
    "hyperparameters": "map<string,double>", "weights": "map<string,double>",
    "confusion_matrix": "struct<tn:bigint,fp:bigint,fn:bigint,tp:bigint>",
    "plan": "array<struct<rank:bigint,id:string,module:string,selected:boolean,risk:double,effort:double,"
            "criticite:double,priority_score:double,selection_reason:string>>",
}


def decode_json(df: DataFrame) -> DataFrame:
    """Text JSON columns of a stored table as arrays, maps and structs."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    found = {c: F.from_json(c, t) for c, t in JSON_COLUMNS.items() if c in text}
    return df.withColumns(found) if found else df


def registry_rows(metrics: DataFrame, *, model_type: str, model_family: str, hyperparameters: dict[str, float],
                  model_path: str, repo_id: int | None = None, dataset_id: int | None = None) -> DataFrame:
    """Registry rows from evaluated models (one row per `model_id`); new rows are active, none is best."""
    return metrics.select(
        "model_id", F.lit(repo_id).cast("bigint").alias("repo_id"), F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        F.lit(model_type).alias("model_type"), F.lit(model_family).alias("model_family"),
        F.lit(json.dumps(hyperparameters)).alias("hyperparameters"),
        "accuracy", F.col("precision").alias("precision_score"), "recall", F.col("f1").alias("f1_score"),
        "roc_auc", "pr_auc", F.col("popt").alias("popt_20"), F.col("recall_top").alias("recall_top_20"),
        F.col("threshold").alias("optimal_threshold"),
        F.to_json(F.struct(*[f.name for f in CONFUSION.fields])).alias("confusion_matrix"),
        F.lit(model_path).alias("model_path"), F.lit(True).alias("is_active"), F.lit(False).alias("is_best"),
        F.current_timestamp().alias("created_at"))


def register_model(metrics: DataFrame, registry_path: str, **facts) -> DataFrame:
    """Append the models' rows and return them as stored; a model already there is not added again."""
    spark = metrics.sparkSession
    rows = registry_rows(metrics, **facts)
    names = metrics.select("model_id").distinct()
    try:
        rows = rows.join(spark.read.parquet(registry_path).select("model_id"), "model_id", "left_anti").select(*rows.columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").parquet(registry_path)
    return spark.read.parquet(registry_path).join(names, "model_id", "left_semi")


def model_confusion(models: DataFrame, model_id: str) -> DataFrame:
    """Stored confusion counts and their 2x2 layout; absent counts are 0."""
    c = decode_json(models.where(F.col("model_id") == model_id))
    counts = {n: F.coalesce(F.col(f"confusion_matrix.{n}"), F.lit(0)) for n in ("tn", "fp", "fn", "tp")}
    return c.where("confusion_matrix IS NOT NULL").select(
        "model_id", "confusion_matrix",
        F.array(F.array(counts["tn"], counts["fp"]), F.array(counts["fn"], counts["tp"])).alias("matrix"))


def save_model(model: PipelineModel, path: str, feature_cols: list[str], threshold: float) -> None:
    """The fitted pipeline (scaler included) and, beside it, its feature list and threshold."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/pipeline")
    meta = spark.createDataFrame([(feature_cols, float(threshold))], "feature_cols array<string>, threshold double")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], float]:
    meta = spark.read.parquet(f"{path}/meta").first()
    return PipelineModel.load(f"{path}/pipeline"), list(meta["feature_cols"]), meta["threshold"]


PLAN_FIELDS = ["rank", "id", "module", "selected", "risk", "effort", "criticite", "priority_score", "selection_reason"]


def record_run(plan: DataFrame, runs_path: str, budget: float, weights: dict[str, float], plan_rows: int = 10_000,
               recording: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Record one run of each repository in the plan: (runs, pages) as stored.

    A run is one row with its id and totals; its plan is kept whole in JSON pages of
    `plan_rows` items under the run's id, so that no document, and no task, grows with
    the repository. `recording` names the call; given again, it replaces what it left.
    """
    spark, recording = plan.sparkSession, recording or uuid.uuid4().hex
    run = F.concat_ws("-", F.lit(recording), F.coalesce(F.col("repo_id").cast("string"), F.lit("null")))
    totals = plan.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("items_total"), F.count_if("selected").alias("items_selected"),
        exact_sum(F.col("effort")).alias("effort_total"),
        exact_sum(F.when(F.col("selected"), F.col("effort")).otherwise(F.lit(0.0))).alias("effort_selected"))
    runs = totals.select(
        run.alias("id"), "repo_id", F.lit(float(budget)).alias("budget"), F.lit(json.dumps(weights)).alias("weights"),
        "items_total", "items_selected", "effort_total", "effort_selected", F.current_timestamp().alias("created_at"))
    pages = (
        plan.withColumn("page", F.floor((F.col("rank") - 1) / plan_rows))
        .groupBy("repo_id", "page")
        .agg(F.to_json(F.array_sort(F.collect_list(F.struct(*PLAN_FIELDS)))).alias("plan"))
        .select(run.alias("run_id"), "repo_id", "page", "plan"))
    stored = []
    for name, frame in (("pages", pages), ("runs", runs)):
        path = f"{runs_path}/{name}/recording={recording}"
        frame.write.mode("overwrite").parquet(path)
        stored.append(spark.read.parquet(path))
    return stored[1], stored[0]


def read_runs(spark: SparkSession, runs_path: str) -> DataFrame:
    return spark.read.parquet(f"{runs_path}/runs").drop("recording")


def read_pages(spark: SparkSession, runs_path: str) -> DataFrame:
    return spark.read.parquet(f"{runs_path}/pages").drop("recording")
