"""Ranking and classification metrics per model, all from one grouped frame.

`score_table` shrinks predictions to one row per (model, probability) with partial sums on
the map side; every metric but the tie-break of top-k needs nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectscope.functions.scoring import ratio_or_zero
from defectscope.operators.ranking import ranked, small_side
from defectscope.session import cut_lineage

# The threshold grid and the fallback threshold.
GRID_START, GRID_STOP, GRID_POINTS = 0.1, 0.9, 50
DEFAULT_THRESHOLD = 0.5
TOP_SHARE = 0.2


def score_table(preds: DataFrame, key: str = "model_id", **limits) -> DataFrame:
    """Rows and positives per distinct probability, with sums from the highest one down."""
    # Measured and then ranked: written once, so predictions are grouped once.
    grouped = cut_lineage(preds.groupBy(key, "probability").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos")))
    return ranked(
        grouped, [key], [F.desc("probability")], rank="place",
        running={"cum_n": F.col("n"), "cum_pos": F.col("pos")},
        totals={"total_n": F.col("n"), "total_pos": F.col("pos")}, **limits)


def roc_auc(table: DataFrame, key: str = "model_id", one_class: float = 0.0) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties at one half."""
    above = (F.col("cum_pos") - F.col("pos")).cast("double")
    pairs = (F.col("n") - F.col("pos")) * (above + F.col("pos") / F.lit(2.0))
    p, n = F.max("total_pos").cast("double"), F.max("total_n").cast("double")
    return table.groupBy(key).agg(
        F.when((p == 0) | (p == n), F.lit(float(one_class)))
        .otherwise(F.sum(pairs) / F.nullif(p * (n - p), F.lit(0.0))).alias("roc_auc"))


def average_precision(table: DataFrame, key: str = "model_id") -> DataFrame:
    p = F.max("total_pos").cast("double")
    steps = F.col("pos").cast("double") * (F.col("cum_pos").cast("double") / F.col("cum_n"))
    return table.groupBy(key).agg(
        F.when(p == 0, F.lit(0.0)).otherwise(F.sum(steps) / F.nullif(p, F.lit(0.0))).alias("pr_auc"))


def top_share(preds: DataFrame, table: DataFrame, k: float = TOP_SHARE, key: str = "model_id", **limits) -> DataFrame:
    """`recall_top` and `popt`: share of the positives among the top k of the ranking.

    Whole probability groups above the cut come from `table`. Only the group the cut goes
    through is looked at row by row, in id order.
    """
    wanted = F.floor(F.col("total_n").cast("double") * F.lit(float(k)))
    t = table.withColumn("items", F.greatest(wanted, F.lit(1))).withColumn("before", F.col("cum_n") - F.col("n"))
    is_cut = (F.col("before") < F.col("items")) & (F.col("cum_n") > F.col("items"))
    per_model = t.groupBy(key).agg(
        F.sum(F.when(F.col("cum_n") <= F.col("items"), F.col("pos")).otherwise(0)).alias("whole"),
        F.max(F.when(is_cut, F.col("probability"))).alias("cut_probability"),
        F.max(F.when(is_cut, F.col("items") - F.col("before"))).alias("cut_rows"),
        F.max("total_pos").alias("total_pos"), F.max(wanted).alias("wanted"))
    # One row a model: counted, and broadcast so that raw predictions stay where they are.
    cuts = cut_lineage(per_model.where("cut_rows IS NOT NULL").select(
        key, F.col("cut_probability").alias("probability"), "cut_rows"))
    at_cut = preds.select(key, "id", "label", "probability").join(small_side(cuts, cuts.count()), [key, "probability"])
    tied = (
        ranked(at_cut, [key], [F.asc("id")], rank="tie_place", **limits)
        .where(F.col("tie_place") <= F.col("cut_rows"))
        .groupBy(key).agg(F.sum(F.col("label").cast("bigint")).alias("tied")))
    hits = F.col("whole") + F.coalesce("tied", F.lit(0))
    recall = ratio_or_zero(hits, F.col("total_pos"))
    return per_model.join(tied, key, "left").select(
        key, recall.alias("recall_top"),
        F.when(F.col("wanted") == 0, F.lit(0.0)).otherwise(recall).alias("popt"))


def recall_at_top_k(preds: DataFrame, k: float = TOP_SHARE, key: str = "model_id") -> DataFrame:
    return top_share(preds, score_table(preds, key), k, key).drop("popt")


def popt_at_k(preds: DataFrame, k: float = TOP_SHARE, key: str = "model_id") -> DataFrame:
    """Same share, but 0 when k of the rows is less than one; effort plays no part in it."""
    return top_share(preds, score_table(preds, key), k, key).drop("recall_top")


def grid_point(i: Column) -> Column:
    """Threshold number `i` (1-based) of the grid."""
    step = (GRID_STOP - GRID_START) / (GRID_POINTS - 1)
    inner = (i - 1).cast("double") * F.lit(step) + F.lit(GRID_START)
    return F.when(i == GRID_POINTS, F.lit(GRID_STOP)).otherwise(inner)


def thresholds_passed(probability: Column) -> Column:
    """How many grid thresholds are at or below a probability: a guess, then an exact step."""
    step = (GRID_STOP - GRID_START) / (GRID_POINTS - 1)
    guess = F.greatest(F.lit(0), F.least(F.lit(GRID_POINTS), F.floor((probability - GRID_START) / step) + 1))
    up = (guess < GRID_POINTS) & (probability >= grid_point(guess + 1))
    down = (guess > 0) & (probability < grid_point(guess))
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess).cast("int")


def optimal_threshold(table: DataFrame, metric: str = "f1", key: str = "model_id") -> DataFrame:
    """First grid threshold with the strictly best score; 0.5 when none scores above 0."""
    buckets = table.select(key, thresholds_passed(F.col("probability")).alias("passed"), "n", "pos")
    grid = buckets.select(key).distinct().select(
        key, F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS))).alias("passed"),
        F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"))
    counts = buckets.unionByName(grid).groupBy(key, "passed").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # 51 rows per model from here on.
    model = Window.partitionBy(key)
    from_here_up = model.orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = counts.select(
        key, "passed",
        F.sum("n").over(from_here_up).alias("flagged"), F.sum("pos").over(from_here_up).alias("tp"),
        F.sum("n").over(model).alias("total"), F.sum("pos").over(model).alias("positives"),
    ).where("passed > 0")
    tp = F.col("tp")
    fp, fn = F.col("flagged") - tp, F.col("positives") - tp
    if metric == "f1":
        score = ratio_or_zero(2 * tp, 2 * tp + fp + fn)
    else:
        score = ratio_or_zero(F.col("total") - fp - fn, F.col("total"))
    best = swept.groupBy(key).agg(F.max(F.struct(score.alias("score"), (-F.col("passed")).alias("first"))).alias("b"))
    return best.select(key, F.when(F.col("b.score") > 0, grid_point(-F.col("b.first")))
                       .otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"), F.col("b.score").alias("best_score"))


def confusion(table: DataFrame, threshold: Column | float = DEFAULT_THRESHOLD, key: str = "model_id") -> DataFrame:
    """tn, fp, fn, tp and the 2x2 layout; `threshold` may be a column of `table`."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, neg = F.col("probability") >= limit, F.col("n") - F.col("pos")

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0)))

    counts = table.groupBy(key).agg(
        total(~hit, neg).alias("tn"), total(hit, neg).alias("fp"),
        total(~hit, F.col("pos")).alias("fn"), total(hit, F.col("pos")).alias("tp"))
    return counts.withColumn("matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp")))


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """accuracy, precision, recall and F1 from the counts, 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return matrix.withColumns({
        "accuracy": ratio_or_zero(tn + tp, tn + fp + fn + tp),
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
    })


def evaluate_models(preds: DataFrame, metric: str = "f1", k: float = TOP_SHARE,
                    key: str = "model_id", one_class: float = 0.0) -> DataFrame:
    """All metrics of every model; the ranked frame is built once for all of them."""
    table = cut_lineage(score_table(preds, key))
    chosen = optimal_threshold(table, metric, key).drop("best_score")
    counted = classification_metrics(confusion(table.join(chosen, key), F.col("threshold"), key))
    return (
        counted.join(chosen, key)
        .join(roc_auc(table, key, one_class), key)
        .join(average_precision(table, key), key)
        .join(top_share(preds, table, k, key), key))


def evaluate_selection(plan: DataFrame, labels: DataFrame) -> DataFrame:
    """Defects a selection catches, per repository and heuristic, against item labels."""
    joined = plan.join(labels.select("repo_id", "id", "label"), ["repo_id", "id"])
    caught = F.count_if(F.col("selected") & (F.col("label") == 1))
    total, picked = F.count_if(F.col("label") == 1), F.count_if("selected")
    return joined.groupBy("repo_id", "heuristic").agg(
        caught.alias("defects_caught"), total.alias("defects_total"), picked.alias("items_selected"),
        ratio_or_zero(caught, total).alias("recall"), ratio_or_zero(caught, picked).alias("precision"))
