"""Choosing items under an effort budget, and explaining the choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectscope.functions.scoring import (
    DEFAULT_COVERAGE_GAP, DEFAULT_CRITICITE, priority_score)
from defectscope.operators.ranking import joined, ranked, split_hot, top_rows
from defectscope.session import cut_lineage

# A group up to this many items is walked item by item inside one task.
WALK_ITEMS_LIMIT = 100_000

# Efforts and budgets are compared and summed as whole millionths, so that no order of
# adding or subtracting, and no group size, can change what fits.
UNITS = 1_000_000

# Reasons of a plan.
SELECTED, MANDATORY = "Selected by optimization", "Mandatory item"
EXCLUDED, OVER_BUDGET, LOWER = "Excluded by constraint", "Budget exceeded", "Lower priority"

# What a prediction becomes as an item.
DEFAULT_EFFORT, DEFAULT_RISK, FIRST_ITEMS = 100.0, 0.5, 50


def with_priority_score(items: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    return items.withColumn("priority_score", priority_score(
        F.col("risk"), F.col("effort"), F.col("criticite"), F.col("coverage_gap"), weights))


def units(effort: Column) -> Column:
    """A number of effort in exact millionths; one too large for 22 digits before the point is an error."""
    return (effort.cast("decimal(28,6)") * F.lit(UNITS)).cast("decimal(38,0)")


def exact_sum(effort: Column) -> Column:
    """The sum of efforts as a double, the same in any order of the rows."""
    return (F.sum(units(effort)) / F.lit(UNITS)).cast("double")


def predictions_to_items(preds: DataFrame, limit: int | None = FIRST_ITEMS, order: Sequence[str] = ("pos",)) -> DataFrame:
    """The first `limit` predictions of each repository (None: all) as items; `pos` is their place in `order`."""
    columns = [F.asc_nulls_last(c) for c in order]
    if limit is None:
        first = ranked(preds, ["repo_id"], columns, rank="__place")
    else:
        first = top_rows(preds, ["repo_id"], columns, limit, rank="__place")
    first = first.drop("pos").withColumnRenamed("__place", "pos")
    return first.select(
        "repo_id", "pos", "id",
        F.coalesce("probability", "risk_score", F.lit(DEFAULT_RISK)).alias("risk"),
        F.lit(DEFAULT_EFFORT).alias("effort"), F.lit(DEFAULT_CRITICITE).alias("criticite"),
        F.lit(DEFAULT_COVERAGE_GAP).alias("coverage_gap"))


def greedy_select(
    items: DataFrame, budget: Column | float, score: str = "priority_score",
    keys: Sequence[str] = ("repo_id",), limit: int = WALK_ITEMS_LIMIT,
) -> DataFrame:
    """Walk items by score (ties by `pos`), take each one that still fits, skip the others.

    Efforts are exact to the millionth; an item without an effort is never taken. Adds
    `selected`. Whether an item is taken depends on all taken before it, so a running sum is
    not enough. Groups up to `limit` items are walked in one task each. A larger group is
    narrowed down in rounds first, see `_narrow_hot_groups`.
    """
    left = budget if isinstance(budget, Column) else F.lit(float(budget))
    # A name for each group, null keys included, that plain joins can use.
    todo = items.withColumns({"__left": units(left), "__units": units(F.col("effort")), "__group": F.to_json(F.struct(*keys))})
    keys, helpers = ["__group"], ["__left", "__units", "__group"]
    ordinary, hot, _ = split_hot(todo, keys, limit)
    walked = _walk(ordinary, score, keys)
    if hot is None:
        return walked.drop(*helpers)
    taken = _narrow_hot_groups(hot, score, keys, limit)
    marked = (
        hot.join(taken.select(*keys, "pos", F.lit(True).alias("__taken")), [*keys, "pos"], "left")
        .withColumn("selected", F.coalesce("__taken", F.lit(False))).drop("__taken"))
    return walked.unionByName(marked).drop(*helpers)


def _walk(todo: DataFrame, score: str, keys: list[str]) -> DataFrame:
    schema = T.StructType([*todo.schema.fields, T.StructField("selected", T.BooleanType())])

    def walk(pdf):
        pdf = pdf.sort_values([score, "pos"], ascending=[False, True], kind="stable")
        left, flags = int(pdf["__left"].iloc[0]), []
        for effort in pdf["__units"]:
            fits = effort is not None and effort <= left
            left -= int(effort) if fits else 0
            flags.append(fits)
        return pdf.assign(selected=flags)

    return todo.groupBy(*keys).applyInPandas(walk, schema)


def _narrow_hot_groups(hot: DataFrame, score: str, keys: list[str], limit: int) -> DataFrame:
    """(keys, pos) of the items taken in groups too large for one task.

    Each round, with running sums built by many tasks: take the longest prefix that fits,
    drop the first item that does not, walk the next `limit` items in one task, then drop
    every later item larger than what is left (it can never fit again). A round settles at
    least `limit` items of each group, mostly nearly all, and the sums are exact.
    """
    columns = [*keys, "pos", score, "__units", "__left"]
    todo, taken, none_left = hot.where(F.col("__units").isNotNull()).select(*columns), [], False
    while not none_left:
        small, large, _ = split_hot(todo, keys, limit)
        taken.append(_walk(small, score, keys).where("selected").select(*keys, "pos"))
        if large is None:
            break
        numbered = cut_lineage(ranked(
            large, keys, [F.desc(score), F.asc("pos")], rank="__rank",
            running={"__used": F.col("__units")}, limit=limit))
        misfit = F.col("__used") > F.col("__left")
        stops = numbered.groupBy(*keys).agg(F.min(F.when(misfit, F.col("__rank"))).alias("__stop"))
        placed = numbered.join(stops, keys)
        before_stop = F.col("__stop").isNull() | (F.col("__rank") < F.col("__stop"))
        prefix = placed.where(before_stop)
        taken.append(prefix.select(*keys, "pos"))
        used = prefix.groupBy(*keys).agg(F.sum("__units").alias("__spent"))
        rest = (
            placed.where(F.col("__rank") > F.col("__stop"))
            .join(used, keys, "left")
            .withColumn("__left", (F.col("__left") - F.coalesce("__spent", F.lit(0))).cast("decimal(38,0)")).drop("__spent"))
        chunk = _walk(rest.where(F.col("__rank") <= F.col("__stop") + limit).select(*columns), score, keys)
        chunk = cut_lineage(chunk)
        taken.append(chunk.where("selected").select(*keys, "pos"))
        after = chunk.groupBy(*keys).agg(
            F.sum(F.when(F.col("selected"), F.col("__units")).otherwise(F.lit(0))).alias("__spent"))
        later = (
            rest.where(F.col("__rank") > F.col("__stop") + limit)
            .join(after, keys, "left")
            .withColumn("__left", (F.col("__left") - F.coalesce("__spent", F.lit(0))).cast("decimal(38,0)")))
        # An item with negative effort could still give budget back to later ones.
        giveback = later.groupBy(*keys).agg(F.sum(F.least("__units", F.lit(0))).alias("__back"))
        todo = cut_lineage(
            later.join(giveback, keys)
            .where(F.col("__units") <= F.col("__left") - F.col("__back")).select(*columns))
        none_left = todo.isEmpty()
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def constrained_select(items: DataFrame, budget: float, score: str = "priority_score",
                       limit: int = WALK_ITEMS_LIMIT) -> DataFrame:
    """Excluded items never, mandatory ones always, the rest greedily under what is left.

    `mandatory` and `excluded` are boolean columns. Where the constraints cannot hold (an
    item is both, or the mandatory ones exceed the budget), they are ignored.
    """
    ruled = _ruled(items, budget)
    given = ruled.where("__fixed").withColumn("selected", F.coalesce("mandatory", F.lit(False))).drop("__left", "__fixed")
    left = F.col("__left").cast("decimal(38,6)") / F.lit(UNITS)
    free = greedy_select(ruled.where("NOT __fixed").withColumn("__budget", left).drop("__left", "__fixed"), F.col("__budget"), score, limit=limit)
    return free.drop("__budget").unionByName(given)


def _ruled(items: DataFrame, budget: float) -> DataFrame:
    """The items with `__fixed`, whether a constraint decides on them, and `__left`, the millionths of effort for the others."""
    must, never = F.coalesce("mandatory", F.lit(False)), F.coalesce("excluded", F.lit(False))
    facts = items.groupBy("repo_id").agg(
        F.coalesce(F.sum(F.when(must, units(F.col("effort")))), F.lit(0)).alias("__must_effort"),
        F.max(must & never).alias("__clash"))
    whole = units(F.lit(float(budget)))
    ok = ~F.col("__clash") & (F.col("__must_effort") <= whole)
    return joined(items, facts, ["repo_id"]).withColumns({
        "__fixed": ok & (must | never), "__left": whole - F.when(ok, F.col("__must_effort")).otherwise(F.lit(0))}).drop("__must_effort", "__clash")


def selection_gap(plan: DataFrame, budget: float, score: str = "priority_score", **limits) -> DataFrame:
    """(repo_id, selected_score, bound, gap): how far a selection can at most be from the best one.

    `bound` is the least Lagrangian bound of the sum of scores under the budget and the
    constraints: for a price p of effort, p * budget + sum of max(0, score - p * effort) over
    the free items, next to the mandatory ones. It is least at the ratio of score to effort of the
    first item, by descending ratio, that no longer fits, so one ranking finds the price of every
    repository. No selection that keeps the budget has more, and cutting that one item would
    reach it. Items without an effort, or with a score of 0 or less, add nothing.
    """
    ruled = _ruled(plan, budget)
    mine = plan.groupBy("repo_id").agg(F.coalesce(F.sum(F.when(F.col("selected"), F.col(score))), F.lit(0.0)).alias("selected_score"))
    given = F.when(F.col("__fixed") & F.coalesce("mandatory", F.lit(False)), F.col(score))
    fixed = ruled.groupBy("repo_id").agg(F.coalesce(F.sum(given), F.lit(0.0)).alias("__given"), F.max("__left").alias("__left"))
    free = ruled.where(~F.col("__fixed") & F.col("effort").isNotNull() & (F.col(score) > 0)).select(
        "repo_id", "pos", F.col(score).alias("__score"), units(F.col("effort")).alias("__units"), "__left")
    ratio = F.when(F.col("__units") > 0, F.col("__score") / F.col("__units")).otherwise(F.lit(float("inf")))
    free = cut_lineage(free.withColumn("__ratio", ratio))
    placed = ranked(free, ["repo_id"], [F.desc("__ratio"), F.asc("pos")], rank="__place", running={"__used": F.col("__units")}, **limits)
    price = cut_lineage(placed.groupBy("repo_id").agg(F.coalesce(F.max(F.when(F.col("__used") > F.col("__left"), F.col("__ratio"))), F.lit(0.0)).alias("__price")))
    over = F.greatest(F.lit(0.0), F.col("__score") - F.col("__price") * F.col("__units"))
    worth = joined(free, price, ["repo_id"]).groupBy("repo_id").agg((F.max(F.col("__price") * F.col("__left")) + F.sum(over)).alias("__worth"))
    bound = F.col("__given") + F.coalesce("__worth", F.lit(0.0))
    return joined(joined(mine, fixed, ["repo_id"]), worth, ["repo_id"], "left").select(
        "repo_id", "selected_score", bound.alias("bound"), (bound - F.col("selected_score")).alias("gap"))


def rank_items(items: DataFrame, score: str = "priority_score", **limits) -> DataFrame:
    return ranked(items, ["repo_id"], [F.desc(score), F.asc("pos")], **limits)


def with_reason(plan: DataFrame, budget: float, score: str = "priority_score", **limits) -> DataFrame:
    """Rank and reason of every item, from the effort selected up to it in rank order."""
    effort = F.when(F.col("selected"), units(F.col("effort"))).otherwise(F.lit(0))
    # Measured, then ranked: written once, so the selection is not walked again.
    out = ranked(cut_lineage(plan), ["repo_id"], [F.desc(score), F.asc("pos")], running={"__used": effort}, **limits)
    must, never = F.coalesce("mandatory", F.lit(False)), F.coalesce("excluded", F.lit(False))
    reason = (
        F.when(F.col("selected") & must, MANDATORY).when(F.col("selected"), SELECTED)
        .when(never, EXCLUDED)
        .when(F.col("__used") + units(F.col("effort")) > units(F.lit(float(budget))), OVER_BUDGET).otherwise(LOWER))
    return out.withColumn("selection_reason", reason).drop("__used")


def plan_summary(plan: DataFrame, budget: float) -> DataFrame:
    chosen = exact_sum(F.when(F.col("selected"), F.col("effort")).otherwise(F.lit(0.0)))
    return plan.groupBy("repo_id").agg(
        F.lit(float(budget)).alias("budget"), chosen.alias("effort_selected"),
        F.count_if("selected").alias("items_selected"), F.count(F.lit(1)).alias("items_total"),
        exact_sum(F.col("effort")).alias("effort_total"),
        (chosen / F.lit(float(budget)) * 100).alias("utilization_pct"))


def heuristic_plans(items: DataFrame, budget: float, weights: Mapping[str, float] | None = None,
                    limit: int = WALK_ITEMS_LIMIT) -> DataFrame:
    """Greedy selection under three orders: risk alone, coverage gap alone, priority score."""
    orders = with_priority_score(items, weights).withColumn("__o", F.explode(F.array(
        F.struct(F.lit("risk_only").alias("h"), F.col("risk").alias("s")),
        F.struct(F.lit("coverage_only").alias("h"),
                 F.coalesce("coverage_gap", F.lit(DEFAULT_COVERAGE_GAP)).alias("s")),
        F.struct(F.lit("effort_aware").alias("h"), F.col("priority_score").alias("s")))))
    listed = orders.select(*items.columns, F.col("__o.h").alias("heuristic"), F.col("__o.s").alias("order_score"))
    return greedy_select(listed, budget, "order_score", keys=("repo_id", "heuristic"), limit=limit)


def compare_heuristics(items: DataFrame, budget: float, weights: Mapping[str, float] | None = None,
                       limit: int = WALK_ITEMS_LIMIT) -> DataFrame:
    plans = heuristic_plans(items, budget, weights, limit)
    used = exact_sum(F.when(F.col("selected"), F.col("effort")).otherwise(F.lit(0.0)))
    risk = F.sum(F.when(F.col("selected"), F.col("risk")).otherwise(F.lit(0.0)))
    return plans.groupBy("repo_id", "heuristic").agg(
        F.count_if("selected").alias("items_selected"), used.alias("effort_used"),
        risk.alias("total_risk_covered"), (risk / F.greatest(used, F.lit(1.0))).alias("efficiency"))


def flag_best(comparison: DataFrame) -> DataFrame:
    """Mark the heuristics with the highest efficiency of each repository (a few rows each)."""
    best = comparison.groupBy("repo_id").agg(F.max("efficiency").alias("__best"))
    return comparison.join(best, "repo_id").withColumn(
        "is_best", F.col("efficiency") == F.col("__best")).drop("__best")

