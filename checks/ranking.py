"""Model evaluation, item selection, splits, folds and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from defectscope.operators import changes as ch
from defectscope.operators import evaluate as ev
from defectscope.operators import features as ft
from defectscope.operators import selection as sel
from checks.relational import CHANGES, changes

BUDGET = 1000

# --- evaluation ----------------------------------------------------------------------------

TABLE = """
grouped AS (SELECT model_id, probability, count(*) AS n, sum(label) AS pos FROM fx_predictions GROUP BY 1, 2),
tab AS (SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos, sum(n) OVER (PARTITION BY model_id) AS total_n,
               sum(pos) OVER (PARTITION BY model_id) AS total_pos
        FROM grouped WINDOW w AS (PARTITION BY model_id ORDER BY probability DESC))"""

TOP = """
placed AS (SELECT model_id, label, row_number() OVER (PARTITION BY model_id ORDER BY probability DESC, id) AS rn,
                  count(*) OVER (PARTITION BY model_id) AS n FROM fx_predictions),
top AS (SELECT model_id, CAST(sum(label) AS DOUBLE) AS p,
               CAST(sum(label) FILTER (WHERE rn <= greatest(1, floor(n * CAST(0.2 AS DOUBLE)))) AS DOUBLE) AS r,
               CAST(sum(label) FILTER (WHERE rn <= floor(n * CAST(0.2 AS DOUBLE))) AS DOUBLE) AS q FROM placed GROUP BY model_id)"""

GRID = """
grid AS (SELECT i, CASE WHEN i = 50 THEN 0.9e0 ELSE (i - 1) * ((0.9e0 - 0.1e0) / 49e0) + 0.1e0 END AS t FROM range(1, 51) r(i)),
hits AS (SELECT model_id, i, t, count(*) AS n, sum(label) AS p,
                CAST(sum(CASE WHEN probability >= t THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
                CAST(sum(CASE WHEN probability >= t THEN label ELSE 0 END) AS BIGINT) AS tp
         FROM fx_predictions, grid GROUP BY model_id, i, t),
scores AS (SELECT *, CASE WHEN flagged + p = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / CAST(flagged + p AS DOUBLE) END AS f1,
                  CAST(n - (flagged - tp) - (p - tp) AS DOUBLE) / CAST(n AS DOUBLE) AS acc FROM hits)"""


@query("recall_at_top_k", f"WITH {TOP} SELECT model_id, round(r / p, 6) AS recall_top FROM top")
def _(t):
    return ev.recall_at_top_k(t.fx_predictions).withColumn("recall_top", F.round("recall_top", 6))


@query("popt_at_k", f"WITH {TOP} SELECT model_id, round(q / p, 6) AS popt FROM top")
def _(t):
    return ev.popt_at_k(t.fx_predictions).withColumn("popt", F.round("popt", 6))


@query("optimal_threshold_f1", f"""
WITH {GRID} SELECT model_id, round(t, 9) AS threshold, round(f1, 9) AS best_score FROM scores
QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY f1 DESC, i) = 1""")
def _(t):
    out = ev.optimal_threshold(ev.score_table(t.fx_predictions))
    return out.withColumns({c: F.round(c, 9) for c in ("threshold", "best_score")})


@query("optimal_threshold_accuracy", f"""
WITH {GRID} SELECT model_id, round(t, 9) AS threshold, round(acc, 9) AS best_score FROM scores
QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY acc DESC, i) = 1""")
def _(t):
    out = ev.optimal_threshold(ev.score_table(t.fx_predictions), "accuracy")
    return out.withColumns({c: F.round(c, 9) for c in ("threshold", "best_score")})


COUNTS = """
counts AS (SELECT model_id, CAST(count(*) FILTER (WHERE label = 0 AND probability < 0.5e0) AS BIGINT) AS tn,
                  CAST(count(*) FILTER (WHERE label = 0 AND probability >= 0.5e0) AS BIGINT) AS fp,
                  CAST(count(*) FILTER (WHERE label = 1 AND probability < 0.5e0) AS BIGINT) AS fn,
                  CAST(count(*) FILTER (WHERE label = 1 AND probability >= 0.5e0) AS BIGINT) AS tp
           FROM fx_predictions GROUP BY model_id)"""


@query("confusion_matrix", f"""
WITH {COUNTS} SELECT *, concat('[[', tn, ',', fp, '],[', fn, ',', tp, ']]') AS matrix FROM counts""")
def _(t):
    out = ev.confusion(ev.score_table(t.fx_predictions), 0.5)
    return out.withColumn("matrix", F.to_json("matrix"))


@query("classification_metrics", f"""
WITH {COUNTS} SELECT model_id, round((tn + tp) / (tn + fp + fn + tp), 9) AS accuracy, round(tp / (tp + fp), 9) AS "precision",
  round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM counts""")
def _(t):
    out = ev.classification_metrics(ev.confusion(ev.score_table(t.fx_predictions), 0.5))
    return out.select("model_id", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("roc_auc", f"""
WITH {TABLE} SELECT model_id, round(sum((n - pos) * (CAST(cum_pos - pos AS DOUBLE) + pos / 2e0)) / max(CAST(total_pos AS DOUBLE) * (total_n - total_pos)), 9) AS roc_auc
FROM tab GROUP BY model_id""")
def _(t):
    return ev.roc_auc(ev.score_table(t.fx_predictions)).withColumn("roc_auc", F.round("roc_auc", 9))


@query("average_precision", f"""
WITH {TABLE} SELECT model_id, round(sum(pos * (CAST(cum_pos AS DOUBLE) / cum_n)) / max(total_pos), 9) AS pr_auc FROM tab GROUP BY model_id""")
def _(t):
    return ev.average_precision(ev.score_table(t.fx_predictions)).withColumn("pr_auc", F.round("pr_auc", 9))


@query("model_evaluation", f"""
WITH {GRID}, {TOP}, {TABLE},
best AS (SELECT *, flagged - tp AS fp, p - tp AS fn FROM scores QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY f1 DESC, i) = 1),
auc AS (SELECT model_id, sum((n - pos) * (CAST(cum_pos - pos AS DOUBLE) + pos / 2e0)) / max(CAST(total_pos AS DOUBLE) * (total_n - total_pos)) AS roc,
               sum(pos * (CAST(cum_pos AS DOUBLE) / cum_n)) / max(total_pos) AS ap FROM tab GROUP BY model_id)
SELECT b.model_id, round(t, 9) AS threshold, round(f1, 9) AS f1, round(acc, 9) AS accuracy, tp, round(roc, 9) AS roc_auc, round(ap, 9) AS pr_auc,
       round(r / top.p, 9) AS recall_top, round(q / top.p, 9) AS popt
FROM best b JOIN auc ON auc.model_id = b.model_id JOIN top ON top.model_id = b.model_id""")
def _(t):
    out = ev.evaluate_models(t.fx_predictions)
    rounded = ["threshold", "f1", "accuracy", "roc_auc", "pr_auc", "recall_top", "popt"]
    return out.select("model_id", "tp", *[F.round(c, 9).alias(c) for c in rounded])


# --- selection -----------------------------------------------------------------------------

# Efforts have tenths; both sides add them up exactly.
SCORED = """
scored AS (SELECT * REPLACE (CAST(effort AS DECIMAL(28, 6)) AS effort), (risk * 1e0 + coalesce(criticite, 1e0) * 0.5e0 + coalesce(coverage_gap, 0e0) * 0.2e0) / sqrt(greatest(effort, 1e0)) AS score
           FROM fx_test_items)"""


def walk_sql(source: str, keys: str, budget: str) -> str:
    """A recursive walk of `source`(keys, pos, ord, effort) in order under `budget`."""
    on = " AND ".join(f"n.{k} = w.{k}" for k in keys.split(", "))
    cols = ", ".join(f"n.{k}" for k in keys.split(", "))
    return f"""
nums AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ord DESC, pos) AS rn FROM {source}),
walk AS (SELECT {keys}, pos, rn, effort <= {budget} AS selected, CAST({budget} - CASE WHEN effort <= {budget} THEN effort ELSE 0 END AS DECIMAL(28, 6)) AS rem
         FROM nums WHERE rn = 1
         UNION ALL
         SELECT {cols}, n.pos, n.rn, n.effort <= w.rem, CAST(w.rem - CASE WHEN n.effort <= w.rem THEN n.effort ELSE 0 END AS DECIMAL(28, 6))
         FROM walk w JOIN nums n ON {on} AND n.rn = w.rn + 1)"""


def scored(t):
    return sel.with_priority_score(t.fx_test_items)


@query("priority_score", f"WITH {SCORED} SELECT repo_id, id, round(score, 9) AS priority_score FROM scored")
def _(t):
    return scored(t).select("repo_id", "id", F.round("priority_score", 9).alias("priority_score"))


@query("item_ranks", f"""
WITH {SCORED} SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, pos) AS "rank" FROM scored""")
def _(t):
    return sel.rank_items(scored(t)).select("repo_id", "id", "rank")


@query("greedy_selection", f"""
WITH {SCORED}, todo AS (SELECT repo_id, pos, effort, score AS ord FROM scored), {walk_sql('todo', 'repo_id', '1000')}
SELECT repo_id, pos, selected FROM walk""")
def _(t):
    return sel.greedy_select(scored(t), BUDGET).select("repo_id", "pos", "selected")


CONSTRAINED = f"""
{SCORED},
facts AS (SELECT repo_id, coalesce(sum(effort) FILTER (WHERE mandatory), 0) AS must, bool_or(mandatory AND excluded) AS clash FROM scored GROUP BY repo_id),
ruled AS (SELECT s.*, NOT clash AND must <= 1000 AS ok, CASE WHEN NOT clash AND must <= 1000 THEN 1000 - must ELSE 1000 END AS budget
          FROM scored s JOIN facts f ON f.repo_id = s.repo_id),
todo AS (SELECT repo_id, pos, effort, score AS ord, CAST(budget AS DECIMAL(28, 6)) AS budget FROM ruled WHERE NOT (ok AND (mandatory OR excluded))),
nums AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ord DESC, pos) AS rn FROM todo),
walk AS (SELECT repo_id, pos, rn, effort <= budget AS selected, CAST(budget - CASE WHEN effort <= budget THEN effort ELSE 0 END AS DECIMAL(28, 6)) AS rem FROM nums WHERE rn = 1
         UNION ALL
         SELECT n.repo_id, n.pos, n.rn, n.effort <= w.rem, CAST(w.rem - CASE WHEN n.effort <= w.rem THEN n.effort ELSE 0 END AS DECIMAL(28, 6))
         FROM walk w JOIN nums n ON n.repo_id = w.repo_id AND n.rn = w.rn + 1),
plan AS (SELECT r.*, coalesce(w.selected, r.mandatory) AS selected FROM ruled r LEFT JOIN walk w ON w.repo_id = r.repo_id AND w.pos = r.pos)"""


def plan(t):
    return sel.constrained_select(scored(t), BUDGET)


@query("constrained_selection", f"WITH {CONSTRAINED} SELECT repo_id, pos, selected FROM plan")
def _(t):
    return plan(t).select("repo_id", "pos", "selected")


@query("selection_gap", f"""
WITH {CONSTRAINED}, free AS (SELECT repo_id, pos, score, effort, score / effort AS ratio, CAST(budget AS DOUBLE) AS budget FROM ruled WHERE NOT (ok AND (mandatory OR excluded)) AND score > 0),
used AS (SELECT *, sum(effort) OVER (PARTITION BY repo_id ORDER BY ratio DESC, pos ROWS UNBOUNDED PRECEDING) AS used FROM free),
parts AS (SELECT repo_id, sum(CASE WHEN used <= budget THEN score WHEN used - effort < budget THEN score * (budget - (used - effort)) / effort ELSE 0 END) AS worth FROM used GROUP BY repo_id),
given AS (SELECT repo_id, coalesce(sum(score) FILTER (WHERE ok AND mandatory), 0) AS given FROM ruled GROUP BY repo_id),
mine AS (SELECT repo_id, coalesce(sum(score) FILTER (WHERE selected), 0) AS mine FROM plan GROUP BY repo_id)
SELECT repo_id, round(mine, 6) AS selected_score, round(given + coalesce(worth, 0), 6) AS bound, round(given + coalesce(worth, 0) - mine, 6) + 0e0 AS gap
FROM mine JOIN given USING (repo_id) LEFT JOIN parts USING (repo_id)""")
def _(t):
    """The SQL fills the budget by descending ratio and cuts the last item; the operator prices effort."""
    out = sel.selection_gap(plan(t), BUDGET)
    return out.select("repo_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("selected_score", "bound", "gap")))


@query("plan_with_reasons", f"""
WITH {CONSTRAINED}, ordered AS (
  SELECT *, row_number() OVER w AS "rank", sum(CASE WHEN selected THEN effort ELSE 0 END) OVER w AS used
  FROM plan WINDOW w AS (PARTITION BY repo_id ORDER BY score DESC, pos))
SELECT repo_id, id, "rank", selected,
       CASE WHEN selected AND mandatory THEN 'Mandatory item' WHEN selected THEN 'Selected by optimization'
            WHEN excluded THEN 'Excluded by constraint' WHEN used + effort > 1000 THEN 'Budget exceeded' ELSE 'Lower priority' END AS selection_reason
FROM ordered""")
def _(t):
    return sel.with_reason(plan(t), BUDGET).select("repo_id", "id", "rank", "selected", "selection_reason")


@query("plan_summary", f"""
WITH {CONSTRAINED} SELECT repo_id, CAST(1000 AS DOUBLE) AS budget, CAST(coalesce(sum(effort) FILTER (WHERE selected), 0) AS DOUBLE) AS effort_selected,
  count(*) FILTER (WHERE selected) AS items_selected, count(*) AS items_total, CAST(sum(effort) AS DOUBLE) AS effort_total,
  round(CAST(coalesce(sum(effort) FILTER (WHERE selected), 0) AS DOUBLE) / 1000 * 100, 6) AS utilization_pct FROM plan GROUP BY repo_id""")
def _(t):
    return sel.plan_summary(plan(t), BUDGET).withColumn("utilization_pct", F.round("utilization_pct", 6))


COMPARED = f"""
{SCORED},
todo AS (SELECT repo_id, 'risk_only' AS heuristic, pos, effort, risk, id, risk AS ord FROM scored UNION ALL
         SELECT repo_id, 'coverage_only', pos, effort, risk, id, coalesce(coverage_gap, 0e0) FROM scored UNION ALL
         SELECT repo_id, 'effort_aware', pos, effort, risk, id, score FROM scored),
{walk_sql('todo', 'repo_id, heuristic', '1000')},
plans AS (SELECT t.*, w.selected FROM todo t JOIN walk w ON w.repo_id = t.repo_id AND w.heuristic = t.heuristic AND w.pos = t.pos),
cmp AS (SELECT repo_id, heuristic, count(*) FILTER (WHERE selected) AS items_selected, CAST(sum(CASE WHEN selected THEN effort ELSE 0 END) AS DOUBLE) AS effort_used,
               sum(CASE WHEN selected THEN risk ELSE 0 END) AS covered FROM plans GROUP BY 1, 2)"""


@query("heuristic_comparison", f"""
WITH {COMPARED} SELECT repo_id, heuristic, items_selected, effort_used, round(covered, 6) AS total_risk_covered,
  round(covered / greatest(effort_used, 1), 6) AS efficiency FROM cmp""")
def _(t):
    out = sel.compare_heuristics(t.fx_test_items, BUDGET)
    return out.withColumns({c: F.round(c, 6) for c in ("total_risk_covered", "efficiency")})


@query("best_heuristic", f"""
WITH {COMPARED}, e AS (SELECT repo_id, heuristic, round(covered / greatest(effort_used, 1), 9) AS eff FROM cmp)
SELECT repo_id, heuristic, eff = max(eff) OVER (PARTITION BY repo_id) AS is_best FROM e""")
def _(t):
    out = sel.compare_heuristics(t.fx_test_items, BUDGET).withColumn("efficiency", F.round("efficiency", 9))
    return sel.flag_best(out).select("repo_id", "heuristic", "is_best")


@query("selection_evaluation", f"""
WITH {COMPARED}, labels AS (SELECT p_partkey % 25 AS repo_id, concat('T', CAST(p_partkey AS STRING)) AS id,
       CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) > 40 THEN 1 ELSE 0 END AS label
     FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
e AS (SELECT p.repo_id, heuristic, count(*) FILTER (WHERE selected AND label = 1) AS defects_caught, count(*) FILTER (WHERE label = 1) AS defects_total,
             count(*) FILTER (WHERE selected) AS items_selected FROM plans p JOIN labels l ON l.repo_id = p.repo_id AND l.id = p.id GROUP BY 1, 2)
SELECT *, round(CASE WHEN defects_total = 0 THEN 0 ELSE defects_caught / defects_total END, 9) AS recall,
       round(CASE WHEN items_selected = 0 THEN 0 ELSE defects_caught / items_selected END, 9) AS "precision" FROM e""")
def _(t):
    returned = F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)) > 40
    labels = (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
              .groupBy((F.col("p_partkey") % 25).alias("repo_id"), F.concat(F.lit("T"), F.col("p_partkey")).alias("id"))
              .agg(returned.cast("int").alias("label")))
    out = ev.evaluate_selection(sel.heuristic_plans(t.fx_test_items, BUDGET), labels)
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "precision")})


@query("predictions_to_items", """
SELECT repo_id, id, probability AS risk, 100e0 AS effort, 1e0 AS criticite FROM fx_predictions
QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY id) <= 50""")
def _(t):
    preds = t.fx_predictions.withColumns({"pos": F.col("id"), "risk_score": F.col("probability")})
    return sel.predictions_to_items(preds).select("repo_id", "id", "risk", "effort", "criticite")


# --- features ------------------------------------------------------------------------------

@query("filled_metrics", """
SELECT repo_id, id, coalesce(cbo, 0) AS cbo, wmc, rfc, loc FROM fx_file_metrics""")
def _(t):
    return ft.fill_metrics(t.fx_file_metrics).select("repo_id", "id", "cbo", "wmc", "rfc", "loc")


@query("feature_projection", """
SELECT id, wmc, dit, noc, cbo, rfc, lcom, cyclomatic_complexity, max_cyclomatic_complexity, avg_cyclomatic_complexity,
       fan_in, fan_out, loc, sloc, num_methods, num_classes, code_smells_count FROM fx_file_metrics""")
def _(t):
    return ft.project_features(t.fx_file_metrics, keep=["id"])


@query("assembled_features", f"""
WITH {CHANGES} SELECT m.id, 16 AS n_features, CASE WHEN b.filepath IS NULL THEN 0e0 ELSE 1e0 END AS label,
  cyclomatic_complexity + max_cyclomatic_complexity + avg_cyclomatic_complexity + wmc + dit + noc + coalesce(cbo, 0) + rfc + lcom
  + fan_in + fan_out + loc + sloc + num_methods + num_classes + code_smells_count AS total
FROM fx_file_metrics m LEFT JOIN buggy b ON b.repo_id = m.repo_id AND b.filepath = m.filepath""")
def _(t):
    from pyspark.ml.functions import vector_to_array

    rows = ft.fill_metrics(ch.with_bug_labels(t.fx_file_metrics, changes(t)))
    out = ft.assemble_features(rows).withColumn("a", vector_to_array("features"))
    return out.select("id", F.size("a").alias("n_features"), "label",
                      F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("cleaned_numbers", """
SELECT id, CASE WHEN id % 3 = 0 THEN 0e0 WHEN id % 3 = 1 THEN 1.7976931348623157e308 ELSE wmc END AS bounded,
       CASE WHEN id % 3 < 2 THEN 0e0 ELSE wmc END AS zeroed FROM fx_file_metrics""")
def _(t):
    odd = (F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, F.lit(float("inf")))
           .otherwise(F.col("wmc")))
    rows = t.fx_file_metrics.select("id", odd.alias("bounded"), odd.alias("zeroed"))
    return ft.clean_numeric(ft.clean_numeric(rows, ["bounded"], "bound"), ["zeroed"], "zero")


@query("temporal_split", """
SELECT repo_id, id, CASE WHEN row_number() OVER (PARTITION BY repo_id ORDER BY created_at NULLS LAST, id)
         <= floor(count(*) OVER (PARTITION BY repo_id) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM fx_file_metrics""")
def _(t):
    return ft.temporal_split(t.fx_file_metrics).select("repo_id", "id", "split")


RANDOM = """row_number() OVER (PARTITION BY {keys} ORDER BY md5(concat(CAST(id AS STRING), '|42')), id)"""


@query("random_split", f"""
SELECT repo_id, id, CASE WHEN {RANDOM.format(keys='repo_id')} > ceil(count(*) OVER (PARTITION BY repo_id) * CAST(0.2 AS DOUBLE))
         THEN 'train' ELSE 'test' END AS split FROM fx_file_metrics""")
def _(t):
    return ft.random_split(t.fx_file_metrics).select("repo_id", "id", "split")


LABELED = f"""{CHANGES}, labeled AS (SELECT m.*, CASE WHEN b.filepath IS NULL THEN 0 ELSE 1 END AS is_buggy
  FROM fx_file_metrics m LEFT JOIN buggy b ON b.repo_id = m.repo_id AND b.filepath = m.filepath)"""


@query("stratified_split", f"""
WITH {LABELED} SELECT repo_id, id, is_buggy, CASE WHEN {RANDOM.format(keys='repo_id, is_buggy')}
         > ceil(count(*) OVER (PARTITION BY repo_id, is_buggy) * CAST(0.2 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM labeled""")
def _(t):
    labeled = ch.with_bug_labels(t.fx_file_metrics, changes(t))
    return ft.stratified_split(labeled).select("repo_id", "id", "is_buggy", "split")


@query("stratified_folds", f"""
WITH {LABELED} SELECT repo_id, id, is_buggy, CAST(({RANDOM.format(keys='repo_id, is_buggy')} - 1) % 5 AS INT) AS fold FROM labeled""")
def _(t):
    labeled = ch.with_bug_labels(t.fx_file_metrics, changes(t))
    return ft.with_folds(labeled).select("repo_id", "id", "is_buggy", "fold")


@query("scaler_statistics", """
SELECT repo_id, round(avg(wmc), 6) AS wmc__mean, round(stddev_pop(wmc), 6) AS wmc__std, round(avg(rfc), 6) AS rfc__mean,
       round(CASE WHEN stddev_pop(rfc) = 0 THEN 1 ELSE stddev_pop(rfc) END, 6) AS rfc__std FROM fx_file_metrics GROUP BY repo_id""")
def _(t):
    out = ft.fit_scaler(t.fx_file_metrics, ["wmc", "rfc"], ["repo_id"])
    return out.select("repo_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "repo_id"])


@query("scaled_features", """
SELECT id, round((wmc - m1) / s1, 6) AS wmc, round((rfc - m2) / s2, 6) AS rfc FROM fx_file_metrics,
  (SELECT avg(wmc) AS m1, stddev_pop(wmc) AS s1, avg(rfc) AS m2, stddev_pop(rfc) AS s2 FROM fx_file_metrics) s""")
def _(t):
    rows = t.fx_file_metrics.select("id", "wmc", "rfc")
    out = ft.scale(rows, ["wmc", "rfc"], ft.fit_scaler(rows, ["wmc", "rfc"]))
    return out.select("id", F.round("wmc", 6).alias("wmc"), F.round("rfc", 6).alias("rfc"))


@query("class_frames_union", f"""
WITH {LABELED} SELECT repo_id, id, is_buggy FROM labeled""")
def _(t):
    metrics = t.fx_file_metrics.select("repo_id", "id", "filepath")
    buggy = ch.only_buggy(metrics, changes(t)).withColumn("is_buggy", F.lit(1))
    clean = ch.only_clean(metrics, changes(t)).withColumn("is_buggy", F.lit(0))
    return ft.union_frames(buggy, clean).select("repo_id", "id", "is_buggy")


@query("distinct_keys", "SELECT DISTINCT repo_id, author_name FROM fx_commits")
def _(t):
    return ft.distinct_keys(t.fx_commits, ["repo_id", "author_name"])


@query("dataset_profile", f"""
WITH {LABELED}, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY repo_id ORDER BY created_at NULLS LAST, id)
         <= floor(count(*) OVER (PARTITION BY repo_id) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM labeled)
SELECT repo_id, split, count(*) AS samples, CAST(16 AS BIGINT) AS n_features, CAST(sum(is_buggy) AS BIGINT) AS buggy,
       round(sum(is_buggy) / count(*), 9) AS buggy_ratio FROM s GROUP BY 1, 2""")
def _(t):
    from defectscope.operators.dashboards import dataset_profile

    labeled = ch.with_bug_labels(t.fx_file_metrics, changes(t))
    split = ft.split_dataset(labeled)
    out = dataset_profile(split, len(ft.feature_columns(split)))
    return out.withColumn("buggy_ratio", F.round("buggy_ratio", 9))
