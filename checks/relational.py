"""Changes, joins, summaries, listings and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import query
from defectscope.functions import commits as cx
from defectscope.functions.scoring import priority_score
from defectscope.operators import changes as ch
from defectscope.operators import dashboards as db
from defectscope.operators import metrics as mt
from defectscope.operators.ranking import top_rows
from defectscope.session import scratch_path
from defectscope.sources import registry

CHANGES = """
bug_commits AS (SELECT *, lower(message) LIKE '%fix%' OR lower(message) LIKE '%bug%' OR lower(message) LIKE '%issue%'
                  OR lower(message) LIKE '%error%' OR lower(message) LIKE '%patch%' AS is_bugfix FROM fx_commits),
changes AS (SELECT f.*, c.message, c.author_name, c.committed_at, c.is_bugfix
            FROM fx_files f JOIN bug_commits c ON f.commit_id = c.id),
stats AS (SELECT repo_id, filepath, count(*) AS change_frequency, count(DISTINCT author_name) AS author_count
          FROM changes GROUP BY repo_id, filepath),
buggy AS (SELECT DISTINCT repo_id, filepath FROM changes WHERE is_bugfix)"""


def commits(t):
    return ch.with_is_bugfix(t.fx_commits)


def changes(t):
    return ch.file_changes(t.fx_files, commits(t))


@query("bugfix_commits", f"WITH {CHANGES} SELECT id, repo_id, is_bugfix FROM bug_commits")
def _(t):
    return commits(t).select("id", "repo_id", "is_bugfix")


@query("normalized_commits", """
SELECT id, repo_id, substr(coalesce(m, ''), 1, 500) AS message, coalesce(a, 'Unknown') AS author_name,
       lower(coalesce(m, '')) SIMILAR TO '(?s).*(fix|bug|issue|error|patch).*' AS is_bugfix
FROM (SELECT id, repo_id, CASE WHEN id % 11 = 0 THEN NULL ELSE concat(repeat('x', CAST(id % 700 AS INT)), message) END AS m,
             CASE WHEN id % 7 = 0 THEN NULL ELSE author_name END AS a FROM fx_commits) r""")
def _(t):
    from defectscope.sources.landing import normalize_commits

    raw = t.fx_commits.select(
        "id", "repo_id", "sha", "committed_at", F.lit(None).cast("string").alias("author_email"),
        F.expr("CASE WHEN id % 11 = 0 THEN NULL ELSE concat(repeat('x', CAST(id % 700 AS INT)), message) END").alias("message"),
        F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE author_name END").alias("author_name"))
    return normalize_commits(raw).select("id", "repo_id", "message", "author_name", "is_bugfix")


@query("parsed_dates", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate END AS parsed FROM orders""")
def _(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+02:00")))
            .when(k == 2, iso).when(k == 3, F.concat(iso, F.lit("-0530"))).otherwise(F.lit("junk")))
    return t.orders.select(F.col("o_orderkey").alias("id"), cx.parse_iso(text).alias("parsed"))


@query("repo_owner_and_name", """
SELECT id, split_part(rtrim(url, '/'), '/', -2) AS owner, replace(split_part(rtrim(url, '/'), '/', -1), '.git', '') AS repo,
       regexp_replace(regexp_replace(url, '\\.git$', ''), '/$', '') AS normalized FROM fx_repos""")
def _(t):
    url = F.col("url")
    return t.fx_repos.select("id", cx.owner_of(url).alias("owner"), cx.repo_name_of(url).alias("repo"),
                             cx.normalized_url(url).alias("normalized"))


@query("files_by_language", """
SELECT CASE extension WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript'
       WHEN '.go' THEN 'go' WHEN '.cpp' THEN 'cpp' ELSE 'unknown' END AS language, count(*) AS files
FROM fx_files GROUP BY 1""")
def _(t):
    return mt.with_language(t.fx_files).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@query("analyzable_files", """
SELECT commit_id, repo_id, filepath, extension FROM fx_files WHERE extension IN ('.py', '.java', '.js', '.ts', '.cpp', '.c', '.go')""")
def _(t):
    return ch.analyzable_files(t.fx_files).select("commit_id", "repo_id", "filepath", "extension")


@query("file_changes", f"WITH {CHANGES} SELECT repo_id, commit_id, filepath, author_name, committed_at, is_bugfix FROM changes")
def _(t):
    return changes(t).select("repo_id", "commit_id", "filepath", "author_name", "committed_at", "is_bugfix")


@query("change_stats", f"WITH {CHANGES} SELECT * FROM stats")
def _(t):
    return ch.change_stats(changes(t))


@query("buggy_files", f"WITH {CHANGES} SELECT * FROM buggy")
def _(t):
    return ch.buggy_files(changes(t))


@query("bug_history", f"""
WITH {CHANGES} SELECT repo_id, filepath, CAST(count(*) FILTER (WHERE is_bugfix) AS BIGINT) AS bug_history
FROM changes GROUP BY repo_id, filepath""")
def _(t):
    return ch.bug_history(changes(t))


@query("bug_history_before_row", f"""
WITH {CHANGES} SELECT m.repo_id, m.id, count(c.commit_id) AS bug_history
FROM fx_file_metrics m LEFT JOIN changes c ON c.repo_id = m.repo_id AND c.filepath = m.filepath AND c.is_bugfix
  AND c.committed_at < m.created_at + INTERVAL 1000 DAY
GROUP BY m.repo_id, m.id""")
def _(t):
    later = t.fx_file_metrics.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1000 DAYS"))
    return ch.bug_history_before(later, changes(t))


@query("recent_changes", f"""
WITH {CHANGES}, edge AS (SELECT max(committed_at) AS as_of FROM bug_commits)
SELECT repo_id, filepath,
       CAST(count(*) FILTER (WHERE committed_at > as_of - INTERVAL 400 DAYS) AS BIGINT) AS recent_changes,
       CAST(count(*) FILTER (WHERE committed_at > as_of - INTERVAL 800 DAYS AND committed_at <= as_of - INTERVAL 400 DAYS) AS BIGINT) AS previous_changes
FROM changes, edge GROUP BY repo_id, filepath""")
def _(t):
    as_of = commits(t).agg(F.max("committed_at")).first()[0]
    return ch.recent_changes(changes(t), F.lit(str(as_of)).cast("timestamp_ntz"), days=400)


@query("rolling_changes", f"""
WITH {CHANGES}, times AS (SELECT DISTINCT repo_id, filepath, committed_at FROM changes)
SELECT t.repo_id, t.filepath, t.committed_at, count(*) AS changes FROM times t JOIN changes c ON c.repo_id = t.repo_id AND c.filepath = t.filepath
  AND c.committed_at > t.committed_at - INTERVAL 400 DAY AND c.committed_at <= t.committed_at GROUP BY 1, 2, 3""")
def _(t):
    return ch.rolling_changes(changes(t), days=400)


@query("change_features", f"""
WITH {CHANGES}, fixes AS (SELECT repo_id, filepath, count(*) AS change_frequency, count(DISTINCT author_name) AS author_count
                   FROM changes GROUP BY repo_id, filepath)
SELECT m.repo_id, m.id, coalesce(s.change_frequency, 0) AS change_frequency, coalesce(s.author_count, 1) AS author_count
FROM fx_file_metrics m LEFT JOIN fixes s
  ON s.repo_id = m.repo_id AND s.filepath = m.filepath""")
def _(t):
    stats = ch.change_stats(changes(t))
    return ch.with_change_features(t.fx_file_metrics, stats).select("repo_id", "id", "change_frequency", "author_count")


@query("bug_labels", f"""
WITH {CHANGES} SELECT m.repo_id, m.id, CASE WHEN b.filepath IS NULL THEN 0 ELSE 1 END AS is_buggy
FROM fx_file_metrics m LEFT JOIN buggy b ON b.repo_id = m.repo_id AND b.filepath = m.filepath""")
def _(t):
    return ch.with_bug_labels(t.fx_file_metrics, changes(t)).select("repo_id", "id", "is_buggy")


@query("only_buggy_files", f"""
WITH {CHANGES} SELECT m.repo_id, m.id FROM fx_file_metrics m SEMI JOIN buggy b ON b.repo_id = m.repo_id AND b.filepath = m.filepath""")
def _(t):
    return ch.only_buggy(t.fx_file_metrics, changes(t)).select("repo_id", "id")


@query("only_clean_files", f"""
WITH {CHANGES} SELECT m.repo_id, m.id FROM fx_file_metrics m ANTI JOIN buggy b ON b.repo_id = m.repo_id AND b.filepath = m.filepath""")
def _(t):
    return ch.only_clean(t.fx_file_metrics, changes(t)).select("repo_id", "id")


@query("risky_files_by_priority", f"""
WITH {CHANGES}, scored AS (
  SELECT m.repo_id, m.id, m.filepath, coalesce(s.change_frequency, 0) AS change_frequency,
         CASE WHEN b.filepath IS NULL THEN 0 ELSE 1 END AS is_buggy,
         (m.cyclomatic_complexity / 60 + CAST(0.5 AS DOUBLE)) / sqrt(CAST(greatest(m.sloc, 1) AS DOUBLE)) AS score
  FROM fx_file_metrics m LEFT JOIN stats s ON s.repo_id = m.repo_id AND s.filepath = m.filepath
  LEFT JOIN buggy b ON b.repo_id = m.repo_id AND b.filepath = m.filepath)
SELECT repo_id, id, filepath, change_frequency, is_buggy, round(score, 6) AS priority_score
FROM scored QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, id) <= 10""")
def _(t):
    history = ch.file_history(changes(t))
    files = t.fx_file_metrics.join(history, ["repo_id", "filepath"], "left")
    score = priority_score(F.col("cyclomatic_complexity") / 60, F.col("sloc").cast("double"), F.lit(1.0), F.lit(0.0))
    scored = files.select(
        "repo_id", "id", "filepath", F.coalesce("change_frequency", F.lit(0)).alias("change_frequency"),
        F.coalesce("is_buggy", F.lit(0)).alias("is_buggy"), score.alias("score"))
    first = top_rows(scored, ["repo_id"], [F.desc("score"), F.asc("id")], 10)
    return first.withColumn("priority_score", F.round("score", 6)).drop("score")


@query("latest_commits", """
WITH dated AS (SELECT repo_id, id, sha, CASE WHEN id % 29 = 0 THEN NULL ELSE committed_at END AS committed_at FROM fx_commits)
SELECT * FROM dated QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC NULLS FIRST, id) <= 50""")
def _(t):
    dated = F.when(F.col("id") % 29 != 0, F.col("committed_at"))  # unparsable dates are null
    return ch.latest_commits(t.fx_commits.withColumn("committed_at", dated)).select("repo_id", "id", "sha", "committed_at")


# --- summaries -----------------------------------------------------------------------------

@query("analysis_summary", """
SELECT r.id AS repo_id, n AS total_files, round(cc, 6) AS avg_complexity, max_cc AS max_complexity, round(wmc, 6) AS avg_wmc,
       round(cbo, 6) AS avg_cbo, round(lcom, 6) AS avg_lcom, smells AS total_smells, loc AS total_loc,
       CASE WHEN n IS NULL THEN 'no_data' ELSE 'analyzed' END AS status
FROM fx_repos r LEFT JOIN (
  SELECT repo_id, count(*) AS n, avg(cyclomatic_complexity) AS cc, max(cyclomatic_complexity) AS max_cc, avg(wmc) AS wmc, avg(cbo) AS cbo,
         avg(lcom) AS lcom, CAST(sum(code_smells_count) AS BIGINT) AS smells, CAST(sum(loc) AS BIGINT) AS loc
  FROM fx_file_metrics GROUP BY repo_id) m ON m.repo_id = r.id""")
def _(t):
    rounded = ["avg_complexity", "avg_wmc", "avg_cbo", "avg_lcom"]
    out = db.analysis_summary(t.fx_file_metrics, t.fx_repos)
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query("repo_metrics", f"""
WITH {CHANGES}
SELECT r.id AS repo_id, coalesce(ct, 0) AS commits_total, coalesce(cb, 0) AS commits_bugfixes,
       coalesce(it, 0) AS issues_total, coalesce(ib, 0) AS issues_bugs,
       round(coalesce(cc, 0), 6) AS avg_complexity, round(coalesce(wmc, 0), 6) AS avg_wmc, round(coalesce(cbo, 0), 6) AS avg_cbo,
       coalesce(smells, 0) AS total_smells, coalesce(files, 0) AS total_files
FROM fx_repos r
LEFT JOIN (SELECT repo_id, count(*) AS ct, CAST(sum(CASE WHEN is_bugfix THEN 1 ELSE 0 END) AS BIGINT) AS cb FROM bug_commits GROUP BY 1) c ON c.repo_id = r.id
LEFT JOIN (SELECT repo_id, count(*) AS it, CAST(sum(CASE WHEN is_bug THEN 1 ELSE 0 END) AS BIGINT) AS ib FROM fx_issues GROUP BY 1) i ON i.repo_id = r.id
LEFT JOIN (SELECT repo_id, avg(cyclomatic_complexity) AS cc, avg(wmc) AS wmc, avg(cbo) AS cbo,
                  CAST(sum(code_smells_count) AS BIGINT) AS smells, count(*) AS files FROM fx_file_metrics GROUP BY 1) m ON m.repo_id = r.id""")
def _(t):
    out = db.repo_metrics(t.fx_repos, commits(t), t.fx_issues, t.fx_file_metrics)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_complexity", "avg_wmc", "avg_cbo")})


@query("repo_model_quality", """
SELECT r.id, r.name, round(coalesce(a, CAST(0.85 AS DOUBLE)), 6) AS avg_accuracy,
       CAST(floor(coalesce(a, CAST(0.85 AS DOUBLE)) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS coverage
FROM fx_repos r LEFT JOIN (SELECT repo_id, avg(accuracy) AS a FROM fx_models GROUP BY 1) m ON m.repo_id = r.id""")
def _(t):
    out = db.repo_model_quality(t.fx_repos, t.fx_models)
    return out.select("id", "name", F.round("avg_accuracy", 6).alias("avg_accuracy"), "coverage")


@query("overview_cards", """
WITH r AS (SELECT count(*) AS repo_count, CAST(sum(id % 30 + 60) AS DOUBLE) AS cov, CAST(sum(id % 3) AS BIGINT) AS open_defects FROM fx_repos),
m AS (SELECT count(*) AS model_count, avg(accuracy) AS acc FROM fx_models)
SELECT repo_count, model_count, open_defects, CAST(floor(cov / repo_count + CAST(0.5 AS DOUBLE)) AS BIGINT) AS avg_coverage,
       CAST(floor(acc * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS accuracy_pct,
       CASE WHEN floor(cov / repo_count + CAST(0.5 AS DOUBLE)) >= 80 THEN 'good' WHEN floor(cov / repo_count + CAST(0.5 AS DOUBLE)) >= 60 THEN 'warn' ELSE 'bad' END AS coverage_tone,
       'good' AS models_tone, 'good' AS repos_tone,
       CASE WHEN open_defects > 20 THEN 'bad' WHEN open_defects > 10 THEN 'warn' ELSE 'good' END AS defects_tone,
       CASE WHEN open_defects > 10 THEN 'Need attention' ELSE 'Under control' END AS defects_trend
FROM r, m""")
def _(t):
    repos = t.fx_repos.withColumn("coverage", F.col("id") % 30 + 60).withColumn("open_defects", F.col("id") % 3)
    return db.overview_cards(repos, t.fx_models)


@query("module_totals", """
SELECT repo_id, round(avg(coverage), 6) AS avg_coverage, CAST(sum(defects) AS BIGINT) AS total_defects FROM fx_modules GROUP BY repo_id""")
def _(t):
    return db.module_totals(t.fx_modules).withColumn("avg_coverage", F.round("avg_coverage", 6))


@query("module_bands", """
SELECT repo_id, id, CASE WHEN coverage >= 90 THEN 'green' WHEN coverage >= 70 THEN 'yellow' ELSE 'red' END AS coverage_band,
       CASE WHEN risk <= CAST(0.2 AS DOUBLE) THEN 'Low' WHEN risk <= CAST(0.5 AS DOUBLE) THEN 'Medium' ELSE 'High' END AS risk_badge FROM fx_modules""")
def _(t):
    return db.module_bands(t.fx_modules).select("repo_id", "id", "coverage_band", "risk_badge")


@query("filtered_modules", """
SELECT repo_id, id, module, risk FROM fx_modules WHERE risk >= CAST(0.5 AS DOUBLE) AND module = 'm3'""")
def _(t):
    return db.filter_modules(t.fx_modules, 0.5, "m3").select("repo_id", "id", "module", "risk")


@query("trend_in_date_range", """
SELECT id, repo_id, metric_name, recorded_at FROM fx_metrics_history
WHERE recorded_at >= TIMESTAMP '2024-01-05 00:00:00' AND recorded_at < TIMESTAMP '2024-01-12 00:00:00' AND metric_value >= CAST(0.5 AS DOUBLE)""")
def _(t):
    history = t.fx_metrics_history.withColumnRenamed("metric_value", "risk")
    return db.filter_modules(history, 0.5, date_from="2024-01-05", date_to="2024-01-11").select(
        "id", "repo_id", "metric_name", "recorded_at")


@query("attention_list", """
SELECT repo_id, id, risk, coverage FROM fx_modules WHERE risk >= CAST(0.7 AS DOUBLE) AND coverage < 70""")
def _(t):
    return db.attention_list(t.fx_modules).select("repo_id", "id", "risk", "coverage")


@query("risk_distribution", """
SELECT repo_id, CASE WHEN probability <= CAST(0.3 AS DOUBLE) THEN 'low' WHEN probability <= CAST(0.7 AS DOUBLE) THEN 'medium' ELSE 'high' END AS bucket,
       count(*) AS files, round(avg(probability), 6) AS mean_risk FROM fx_predictions GROUP BY 1, 2""")
def _(t):
    preds = t.fx_predictions.withColumnRenamed("probability", "risk_score")
    return db.risk_distribution(preds).withColumn("mean_risk", F.round("mean_risk", 6))


@query("model_radar", """
WITH newest AS (SELECT *, row_number() OVER (ORDER BY created_day DESC, model_id) AS place FROM fx_models QUALIFY place <= 5),
vals AS (
  SELECT model_type, place, 'accuracy' AS metric, coalesce(accuracy, 0) * 100 AS v FROM newest UNION ALL
  SELECT model_type, place, 'f1_score', coalesce(f1_score, 0) * 100 FROM newest UNION ALL
  SELECT model_type, place, 'roc_auc', coalesce(roc_auc, 0) * 100 FROM newest UNION ALL
  SELECT model_type, place, 'pr_auc', coalesce(pr_auc, 0) * 100 FROM newest UNION ALL
  SELECT model_type, place, 'popt_20', coalesce(popt_20, CAST(0.65 AS DOUBLE)) * 100 FROM newest UNION ALL
  SELECT model_type, place, 'recall_top_20', coalesce(recall_top_20, CAST(0.72 AS DOUBLE)) * 100 FROM newest)
SELECT metric, round(max_by(v, place) FILTER (WHERE model_type = 'gbt'), 6) AS gbt, round(max_by(v, place) FILTER (WHERE model_type = 'rf'), 6) AS rf,
       round(max_by(v, place) FILTER (WHERE model_type = 'logreg'), 6) AS logreg FROM vals GROUP BY metric""")
def _(t):
    types = ["gbt", "rf", "logreg"]
    out = db.model_radar(t.fx_models.withColumnRenamed("created_day", "created_at"), types=types)
    return out.select("metric", *[F.round(c, 6).alias(c) for c in types])


@query("trend_delta", """
WITH ordered AS (SELECT *, row_number() OVER (PARTITION BY repo_id, metric_name ORDER BY recorded_at DESC, id DESC) AS rn FROM fx_metrics_history),
two AS (SELECT repo_id, metric_name, max(metric_value) FILTER (WHERE rn = 1) AS latest, max(metric_value) FILTER (WHERE rn = 2) AS previous
        FROM ordered WHERE rn <= 2 GROUP BY 1, 2)
SELECT repo_id, metric_name, latest, round(latest - CASE WHEN coalesce(previous, 0) = 0 THEN latest ELSE previous END, 6) AS change FROM two""")
def _(t):
    return db.trend_delta(t.fx_metrics_history).withColumn("change", F.round("change", 6))


# --- listings ------------------------------------------------------------------------------

@query("best_model", """
SELECT model_id, model_type, roc_auc FROM fx_models WHERE is_active ORDER BY roc_auc DESC NULLS LAST, model_id LIMIT 1""")
def _(t):
    return db.best_model(t.fx_models).select("model_id", "model_type", "roc_auc")


@query("best_model_with_f1", """
SELECT model_id, model_type, roc_auc, f1_score, round(accuracy * 100, 2) AS accuracy_percent
FROM fx_models WHERE is_active ORDER BY roc_auc DESC NULLS LAST, f1_score DESC NULLS LAST, model_id LIMIT 1""")
def _(t):
    return db.best_model(t.fx_models, tie_f1=True).select("model_id", "model_type", "roc_auc", "f1_score", "accuracy_percent")


@query("best_model_per_repo", """
SELECT repo_id, model_id, roc_auc FROM fx_models WHERE is_active
QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY roc_auc DESC NULLS LAST, f1_score DESC NULLS LAST, model_id) = 1""")
def _(t):
    return db.best_model_per_repo(t.fx_models).select("repo_id", "model_id", "roc_auc")


@query("models_newest_first", """
SELECT model_id, model_type, created_day AS created_at, accuracy, f1_score, roc_auc FROM fx_models ORDER BY created_day DESC, model_id""")
def _(t):
    listed = db.list_models(t.fx_models.withColumnRenamed("created_day", "created_at"))
    return listed.select("model_id", "model_type", "created_at", "metrics.accuracy", "metrics.f1_score", "metrics.roc_auc")


@query("model_metrics", "SELECT accuracy, f1_score AS f1, roc_auc, pr_auc, popt_20, recall_top_20 FROM fx_models WHERE model_id = 'model_3'")
def _(t):
    return db.model_metrics(t.fx_models, "model_3")


@query("active_models", "SELECT model_id, repo_id FROM fx_models WHERE is_active")
def _(t):
    return db.active(t.fx_models).select("model_id", "repo_id")


@query("metrics_by_complexity", """
SELECT id, repo_id, filepath, cyclomatic_complexity, wmc, cbo FROM fx_file_metrics ORDER BY cyclomatic_complexity DESC, id""")
def _(t):
    return mt.metrics_by_complexity(t.fx_file_metrics).select("id", "repo_id", "filepath", "cyclomatic_complexity", "wmc", "cbo")


@query("active_policies", """
SELECT p_partkey AS id, p_name AS name, CAST(p_size AS DOUBLE) / 4 AS risk, CAST(p_size AS DOUBLE) / 8 AS coverage, p_partkey % 100 = 0 AS is_default
FROM part WHERE p_partkey % 3 <> 0 ORDER BY is_default DESC, name""")
def _(t):
    size = F.col("p_size").cast("double")
    table = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (size / 4).alias("risk_weight"),
        F.lit(0.5).alias("criticite_weight"), F.lit(0.0).alias("effort_weight"), (size / 8).alias("coverage_weight"),
        F.lit(0.0).alias("recency_weight"), F.lit(1000).alias("default_budget"), F.lit(None).cast("int").alias("max_items"),
        (F.col("p_partkey") % 100 == 0).alias("is_default"), (F.col("p_partkey") % 3 != 0).alias("is_active"))
    return db.policies(table).select("id", "name", "weights.risk", "weights.coverage", "is_default")


@query("latest_runs", """
WITH runs AS (SELECT p_partkey % 25 AS repo_id, p_partkey % 12 AS k, count(*) AS items_total FROM part GROUP BY 1, 2)
SELECT repo_id, budget, items_total FROM (SELECT *, CAST(k AS DOUBLE) AS budget FROM runs) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY k DESC) <= 10""")
def _(t):
    """Twelve plans recorded one after the other, in pages of three items."""
    path = scratch_path(t.spark, "runs")
    for k in range(12):
        items = t.fx_test_items.where(F.col("pos") % 12 == k)
        ranked = items.withColumns({"rank": F.row_number().over(Window.partitionBy("repo_id").orderBy("pos")).cast("bigint"), "selected": F.lit(True),
                                    "priority_score": F.lit(0.0), "selection_reason": F.lit("")})
        registry.record_run(ranked, path, k, {"risk": 1.0}, plan_rows=3)
    return db.latest_runs(registry.read_runs(t.spark, path)).select("repo_id", "budget", "items_total")


@query("top_risky_files", """
SELECT id, repo_id, probability AS risk_score FROM fx_predictions ORDER BY probability DESC, id LIMIT 10""")
def _(t):
    preds = t.fx_predictions.withColumnRenamed("probability", "risk_score")
    return db.top_risky(preds).select("id", "repo_id", "risk_score")


@query("top_risky_files_per_repo", """
SELECT repo_id, id, probability AS risk_score, row_number() OVER (PARTITION BY repo_id ORDER BY probability DESC, id) AS place
FROM fx_predictions QUALIFY place <= 10""")
def _(t):
    preds = t.fx_predictions.withColumnRenamed("probability", "risk_score")
    return db.top_risky_per_repo(preds).select("repo_id", "id", "risk_score", "place")


@query("repos_newest_first", "SELECT id, name, created_day AS created_at FROM fx_repos ORDER BY created_day DESC, id")
def _(t):
    return db.list_repos(t.fx_repos.withColumnRenamed("created_day", "created_at")).select("id", "name", "created_at")


@query("repo_by_id", "SELECT id, name, url FROM fx_repos WHERE id = 7")
def _(t):
    return db.get_repo(t.fx_repos, 7).select("id", "name", "url")


@query("chart_projection", """
SELECT id, repo_id, substr(split_part(filepath, '/', -1), 1, 15) AS name, wmc, cbo, rfc, least(lcom, 100) AS lcom,
       cyclomatic_complexity AS complexity, loc, code_smells_count + 1 AS smells FROM fx_file_metrics""")
def _(t):
    return mt.chart_projection(t.fx_file_metrics)


@query("metric_violations", """
SELECT repo_id, id, coalesce(cyclomatic_complexity > 20, false) AS cc_flag, coalesce(cbo > 10, false) AS cbo_flag,
       coalesce(cyclomatic_complexity > 30, false) OR coalesce(cbo > 10, false) AS hotspot,
       concat_ws(',', CASE WHEN wmc >= 20 THEN 'wmc' END, CASE WHEN dit >= 5 THEN 'dit' END,
                 CASE WHEN cbo >= 10 THEN 'cbo' END, CASE WHEN rfc >= 50 THEN 'rfc' END) AS violated
FROM fx_file_metrics""")
def _(t):
    return mt.metric_violations(t.fx_file_metrics).withColumn("violated", F.concat_ws(",", "violated"))


@query("smells_from_metrics", """
SELECT repo_id, filepath, 'high_complexity' AS smell_type, 'medium' AS severity FROM fx_file_metrics WHERE max_cyclomatic_complexity > 10
UNION ALL SELECT repo_id, filepath, 'large_file', 'low' FROM fx_file_metrics WHERE loc > 300
UNION ALL SELECT repo_id, filepath, 'high_coupling', 'medium' FROM fx_file_metrics WHERE cbo > 10""")
def _(t):
    return mt.smells_from_metrics(t.fx_file_metrics).drop("message")
