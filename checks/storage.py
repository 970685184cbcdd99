"""Sources and sinks: merges, registration, deletes, reports, datasets, registry, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ranking import BUDGET, COMPARED, CONSTRAINED, LABELED, plan
from checks.registry import query
from checks.relational import changes
from defectscope.operators import changes as ch
from defectscope.operators import evaluate as ev
from defectscope.operators import features as ft
from defectscope.operators import selection as sel
from defectscope.schemas import METRIC_COLUMNS
from defectscope.session import scratch_path
from defectscope.sources import datasets as ds
from defectscope.sources import export, landing, registry, upserts

OLD = "committed_at < TIMESTAMP '1997-01-01 00:00:00'"
OVERLAP = "committed_at >= TIMESTAMP '1996-01-01 00:00:00'"


@query("insert_if_absent", f"""
WITH old AS (SELECT repo_id, sha, id, 'stored' AS origin FROM fx_commits WHERE {OLD}),
inc AS (SELECT repo_id, sha, id, 'landed' AS origin FROM fx_commits WHERE {OVERLAP})
SELECT * FROM old UNION ALL SELECT * FROM inc i WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.repo_id = i.repo_id AND o.sha = i.sha)""")
def _(t):
    rows = t.fx_commits
    old = rows.where(OLD).select("repo_id", "sha", "id", F.lit("stored").alias("origin"))
    landed = rows.where(OVERLAP).select("repo_id", "sha", "id", F.lit("landed").alias("origin"))
    return upserts.insert_ignore(old, landed.unionByName(landed), ["repo_id", "sha"])


@query("landed_commits", """
SELECT repo_id, sha, message, author_name, concat(author_name, '@example.com') AS author_email,
       lower(message) SIMILAR TO '.*(fix|bug|issue|error|patch).*' AS is_bugfix, committed_at FROM fx_commits""")
def _(t):
    path = scratch_path(t.spark, "landed")
    write_landing(t.fx_commits, path)
    return landing.read_commits(t.spark, path)


def write_landing(commits, path: str) -> None:
    """Commits as the nested JSON records a collector lands."""
    commits.select("repo_id", "sha", F.struct(
        "message", F.struct(F.col("author_name").alias("name"),
                            F.concat("author_name", F.lit("@example.com")).alias("email"),
                            F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")).alias("author"),
    ).alias("commit")).write.json(path)


# One commit in ten is landed with each kind of fault, by its id.
KIND = "CASE id % 10 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'no repository' WHEN 2 THEN 'no sha' WHEN 3 THEN 'no commit' WHEN 4 THEN 'unreadable' ELSE 'accepted' END"


@query("quarantined_commits", f"""
SELECT {KIND} AS outcome, count(*) AS n, min(CASE WHEN id % 10 > 4 THEN sha END) AS first_sha, CAST(count(*) FILTER (WHERE id % 10 > 4 AND lower(message) SIMILAR TO '.*(fix|bug|issue|error|patch).*') AS BIGINT) AS bugfixes
FROM fx_commits GROUP BY 1""")
def _(t):
    """Landed lines of which some are cut short, have a text for a number, or lack a field: rejected by reason, the others read."""
    path = scratch_path(t.spark, "landed")
    broken = F.col("id") % 10
    author = F.struct(F.col("author_name").alias("name"), F.lit("e").alias("email"), F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    line = F.to_json(F.struct(
        F.when(broken != 1, F.col("repo_id")).alias("repo_id"), F.when(broken != 2, F.col("sha")).alias("sha"),
        F.when(broken != 3, F.struct("message", author.alias("author"))).alias("commit")))
    line = F.when(broken == 0, F.substring(line, 1, 40)).when(broken == 4, F.regexp_replace(line, '"repo_id":', '"repo_id":"x')).otherwise(line)
    line = F.when(broken == 4, F.regexp_replace(line, '("repo_id":"x[0-9]+)', '$1"')).otherwise(line)
    t.fx_commits.select(line.alias("value")).write.text(path)
    commits, rejects = landing.read_commits_checked(t.spark, path)
    accepted = commits.agg(F.lit("accepted").alias("outcome"), F.count(F.lit(1)).alias("n"), F.min("sha").alias("first_sha"), F.count_if("is_bugfix").alias("bugfixes"))
    counts = landing.reject_counts(rejects).groupBy(F.col("reason").alias("outcome")).agg(F.sum("n").alias("n"))
    return accepted.unionByName(counts.withColumns({"first_sha": F.lit(None).cast("string"), "bugfixes": F.lit(0).cast("bigint")}))


@query("metric_upsert", """
WITH old AS (SELECT repo_id, filepath, commit_sha, cyclomatic_complexity AS cc, wmc, cbo, code_smells_count AS smells, rfc, loc FROM fx_file_metrics
             WHERE created_at < TIMESTAMP '1995-01-01 00:00:00'),
inc AS (SELECT repo_id, filepath, commit_sha, cyclomatic_complexity + 100 AS cc, wmc + 1 AS wmc, cbo + 2 AS cbo, code_smells_count + 3 AS smells, rfc + 4 AS rfc, loc + 5 AS loc
        FROM fx_file_metrics WHERE created_at >= TIMESTAMP '1994-01-01 00:00:00')
SELECT coalesce(o.repo_id, i.repo_id) AS repo_id, coalesce(o.filepath, i.filepath) AS filepath, coalesce(o.commit_sha, i.commit_sha) AS commit_sha,
       CASE WHEN i.repo_id IS NULL THEN o.cc ELSE i.cc END AS cyclomatic_complexity, CASE WHEN i.repo_id IS NULL THEN o.wmc ELSE i.wmc END AS wmc,
       CASE WHEN i.repo_id IS NULL THEN o.cbo ELSE i.cbo END AS cbo, CASE WHEN i.repo_id IS NULL THEN o.smells ELSE i.smells END AS code_smells_count,
       CASE WHEN o.repo_id IS NULL THEN i.rfc ELSE o.rfc END AS rfc, CASE WHEN o.repo_id IS NULL THEN i.loc ELSE o.loc END AS loc
FROM old o FULL JOIN inc i ON o.repo_id = i.repo_id AND o.filepath = i.filepath AND o.commit_sha = i.commit_sha""")
def _(t):
    columns = ["repo_id", "filepath", "commit_sha", "cyclomatic_complexity", "wmc", "cbo", "code_smells_count", "rfc", "loc"]
    rows = t.fx_file_metrics
    old = rows.where("created_at < TIMESTAMP '1995-01-01 00:00:00'").select(*columns)
    landed = rows.where("created_at >= TIMESTAMP '1994-01-01 00:00:00'").select(
        "repo_id", "filepath", F.lit(None).cast("string").alias("commit_sha"),
        (F.col("cyclomatic_complexity") + 100).alias("cyclomatic_complexity"), (F.col("wmc") + 1).alias("wmc"),
        (F.col("cbo") + 2).alias("cbo"), (F.col("code_smells_count") + 3).alias("code_smells_count"),
        (F.col("rfc") + 4).alias("rfc"), (F.col("loc") + 5).alias("loc"), F.col("id").alias("seq"))
    return upserts.upsert_file_metrics(old, landed)


@query("registered_repos", """
SELECT id, name, url FROM fx_repos UNION ALL
SELECT c_custkey + 1000, c_name, concat('https://git.example.com/org/', lower(c_name)) FROM customer UNION ALL
SELECT id + 5000, name, regexp_replace(regexp_replace(url, '\\.git$', ''), '/$', '') FROM fx_repos WHERE url LIKE '%/'""")
def _(t):
    clean = t.customer.select(
        (F.col("c_custkey") + 1000).alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit(" https://git.example.com/org/"), F.lower("c_name"), F.lit(".git")).alias("url"),
        F.lit(1).alias("pos"))
    again = clean.withColumns({"url": F.concat(F.trim("url"), F.lit("/")), "pos": F.lit(2)}).withColumn(
        "url", F.regexp_replace("url", r"\.git/$", "/"))
    known = t.fx_repos.select((F.col("id") + 5000).alias("id"), "name", "url", F.lit(3).alias("pos"))
    landed = clean.unionByName(again).unionByName(known)
    return landing.register_repos(t.fx_repos.select("id", "name", "url"), landed)


PURGED = "SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'"


@query("purged_commits", f"SELECT id, repo_id FROM fx_commits WHERE repo_id NOT IN ({PURGED})")
def _(t):
    return _purged(t)["commits"].select("id", "repo_id")


@query("purged_models", f"""
SELECT model_id, CASE WHEN repo_id IN ({PURGED}) THEN NULL ELSE repo_id END AS repo_id FROM fx_models""")
def _(t):
    return _purged(t)["models"].select("model_id", "repo_id")


def _purged(t):
    gone = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'")
            .select(F.col("n_nationkey").cast("bigint").alias("id")))
    return upserts.purge_repos({"repositories": t.fx_repos, "commits": t.fx_commits, "models": t.fx_models}, gone)


@query("collection_report", f"""
SELECT repo_id, count(*) AS commits_collected, count(*) FILTER (WHERE NOT {OLD}) AS commits_stored FROM fx_commits GROUP BY repo_id""")
def _(t):
    rows = t.fx_commits
    landed = rows
    new = upserts.new_rows(rows.where(OLD), landed, ["repo_id", "sha"])
    repos = t.fx_repos.withColumn("last_collected_at", F.lit(None).cast("timestamp"))
    return upserts.collection_report(repos, landed, new, F.current_timestamp())[1]


SPLIT = f"""{LABELED}, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY repo_id ORDER BY created_at NULLS LAST, id)
         <= floor(count(*) OVER (PARTITION BY repo_id) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM labeled)"""


@query("dataset_catalog", f"""
WITH {SPLIT} SELECT CAST(1 AS BIGINT) AS id, repo_id, count(*) FILTER (WHERE split = 'train') AS train_samples,
  count(*) FILTER (WHERE split = 'test') AS test_samples, 20 AS n_features, 'none' AS balancing_strategy, true AS temporal_split FROM s GROUP BY repo_id""")
def _(t):
    saved, catalog = _saved_dataset(t)
    listed = ds.list_datasets(t.spark.read.parquet(catalog))
    return listed.select("id", "repo_id", "train_samples", "test_samples", F.size("feature_names").alias("n_features"),
                         "balancing_strategy", "temporal_split")


@query("dataset_round_trip", f"WITH {SPLIT} SELECT repo_id, id, is_buggy, wmc, loc, split FROM s")
def _(t):
    saved, _ = _saved_dataset(t)
    train, test = (ds.read_split(t.spark, saved, 1, s) for s in ("train", "test"))
    return train.unionByName(test).select(F.col("repo_id").cast("bigint").alias("repo_id"), "id", "is_buggy", "wmc", "loc", "split")


@query("dataset_csv_round_trip", f"WITH {SPLIT} SELECT id AS file_id, filepath, split, is_buggy, wmc, cbo, CAST(loc AS DOUBLE) AS loc FROM s")
def _(t):
    rows = ft.temporal_split(ch.with_bug_labels(t.fx_file_metrics, changes(t)))
    path = scratch_path(t.spark, "csv")
    ds.save_csv(rows.select(F.col("id").alias("file_id"), "filepath", "wmc", "cbo", "loc", "is_buggy", "split"), path, 1)
    train, test = ds.load_dataset(t.spark, path, 1)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def _saved_dataset(t):
    labeled = ch.with_bug_labels(t.fx_file_metrics, changes(t))
    split = ft.temporal_split(labeled)
    saved, catalog = scratch_path(t.spark, "dataset"), scratch_path(t.spark, "catalog")
    ds.save_dataset(split, saved, catalog, 1, strategy="none", temporal=True)
    return saved, catalog


@query("registered_models", """
SELECT model_id, tn, fp, fn, tp, true AS is_active FROM (
  SELECT model_id, CAST(count(*) FILTER (WHERE label = 0 AND probability < 0.5e0) AS BIGINT) AS tn,
         CAST(count(*) FILTER (WHERE label = 0 AND probability >= 0.5e0) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE label = 1 AND probability < 0.5e0) AS BIGINT) AS fn,
         CAST(count(*) FILTER (WHERE label = 1 AND probability >= 0.5e0) AS BIGINT) AS tp FROM fx_predictions GROUP BY model_id) c""")
def _(t):
    table = ev.score_table(t.fx_predictions)
    counted = ev.classification_metrics(ev.confusion(table, 0.5)).withColumn("threshold", F.lit(0.5))
    metrics = (counted.join(ev.roc_auc(table), "model_id").join(ev.average_precision(table), "model_id")
               .join(ev.top_share(t.fx_predictions, table), "model_id"))
    path = scratch_path(t.spark, "registry")
    registry.register_model(metrics, path, model_type="rf", model_family="auto", hyperparameters={"n_estimators": 100.0}, model_path="none")
    back = registry.decode_json(t.spark.read.parquet(path))
    return back.select("model_id", "confusion_matrix.*", "is_active")


@query("recorded_runs", f"""
WITH {CONSTRAINED} SELECT repo_id, id, selected, CAST(effort AS DOUBLE) AS effort, count(*) OVER (PARTITION BY repo_id) AS items_total,
  CAST(coalesce(sum(effort) FILTER (WHERE selected) OVER (PARTITION BY repo_id), 0) AS DOUBLE) AS effort_selected FROM plan""")
def _(t):
    path = scratch_path(t.spark, "runs")
    runs, pages = registry.record_run(sel.with_reason(plan(t), BUDGET), path, BUDGET, {"risk": 1.0, "crit": 0.5, "coverage": 0.2})
    back = registry.decode_json(pages).join(runs.select("id", "items_total", "effort_selected"), F.col("run_id") == F.col("id"))
    return back.select("repo_id", "items_total", "effort_selected", F.inline("plan")).select(
        "repo_id", "id", "selected", "effort", "items_total", "effort_selected")


@query("exported_plan", f"""
WITH {CONSTRAINED} SELECT concat('R', CAST(repo_id AS STRING)) AS "Repository", id AS "Test, id", module AS "Module",
  CASE WHEN selected THEN 'Yes' ELSE 'No' END AS "Selected", regexp_replace(CAST(CAST(effort AS DOUBLE) AS VARCHAR), '\\.0$', '') AS "Effort" FROM plan""")
def _(t):
    path = scratch_path(t.spark, "export")
    rows = plan(t).withColumn("repo", F.concat(F.lit("R"), F.col("repo_id"))).orderBy("repo_id", "pos")
    labels = {"repo": "Repository", "id": "Test, id", "module": "Module", "selected": "Selected", "effort": "Effort"}
    export.export_plan_csv(rows, labels, path)
    return t.spark.read.option("header", True).option("escape", '"').csv(path)
