"""Adapter views: the given tables read as the domain tables.

Each text runs unchanged in Spark SQL and DuckDB; `{name}` stands for a given table or
another view. One text feeds the Spark queries and, as CTEs, the SQL they are checked with.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_PATH = """concat('src/m', CAST(l_partkey % 10 AS STRING), '/C', CAST(l_partkey AS STRING), '_', CAST(l_linenumber AS STRING),
              CASE l_linenumber WHEN 1 THEN '.java' WHEN 2 THEN '.py' WHEN 3 THEN '.js' WHEN 4 THEN '.ts'
                                WHEN 5 THEN '.go' WHEN 6 THEN '.cpp' ELSE '.txt' END)"""

# Where file number `n` of the linked sources lies.
def _linked_path(n: str) -> str:
    return f"""CASE WHEN {n} % 5 < 2 THEN concat('src/p', CAST({n} % 7 AS STRING), '/m', CAST({n} AS STRING), '.py')
              WHEN {n} % 5 = 2 THEN concat('src/p', CAST({n} % 7 AS STRING), '/k', CAST({n} AS STRING), '/u', CAST({n} % 3 AS STRING), '.py')
              ELSE concat('java/org/q', CAST({n} % 4 AS STRING), '/C', CAST({n} AS STRING), '.java') END"""


VIEWS = {
    "fx_repos": """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
       concat('https://git.example.com/org/', lower(n_name),
              CASE WHEN n_nationkey % 3 = 0 THEN '.git' WHEN n_nationkey % 3 = 1 THEN '/' ELSE '' END) AS url,
       'github' AS provider, CAST(n_nationkey % 4 AS BIGINT) AS created_day
FROM {nation}""",
    "fx_commits": """
SELECT o_orderkey AS id, o_custkey % 25 AS repo_id, md5(CAST(o_orderkey AS STRING)) AS sha,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN concat('Fix crash ', CAST(o_orderkey AS STRING))
            WHEN o_orderpriority = '5-LOW' AND o_orderkey % 97 = 0 THEN 'Update PREFIX table'
            ELSE concat('Feature update ', CAST(o_orderkey AS STRING)) END AS message,
       concat('dev', CAST(o_custkey % 40 AS STRING)) AS author_name, o_orderdate AS committed_at
FROM {orders}""",
    "fx_files": f"""
SELECT l_orderkey AS commit_id, l_partkey % 25 AS repo_id, {_PATH} AS filepath,
       CASE l_linenumber WHEN 1 THEN '.java' WHEN 2 THEN '.py' WHEN 3 THEN '.js' WHEN 4 THEN '.ts'
                         WHEN 5 THEN '.go' WHEN 6 THEN '.cpp' ELSE '.txt' END AS extension,
       CAST(l_quantity AS INT) AS lines_added
FROM {{lineitem}}""",
    "fx_file_metrics": f"""
SELECT l_partkey * 10 + l_linenumber AS id, l_partkey % 25 AS repo_id, 'HEAD' AS commit_sha, {_PATH} AS filepath,
       CAST((p_size * l_linenumber) % 60 AS DOUBLE) AS cyclomatic_complexity,
       CAST((p_size + l_linenumber) % 25 AS DOUBLE) AS max_cyclomatic_complexity,
       CAST(p_size AS DOUBLE) / 4 AS avg_cyclomatic_complexity,
       CAST(p_size AS DOUBLE) AS wmc, CAST(l_partkey % 6 AS DOUBLE) AS dit, CAST(l_partkey % 4 AS DOUBLE) AS noc,
       CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST((l_partkey * 7) % 16 AS DOUBLE) END AS cbo,
       CAST((l_partkey * 3) % 70 AS DOUBLE) AS rfc, CAST((l_partkey * 13) % 140 AS DOUBLE) AS lcom,
       CAST(l_partkey % 15 AS INT) AS fan_in, CAST((l_partkey * 11) % 20 AS INT) AS fan_out,
       CAST((l_partkey * 31) % 700 + 10 AS INT) AS loc, CAST((l_partkey * 29) % 500 + 5 AS INT) AS sloc,
       CAST(l_partkey % 29 + 1 AS INT) AS num_methods, CAST(l_partkey % 4 + 1 AS INT) AS num_classes,
       CAST((l_partkey + l_linenumber) % 4 AS INT) AS code_smells_count, first_ship AS created_at
FROM (SELECT l_partkey, l_linenumber, min(l_shipdate) AS first_ship FROM {{lineitem}} GROUP BY l_partkey, l_linenumber) k
JOIN {{part}} ON p_partkey = l_partkey""",
    "fx_issues": """
SELECT event_id AS id, user_id % 25 AS repo_id, event_type AS kind, event_type = 'error' AS is_bug, ts AS created_at
FROM {events}""",
    "fx_predictions": """
SELECT l_partkey * 10 + l_linenumber AS id, concat('model_', CAST(l_partkey % 5 AS STRING)) AS model_id,
       l_partkey % 25 AS repo_id, label,
       CAST((l_partkey * 7919 + l_linenumber * 104729) % 700 + 300 * label AS DOUBLE) / 1000 AS probability
FROM (SELECT l_partkey, l_linenumber,
             max(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS label
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_partkey, l_linenumber) p""",
    "fx_test_items": """
SELECT p_partkey % 25 AS repo_id, p_partkey AS pos, concat('T', CAST(p_partkey AS STRING)) AS id,
       concat('m', CAST(p_partkey % 10 AS STRING)) AS module,
       CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 1000 AS risk, CAST(p_size * 10 AS DOUBLE) + CAST(p_partkey % 10 AS DOUBLE) / 10 AS effort,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey % 11 + 5 AS DOUBLE) / 10 END AS criticite,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS DOUBLE) / 10 END AS coverage_gap,
       p_partkey % 41 = 0 AS mandatory, p_partkey % 19 = 0 AS excluded
FROM {part}""",
    "fx_modules": """
SELECT p_partkey % 25 AS repo_id, p_partkey AS id, concat('m', CAST(p_partkey % 10 AS STRING)) AS module,
       CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 1000 AS risk, CAST((p_partkey * 17) % 101 AS DOUBLE) AS coverage,
       p_partkey % 7 AS defects
FROM {part}""",
    "fx_models": """
SELECT concat('model_', CAST(s_suppkey AS STRING)) AS model_id, CAST(s_nationkey AS BIGINT) AS repo_id,
       CASE s_suppkey % 3 WHEN 0 THEN 'gbt' WHEN 1 THEN 'rf' ELSE 'logreg' END AS model_type,
       CAST((s_suppkey * 37) % 100 AS DOUBLE) / 100 AS accuracy, CAST((s_suppkey * 53) % 100 AS DOUBLE) / 100 AS f1_score,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST((s_suppkey * 71) % 100 AS DOUBLE) / 100 END AS roc_auc,
       CAST((s_suppkey * 29) % 100 AS DOUBLE) / 100 AS pr_auc,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST((s_suppkey * 11) % 100 AS DOUBLE) / 100 END AS popt_20,
       CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE CAST((s_suppkey * 13) % 100 AS DOUBLE) / 100 END AS recall_top_20,
       s_suppkey % 5 <> 0 AS is_active, s_suppkey % 37 AS created_day
FROM {supplier}""",
    "fx_metrics_history": """
SELECT event_id AS id, user_id % 25 AS repo_id, event_type AS metric_name, value AS metric_value, ts AS recorded_at
FROM {events}""",
    "fx_sources": """
SELECT doc_id AS file_id, doc_id % 25 AS repo_id,
       concat('src/d', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '.js' END) AS filepath,
       CASE doc_id % 3
         WHEN 0 THEN concat('import os', chr(10), 'from m import f', chr(10), chr(10), '# note', chr(10),
                            CASE WHEN doc_id % 4 = 0 THEN 'def g(self, a, b, c, d, e, f):' ELSE 'def g(self, a, b):' END,
                            chr(10), text)
         WHEN 1 THEN concat('import java.util.List;', chr(10), 'public class C', CAST(doc_id AS STRING), ' {{', chr(10),
                            repeat(concat('  public int f(int x) {{ return x; }}', chr(10)), CAST(doc_id % 30 AS INT)),
                            '// end', chr(10), '}}', chr(10),
                            CASE WHEN doc_id % 7 = 0 THEN concat('{{', repeat(chr(10), 52), '}}', chr(10)) ELSE '' END, text)
         ELSE concat(text, repeat(chr(10), CAST(doc_id % 600 AS INT))) END AS content
FROM {documents}""",
    # Files of forty a repository that import one another: by whole name, as members, from their own folder, by a name that several have.
    "fx_linked_sources": f"""
SELECT file_id, repo_id, n1, n2, n3, {_linked_path('file_id')} AS filepath,
       CASE WHEN file_id % 5 < 3
            THEN concat('import os, p', CAST(n1 % 7 AS STRING), '.m', CAST(n1 AS STRING), ' as x', chr(10),
                        'from p', CAST(n2 % 7 AS STRING), ' import m', CAST(n2 AS STRING), ', gone', chr(10),
                        'from .m', CAST(n3 AS STRING), ' import f', chr(10), 'import u', CAST(n1 % 3 AS STRING), chr(10), '# note', chr(10), text)
            ELSE concat('import org.q', CAST(n1 % 4 AS STRING), '.C', CAST(n1 AS STRING), ';', chr(10), 'import java.util.List;', chr(10),
                        'public class C', CAST(file_id AS STRING), ' {{{{}}}}', chr(10), text) END AS content
FROM (SELECT doc_id AS file_id, r AS repo_id, r * 40 + (doc_id * 7 + 3) % 40 AS n1, r * 40 + (doc_id * 11 + 5) % 40 AS n2, r * 40 + (doc_id * 3 + 1) % 40 AS n3, text
      FROM (SELECT doc_id, text, CAST(floor(doc_id / 40) AS BIGINT) AS r FROM {{documents}}) d) d""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or an adapter view over the given tables."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in _placeholders(text)})


def with_views(sql: str) -> str:
    """The SQL text with a CTE for every adapter view it names."""
    needed = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = [f"{v} AS ({VIEWS[v].format(**{n: n for n in _placeholders(VIEWS[v])})})" for v in needed]
    if not ctes:
        return sql
    body = sql.strip()
    if re.match(r"(?i)with\b", body):
        body = re.sub(r"(?i)^with\s+(recursive\s+)?", "", body)
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def _placeholders(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))
