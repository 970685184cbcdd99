"""Metrics and smells of source text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.relational import CHANGES, commits
from defectscope.functions import text as tx
from defectscope.operators import changes as ch
from defectscope.operators import metrics as mt
from defectscope.operators import modules as md
from defectscope.plans import dataset as dp
from defectscope.session import written
from defectscope.sources import upserts

LANGUAGE = "CASE file_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'javascript' END"


def found(pattern: str) -> str:
    return f"len(regexp_extract_all(content, '{pattern}'))"


def lines_like(pattern: str) -> str:
    return f"len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '{pattern}')))"


BLANK = rf"^{tx.S}*$"
PYTHON_COMMENT = rf"^{tx.S}*#"
JAVA_COMMENT = rf"^{tx.S}*(?://|/\*|\*)"
LOC = "len(string_split(content, chr(10)))"
BRANCHES = """(len(list_filter(regexp_split_to_array(content, '[^\\p{L}\\p{N}_]+'),
    lambda w: w IN ('if', 'elif', 'for', 'while', 'except', 'case', 'catch', 'and', 'or')))
  + len(regexp_extract_all(content, '&&|\\|\\|')) + 1)"""

COUNTED = f"""
counted AS (SELECT repo_id, file_id, filepath, content, {LANGUAGE} AS language, {LOC} AS loc, {lines_like(BLANK)} AS blank_lines,
  CASE file_id % 3 WHEN 0 THEN {lines_like(PYTHON_COMMENT)} WHEN 1 THEN {lines_like(JAVA_COMMENT)} ELSE 0 END AS comments,
  CASE file_id % 3 WHEN 0 THEN {found(tx.PYTHON_IMPORT)} WHEN 1 THEN {found(tx.JAVA_IMPORT)} ELSE 0 END AS fan_out,
  CASE file_id % 3 WHEN 1 THEN {found(tx.JAVA_CLASS)} ELSE 0 END AS num_classes,
  CASE file_id % 3 WHEN 1 THEN {found(tx.JAVA_METHOD)} ELSE 0 END AS num_methods
  FROM fx_sources)"""

DEFS = f"""
heads AS (SELECT repo_id, file_id, filepath, regexp_extract_all(content, '{tx.PYTHON_DEF}', 0) AS h, regexp_extract_all(content, '{tx.PYTHON_DEF}', 1) AS a,
                 regexp_split_to_array(content, '{tx.PYTHON_DEF}') AS p FROM fx_sources WHERE file_id % 3 = 0),
each AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM heads),
defs AS (SELECT repo_id, file_id, filepath, len(list_filter(list_transform(string_split(a[i], ','), lambda x: regexp_replace(x, '^{tx.S}+|{tx.S}+$', '', 'g')),
                                   lambda x: x <> '' AND x <> 'self')) AS params,
                len(string_split(concat(array_to_string(p[1:i], ''), array_to_string(h[1:i - 1], '')), chr(10))) AS line FROM each)"""

SMELLS = f"""
{COUNTED}, {DEFS},
bodies AS (SELECT repo_id, file_id, filepath, unnest(regexp_extract_all(content, '\\{{[^{{}}]*\\}}')) AS body FROM fx_sources WHERE file_id % 3 = 1),
smells AS (
  SELECT repo_id, file_id, filepath, 'large_file' AS smell_type, 'medium' AS severity, 1 AS line_start, concat('File has ', loc, ' lines (threshold: 500)') AS message
  FROM counted WHERE loc > 500 AND language <> 'javascript'
  UNION ALL SELECT repo_id, file_id, filepath, 'too_many_parameters', 'low', CAST(line AS INT), concat('Function has ', params, ' parameters (threshold: 5)') FROM defs WHERE params > 5
  UNION ALL SELECT repo_id, file_id, filepath, 'god_class', 'high', 1, concat('Class has ', num_methods, ' methods (threshold: 20)') FROM counted WHERE num_methods > 20
  UNION ALL SELECT repo_id, file_id, filepath, 'long_method', 'medium', NULL, 'Method body has more than 50 lines' FROM bodies
  WHERE len(string_split(body, chr(10))) - 1 > 50)"""


@query("line_counts", f"""
WITH {COUNTED} SELECT repo_id, file_id, language, CAST(loc AS INT) AS loc, CAST(comments AS INT) AS comments, CAST(blank_lines AS INT) AS blank_lines,
  CAST(loc - comments - blank_lines AS INT) AS sloc FROM counted""")
def _(t):
    return mt.line_counts(t.fx_sources).drop("filepath")


@query("import_counts", f"WITH {COUNTED} SELECT file_id, CAST(fan_out AS INT) AS fan_out FROM counted")
def _(t):
    out = tx.fan_out(F.col("content"), F.col("language"))
    return mt.with_language(t.fx_sources).select("file_id", out.alias("fan_out"))


@query("java_declarations", f"""
WITH {COUNTED} SELECT file_id, CAST(num_classes AS INT) AS num_classes, CAST(num_methods AS INT) AS num_methods FROM counted WHERE language = 'java'""")
def _(t):
    java = mt.with_language(t.fx_sources).where("language = 'java'")
    return java.select("file_id", tx.java_classes(F.col("content")).alias("num_classes"),
                       tx.java_methods(F.col("content")).alias("num_methods"))


@query("decision_points", f"SELECT file_id, CAST({BRANCHES} AS INT) AS decision_points FROM fx_sources")
def _(t):
    return t.fx_sources.select("file_id", tx.decision_points(F.col("content")).alias("decision_points"))


@query("source_file_metrics", f"""
WITH {SMELLS} SELECT c.repo_id, c.file_id, language, CAST(loc AS INT) AS loc, CAST(loc - comments - blank_lines AS INT) AS sloc, CAST(fan_out AS INT) AS fan_out,
  CAST(CASE WHEN language = 'java' THEN fan_out ELSE 0 END AS INT) AS cbo, CAST(num_classes AS INT) AS num_classes, CAST(num_methods AS INT) AS num_methods,
  CAST({BRANCHES} AS INT) AS decision_points, CAST(coalesce(n, 0) AS INT) AS code_smells_count
FROM counted c LEFT JOIN (SELECT file_id, count(*) AS n FROM smells GROUP BY file_id) s ON s.file_id = c.file_id""")
def _(t):
    return mt.file_metrics(t.fx_sources).drop("filepath", "comments", "blank_lines", "code_smells")


@query("code_smells", f"WITH {SMELLS} SELECT repo_id, filepath, smell_type, severity, line_start, message FROM smells")
def _(t):
    return mt.explode_smells(mt.file_metrics(t.fx_sources))


@query("parameter_smells", f"WITH {DEFS} SELECT file_id, CAST(line AS INT) AS line_start, CAST(params AS BIGINT) AS params FROM defs WHERE params > 5")
def _(t):
    python = mt.with_language(t.fx_sources).where("language = 'python'")
    rows = python.select("file_id", F.inline_outer(tx.smells_too_many_parameters(F.col("content"))))
    return rows.where("smell_type IS NOT NULL").select("file_id", "line_start", F.regexp_extract("message", r"has (\d+)", 1).cast("bigint").alias("params"))


@query("smells_by_severity", f"""
WITH {SMELLS} SELECT concat(upper(severity[1]), severity[2:]) AS name, count(*) AS value,
  CAST(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS BIGINT) AS place FROM smells GROUP BY severity""")
def _(t):
    smells = mt.explode_smells(mt.file_metrics(t.fx_sources))
    return mt.smells_by_severity(smells).withColumn("place", F.col("place").cast("bigint"))


@query("smells_by_type", f"""
WITH {SMELLS} SELECT CASE smell_type WHEN 'large_file' THEN 'Large File' WHEN 'too_many_parameters' THEN 'Too Many Parameters'
  WHEN 'god_class' THEN 'God Class' ELSE 'Long Method' END AS type, count(*) AS count FROM smells GROUP BY smell_type""")
def _(t):
    return mt.smells_by_type(mt.explode_smells(mt.file_metrics(t.fx_sources)))


@query("smells_ordered", f"""
WITH {SMELLS} SELECT filepath, smell_type, line_start, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS severity_rank FROM smells""")
def _(t):
    smells = mt.explode_smells(mt.file_metrics(t.fx_sources))
    return mt.smells_ordered(smells).select("filepath", "smell_type", "line_start", "severity_rank")


@query("dependency_degrees", """
WITH edges AS (
  SELECT repo_id, filepath AS source, unnest(CASE file_id % 3 WHEN 0 THEN ['os', 'm'] ELSE ['java.util.List'] END) AS target FROM fx_sources WHERE file_id % 3 < 2),
ends AS (SELECT repo_id, source AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT repo_id, target, 0, 1 FROM edges)
SELECT repo_id, node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM ends GROUP BY repo_id, node""")
def _(t):
    return ch.dependency_degrees(mt.import_edges(t.fx_sources))


DEGREES = """
f AS (SELECT file_id, repo_id, filepath, n1, n2, n3, file_id % 5 AS kind FROM fx_linked_sources),
names AS (SELECT repo_id, file_id % 3 AS u, count(*) AS n, min(file_id) AS only_id FROM f WHERE kind = 2 GROUP BY 1, 2),
imports AS (
  SELECT f.repo_id, f.file_id, g.file_id AS target, CASE WHEN g.file_id IS NULL THEN 0 ELSE 1 END AS n FROM f LEFT JOIN f g ON g.file_id = f.n1 AND g.repo_id = f.repo_id AND g.kind < 2 WHERE f.kind < 3
  UNION ALL SELECT f.repo_id, f.file_id, g.file_id, CASE WHEN g.file_id IS NULL THEN 0 ELSE 1 END FROM f LEFT JOIN f g ON g.file_id = f.n2 AND g.repo_id = f.repo_id AND g.kind < 2 WHERE f.kind < 3
  UNION ALL SELECT repo_id, file_id, NULL, 0 FROM f WHERE kind < 3 UNION ALL SELECT repo_id, file_id, NULL, 0 FROM f
  UNION ALL SELECT f.repo_id, f.file_id, g.file_id, CASE WHEN g.file_id IS NULL THEN 0 ELSE 1 END
    FROM f LEFT JOIN f g ON g.file_id = f.n3 AND g.repo_id = f.repo_id AND g.kind < 2 AND f.kind < 2 AND g.file_id % 7 = f.file_id % 7 WHERE f.kind < 3
  UNION ALL SELECT f.repo_id, f.file_id, CASE WHEN n = 1 THEN only_id END, coalesce(n, 0) FROM f LEFT JOIN names ON names.repo_id = f.repo_id AND u = n1 % 3 WHERE kind < 3
  UNION ALL SELECT f.repo_id, f.file_id, g.file_id, CASE WHEN g.file_id IS NULL THEN 0 ELSE 1 END FROM f LEFT JOIN f g ON g.file_id = f.n1 AND g.repo_id = f.repo_id AND g.kind > 2 WHERE f.kind > 2),
edges AS (SELECT DISTINCT repo_id, file_id, target FROM imports WHERE target <> file_id),
degrees AS (SELECT f.repo_id, f.file_id, f.filepath, (SELECT count(*) FROM edges e WHERE e.file_id = f.file_id) AS fan_out, (SELECT count(*) FROM edges e WHERE e.target = f.file_id) AS fan_in,
  (SELECT count(*) FROM imports i WHERE i.file_id = f.file_id AND n = 0) AS unresolved, (SELECT count(*) FROM imports i WHERE i.file_id = f.file_id AND n > 1) AS ambiguous FROM f)"""


@query("file_dependency_degrees", f"WITH {DEGREES} SELECT repo_id, filepath, fan_out, fan_in, unresolved, ambiguous FROM degrees")
def _(t):
    return md.file_dependency_degrees(t.fx_linked_sources)


# Functions of the linked sources as a parser would report them, changes of these files, and metric rows stored earlier.
LINKED_FUNCTIONS = """
SELECT repo_id, filepath, concat('f', CAST(j AS STRING)) AS name, CASE j % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'M' ELSE 'F' END AS kind,
       CAST((file_id * j) % 25 + 1 AS INT) AS complexity, CAST(j AS INT) AS lineno"""
LINKED_FILES = "SELECT o_orderkey AS commit_id, repo_id, filepath FROM {files} JOIN {orders} ON file_id = o_custkey"
METRICS = ["wmc", "dit", "noc", "cbo", "rfc", "lcom", "cyclomatic_complexity", "max_cyclomatic_complexity", "avg_cyclomatic_complexity",
           "fan_in", "fan_out", "loc", "sloc", "num_methods", "num_classes", "code_smells_count"]
STORED = {c: -1.0 for c in METRICS}


@query("analyzed_files", f"""
WITH linked_files AS ({LINKED_FILES.format(files="fx_linked_sources", orders="orders")}),
{CHANGES.replace("fx_files", "linked_files")}, {DEGREES},
functions AS ({LINKED_FUNCTIONS} FROM (SELECT *, unnest(range(1, file_id % 6 + 1)) AS j FROM fx_linked_sources) x),
rolled AS (SELECT repo_id, filepath, sum(complexity) AS total, max(complexity) AS most, avg(complexity) AS mean, count(*) FILTER (WHERE kind <> 'C') AS methods, count(*) FILTER (WHERE kind = 'C') AS classes
           FROM functions GROUP BY 1, 2),
lines AS (SELECT *, string_split(content, chr(10)) AS l FROM fx_linked_sources),
read AS (SELECT file_id, repo_id, filepath, len(l) AS loc, len(l) - len(list_filter(l, lambda x: regexp_matches(x, '{BLANK}')))
         - len(list_filter(l, lambda x: regexp_matches(x, CASE WHEN file_id % 5 < 3 THEN '{PYTHON_COMMENT}' ELSE '{JAVA_COMMENT}' END))) AS sloc FROM lines),
new AS (SELECT r.*, coalesce(total, 0) AS cc, coalesce(most, 0) AS most, coalesce(mean, 0) AS mean, CASE WHEN file_id % 5 < 3 THEN 4 ELSE 2 END AS fan_out, CASE WHEN file_id % 5 < 3 THEN 0 ELSE 2 END AS cbo,
               coalesce(methods, 0) AS methods, CASE WHEN total IS NULL AND file_id % 5 > 2 THEN 1 ELSE coalesce(classes, 0) END AS classes, CASE WHEN loc > 500 THEN 1 ELSE 0 END AS smells, d.fan_in
        FROM read r LEFT JOIN rolled USING (repo_id, filepath) JOIN degrees d USING (file_id)),
old AS (SELECT *, file_id % 2 = 0 AS known FROM new)
SELECT o.repo_id, o.file_id AS id, CAST(cc AS DOUBLE) AS cyclomatic_complexity, CAST(cc AS DOUBLE) AS wmc, CAST(cbo AS DOUBLE) AS cbo, CAST(smells AS DOUBLE) AS code_smells_count,
       CASE WHEN known THEN -1e0 ELSE most END AS max_cyclomatic_complexity, round(CASE WHEN known THEN -1e0 ELSE mean END, 6) AS avg_cyclomatic_complexity,
       CASE WHEN known THEN -1e0 ELSE fan_in END AS fan_in, CASE WHEN known THEN -1e0 ELSE o.fan_out END AS fan_out, CASE WHEN known THEN -1e0 ELSE loc END AS loc, CASE WHEN known THEN -1e0 ELSE sloc END AS sloc,
       CASE WHEN known THEN -1e0 ELSE methods END AS num_methods, CASE WHEN known THEN -1e0 ELSE classes END AS num_classes,
       {", ".join(f"CASE WHEN known THEN -1e0 ELSE 0 END AS {c}" for c in ("dit", "noc", "rfc", "lcom"))},
       coalesce(change_frequency, 0) AS change_frequency, coalesce(author_count, 1) AS author_count, CASE WHEN b.filepath IS NULL THEN 0 ELSE 1 END AS is_buggy,
       (SELECT count(*) FROM changes c WHERE c.repo_id = o.repo_id AND c.filepath = o.filepath AND c.is_bugfix AND c.committed_at < TIMESTAMP '1996-01-01 00:00:00') AS bug_history
FROM old o LEFT JOIN stats s ON s.repo_id = o.repo_id AND s.filepath = o.filepath LEFT JOIN buggy b ON b.repo_id = o.repo_id AND b.filepath = o.filepath""")
def _(t):
    """Sources to metrics, metrics into the stored table, and the feature table from there."""
    sources = t.fx_linked_sources.select("repo_id", "file_id", "filepath", "content")
    functions = t.spark.sql(LINKED_FUNCTIONS + " FROM (SELECT *, explode(sequence(1, cast(file_id % 6 AS INT))) AS j FROM {sources} WHERE file_id % 6 > 0) x", sources=sources)
    landed = written(mt.analyzed_files(sources, functions, md.file_dependency_degrees(sources)).drop("language", "code_smells"), "analyzed")
    landed = landed.withColumns({c: F.col(c).cast("double") for c in METRICS}).withColumn("created_at", F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    landed = landed.withColumnRenamed("file_id", "id").withColumn("commit_sha", F.lit(None).cast("string"))
    stored = landed.where("id % 2 = 0").withColumns({c: F.lit(x) for c, x in STORED.items()}).withColumn("commit_sha", F.lit(upserts.HEAD))
    metrics = written(upserts.upsert_file_metrics(stored, landed.withColumn("seq", F.col("id"))), "metrics")
    files = t.spark.sql(LINKED_FILES, files=sources, orders=t.orders)
    out = dp.feature_table(metrics, files, commits(t))
    return out.select("repo_id", "id", *METRICS, "change_frequency", "author_count", "is_buggy", "bug_history").withColumn(
        "avg_cyclomatic_complexity", F.round("avg_cyclomatic_complexity", 6))


FUNCTIONS = """
functions AS (SELECT l_partkey % 25 AS repo_id, concat('src/C', CAST(l_partkey AS STRING)) AS filepath,
                     concat('f', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS name,
                     CASE l_linenumber % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'M' ELSE 'F' END AS kind,
                     CAST(l_quantity AS INT) % 25 + 1 AS complexity, CAST(l_orderkey % 500 AS INT) AS lineno FROM lineitem)"""


def functions(t):
    """Function rows as a per-file parser would report them."""
    key = F.col("l_linenumber") % 3
    return t.lineitem.select(
        (F.col("l_partkey") % 25).alias("repo_id"), F.concat(F.lit("src/C"), F.col("l_partkey")).alias("filepath"),
        F.concat(F.lit("f"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("name"),
        F.when(key == 0, "C").when(key == 1, "M").otherwise("F").alias("kind"),
        (F.col("l_quantity").cast("int") % 25 + 1).alias("complexity"), (F.col("l_orderkey") % 500).cast("int").alias("lineno"))


@query("complexity_rollup", f"""
WITH {FUNCTIONS} SELECT repo_id, filepath, CAST(sum(complexity) AS BIGINT) AS cyclomatic_complexity, CAST(sum(complexity) AS BIGINT) AS wmc,
  max(complexity) AS max_cyclomatic_complexity, round(avg(complexity), 9) AS avg_cyclomatic_complexity,
  count(*) FILTER (WHERE kind <> 'C') AS num_methods, count(*) FILTER (WHERE kind = 'C') AS num_classes FROM functions GROUP BY repo_id, filepath""")
def _(t):
    out = mt.rollup_complexity(functions(t))
    return out.withColumn("avg_cyclomatic_complexity", F.round("avg_cyclomatic_complexity", 9))


@query("function_smells", f"""
WITH {FUNCTIONS}
SELECT repo_id, filepath, lineno AS line_start, 'high_complexity' AS smell_type, CASE WHEN complexity > 20 THEN 'high' ELSE 'medium' END AS severity,
       concat(name, ' has cyclomatic complexity of ', complexity, ' (threshold: 10)') AS message FROM functions WHERE complexity > 10
UNION ALL SELECT repo_id, filepath, lineno, 'long_method', 'medium', concat(name, ' is likely too long based on complexity') FROM functions WHERE complexity > 15""")
def _(t):
    return mt.smells_from_functions(functions(t))
