"""File metrics and smells from source text, function tables and metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectscope.functions import text as tx
from defectscope.functions.commits import display_name, language_of
from defectscope.functions.scoring import RECOMMENDED_LIMITS

# Complexity, size and coupling limits of smells.
COMPLEX, VERY_COMPLEX, LIKELY_LONG = 10, 20, 15
LARGE_LOC, COUPLED = 300, 10

# Severity order.
SEVERITIES = ["critical", "high", "medium", "low"]


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("filepath")))


def line_counts(sources: DataFrame) -> DataFrame:
    """loc, sloc, comments and blank lines by the rules of each file's language."""
    content, language = F.col("content"), F.col("language")
    counted = with_language(sources).select(
        "repo_id", "file_id", "filepath", "language",
        tx.line_count(content).alias("loc"),
        tx.comment_lines(content, language).alias("comments"),
        tx.blank_lines(content).alias("blank_lines"))
    return counted.withColumn("sloc", F.col("loc") - F.col("comments") - F.col("blank_lines"))


def file_metrics(sources: DataFrame) -> DataFrame:
    """One row per file with a common schema for every language; one scan, no shuffle.

    Parser-made complexities are not text counts: they join in from `rollup_complexity`.
    """
    content, language = F.col("content"), F.col("language")
    java = language == "java"
    read = with_language(sources).select(
        "repo_id", "file_id", "filepath", "language",
        tx.line_count(content).alias("loc"),
        tx.comment_lines(content, language).alias("comments"),
        tx.blank_lines(content).alias("blank_lines"),
        tx.fan_out(content, language).alias("fan_out"),
        F.when(java, tx.java_classes(content)).otherwise(0).alias("num_classes"),
        F.when(java, tx.java_methods(content)).otherwise(0).alias("num_methods"),
        tx.decision_points(content).alias("decision_points"),
        tx.smells_of(content, language).alias("code_smells"))
    return read.select(
        "*",
        (F.col("loc") - F.col("comments") - F.col("blank_lines")).alias("sloc"),
        F.when(java, F.col("fan_out")).otherwise(0).alias("cbo"),
        F.size("code_smells").alias("code_smells_count"))


def import_edges(sources: DataFrame) -> DataFrame:
    """(repo_id, source file, target module) for every import found."""
    names = tx.imported_names(F.col("content"), F.col("language"))
    edges = with_language(sources).select(
        "repo_id", F.col("filepath").alias("source"), F.explode_outer(names).alias("target"))
    return edges.where(F.col("target").isNotNull())


def rollup_complexity(functions: DataFrame) -> DataFrame:
    """Function rows (repo_id, filepath, name, kind, complexity, lineno) to one row per file."""
    total, kind = F.sum("complexity"), F.col("kind")
    return functions.groupBy("repo_id", "filepath").agg(
        total.alias("cyclomatic_complexity"), total.alias("wmc"),
        F.max("complexity").alias("max_cyclomatic_complexity"),
        F.avg("complexity").alias("avg_cyclomatic_complexity"),
        F.count_if(kind.isin("M", "F")).alias("num_methods"),
        F.count_if(kind == "C").alias("num_classes"))


def with_complexity(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Attach the roll-up; a file without functions gets zeros."""
    rolled = rollup_complexity(functions)
    added = [c for c in rolled.columns if c not in ("repo_id", "filepath")]
    return files.drop(*added).join(rolled, ["repo_id", "filepath"], "left").fillna(0, subset=added)


def analyzed_files(sources: DataFrame, functions: DataFrame, degrees: DataFrame) -> DataFrame:
    """Every metric column of each file, ready to be upserted: text counts, the roll-up of its functions, and `fan_in`.

    `degrees` are the files' in- and out-degrees (`file_dependency_degrees`). Declarations
    are counted from the functions where there are any, else from the text. Inheritance,
    response and cohesion have no text measure and are 0, as in the stored form.
    """
    counted = file_metrics(sources).withColumnsRenamed({"num_methods": "text_methods", "num_classes": "text_classes"})
    rolled = with_complexity(counted, functions)
    parsed = (F.col("num_methods") > 0) | (F.col("num_classes") > 0)
    joined = rolled.join(degrees.select("repo_id", "filepath", "fan_in"), ["repo_id", "filepath"], "left")
    whole = {c: F.col(c).cast("int") for c in ("fan_out", "loc", "sloc", "code_smells_count")}
    return joined.select(
        "repo_id", "file_id", "filepath", "language", "code_smells",
        *(F.col(c).cast("double").alias(c) for c in ("cyclomatic_complexity", "max_cyclomatic_complexity", "avg_cyclomatic_complexity", "wmc", "cbo")),
        *(F.lit(0.0).alias(c) for c in ("dit", "noc", "rfc", "lcom")), F.coalesce("fan_in", F.lit(0)).cast("int").alias("fan_in"),
        F.when(parsed, F.col("num_methods")).otherwise(F.col("text_methods")).cast("int").alias("num_methods"),
        F.when(parsed, F.col("num_classes")).otherwise(F.col("text_classes")).cast("int").alias("num_classes"),
        *(v.alias(k) for k, v in whole.items()))


def smells_from_functions(functions: DataFrame) -> DataFrame:
    cc, name = F.col("complexity"), F.col("name")
    found = F.array_compact(F.array(
        F.when(cc > COMPLEX, F.struct(
            F.lit("high_complexity").alias("smell_type"),
            F.when(cc > VERY_COMPLEX, "high").otherwise("medium").alias("severity"),
            F.concat(name, F.lit(" has cyclomatic complexity of "), cc.cast("string"),
                     F.lit(f" (threshold: {COMPLEX})")).alias("message"))),
        F.when(cc > LIKELY_LONG, F.struct(
            F.lit("long_method").alias("smell_type"), F.lit("medium").alias("severity"),
            F.concat(name, F.lit(" is likely too long based on complexity")).alias("message")))))
    return functions.select("repo_id", "filepath", F.col("lineno").alias("line_start"), F.inline(found))


def smells_from_metrics(metrics: DataFrame) -> DataFrame:
    """Smells a metric row alone tells: complexity, size and coupling over their limits."""
    def smell(kind, severity, *message):
        return F.struct(F.lit(kind).alias("smell_type"), F.lit(severity).alias("severity"),
                        F.concat(*[m if not isinstance(m, str) else F.lit(m) for m in message]).alias("message"))

    cc, loc, cbo = F.col("max_cyclomatic_complexity"), F.col("loc"), F.col("cbo")
    found = F.array_compact(F.array(
        F.when(cc > COMPLEX, smell("high_complexity", "medium", "High cyclomatic complexity: ", cc.cast("string"))),
        F.when(loc > LARGE_LOC, smell("large_file", "low", "File has ", loc.cast("string"), " lines")),
        F.when(cbo > COUPLED, smell("high_coupling", "medium", "High coupling: CBO = ", cbo.cast("string")))))
    return metrics.select("repo_id", "filepath", F.inline(found))


def explode_smells(metrics: DataFrame) -> DataFrame:
    # The outer form: an inner one gets an inferred `size > 0` filter, which would evaluate
    # the text expressions behind the array a second time.
    rows = metrics.select("repo_id", "filepath", F.inline_outer("code_smells"))
    return rows.where(F.col("smell_type").isNotNull())


def smells_by_severity(smells: DataFrame) -> DataFrame:
    """Counts of the known severities, with their display order; absent ones have no row."""
    known = smells.where(F.col("severity").isin(SEVERITIES)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return known.select(F.initcap("severity").alias("name"), F.col("n").alias("value"), place.alias("place")).orderBy("place")


def smells_by_type(smells: DataFrame) -> DataFrame:
    return smells.groupBy("smell_type").agg(F.count(F.lit(1)).alias("count")).select(
        F.initcap(F.replace(F.col("smell_type"), F.lit("_"), F.lit(" "))).alias("type"), "count")


def smells_ordered(smells: DataFrame) -> DataFrame:
    known = {"critical": 1, "high": 2, "medium": 3}
    place = F.lit(4)
    for severity, n in known.items():
        place = F.when(F.col("severity") == severity, n).otherwise(place)
    return smells.withColumn("severity_rank", place).orderBy("severity_rank", "filepath")


def metrics_by_complexity(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc_nulls_first("cyclomatic_complexity"), F.asc("id"))


def chart_projection(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "repo_id", "id", display_name(F.col("filepath")).alias("name"), "wmc", "cbo", "rfc",
        F.least("lcom", F.lit(100.0)).alias("lcom"),
        F.col("cyclomatic_complexity").alias("complexity"), "loc",
        (F.col("code_smells_count") + 1).alias("smells"))


def metric_violations(metrics: DataFrame) -> DataFrame:
    """Flags of the metric table, the hotspot mark and the names of limits not kept."""
    cc, cbo = F.col("cyclomatic_complexity"), F.col("cbo")
    over = F.array_compact(F.array(*[
        F.when(F.col(m) >= limit, F.lit(m)) for m, limit in RECOMMENDED_LIMITS.items()]))
    return metrics.select(
        "repo_id", "id",
        F.coalesce(cc > 20, F.lit(False)).alias("cc_flag"), F.coalesce(cbo > 10, F.lit(False)).alias("cbo_flag"),
        (F.coalesce(cc > 30, F.lit(False)) | F.coalesce(cbo > 10, F.lit(False))).alias("hotspot"),
        over.alias("violated"))
