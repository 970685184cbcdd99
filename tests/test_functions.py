"""Hand-worked values of column functions and text rules."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from defectscope.functions import commits as cx
from defectscope.functions import scoring as sx
from defectscope.functions import text as tx
from defectscope.operators import dashboards as db
from defectscope.operators import features as ft
from defectscope.operators import metrics as mt
from defectscope.sources.landing import normalize_commits


def values(spark, texts, column):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    return [r.v for r in df.select("i", column(F.col("s")).alias("v")).orderBy("i").collect()]


def test_bugfix_words_match_as_substrings(spark):
    messages = ["Fix login", "Update prefix table", "dispatch queue", "docs", None]
    assert values(spark, messages, cx.is_bugfix) == [True, True, True, False, False]


def test_bugfix_flag_sees_the_whole_message(spark):
    df = spark.createDataFrame([("x" * 600 + " fix", None, None), (None, "a", "b")], "message string, author_name string, author_email string")
    first, second = normalize_commits(df).orderBy(F.desc(F.length("message"))).collect()
    assert first.is_bugfix and len(first.message) == 500
    assert (first.author_name, first.author_email) == ("Unknown", "")
    assert second.message == "" and not second.is_bugfix


def test_iso_dates_drop_the_offset(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05.25-0530", "2024-01-02", "2024-01-02T03:04",
             "", "junk", None, "2024-02-30"]
    at = datetime(2024, 1, 2, 3, 4, 5)
    assert values(spark, texts, cx.parse_iso) == [
        at, at, at.replace(microsecond=250000), datetime(2024, 1, 2), datetime(2024, 1, 2, 3, 4), None, None, None, None]


def test_urls(spark):
    urls = ["https://h/o/r.git", "https://h/o/r/", "https://h/o/r.git/", "  https://h/o/r\n"]
    assert values(spark, urls, cx.normalized_url) == ["https://h/o/r", "https://h/o/r", "https://h/o/r.git", "https://h/o/r"]
    assert values(spark, urls[:3], cx.owner_of) == ["o"] * 3
    assert values(spark, urls[:3], cx.repo_name_of) == ["r"] * 3


def test_language(spark):
    paths = ["a/b.PY", "x.tar.go", "a.b/c", ".py", "m.", "d/e.scala", "q.txt"]
    assert values(spark, paths, cx.language_of) == ["python", "go", "unknown", "unknown", "unknown", "scala", "unknown"]


def test_display_name(spark):
    assert values(spark, ["src/a_very_long_file_name.py", "short.py", "dir/"], cx.display_name) == ["a_very_long_fil", "short.py", "dir/"]


PYTHON = ("import os\nfrom a import b\n\n# note\n   # indented\nif x and y:\n    pass\n"
          "def f(self, a, b,\n      c, d, e, f=1):\n    return 1\ndef g(self, a, b, c, d, e): pass\n")
JAVA = ("import a.b;\nimport java.util.*;\nimport c.D;\n/* x\n * y */\n// z\npublic class A {\n}\ninterface B {}\nenum C {}\n"
        + "public int f(int x) { return x; }\n" * 21 + "{" + "\n" * 51 + "}\n")


def one(spark, content, language, column):
    df = spark.createDataFrame([(content, language)], "c string, l string")
    return df.select(column(F.col("c"), F.col("l")).alias("v")).first().v


def test_python_text(spark):
    assert one(spark, PYTHON, "python", lambda c, l: tx.line_count(c)) == len(PYTHON.split("\n"))
    assert one(spark, PYTHON, "python", lambda c, l: tx.blank_lines(c)) == 2
    assert one(spark, PYTHON, "python", tx.comment_lines) == 2
    assert one(spark, PYTHON, "python", tx.fan_out) == 2
    assert one(spark, PYTHON, "python", lambda c, l: tx.decision_points(c)) == 3
    assert one(spark, PYTHON, "python", tx.imported_names) == ["a", "os"]
    assert one(spark, "import os, sys as s\nimport a.b  # why\n", "python", tx.imported_names) == ["os", "sys", "a.b"]
    smells = one(spark, PYTHON, "python", tx.smells_of)
    assert [(s.smell_type, s.severity, s.line_start) for s in smells] == [("too_many_parameters", "low", 8)]
    assert smells[0].message == "Function has 6 parameters (threshold: 5)"


def test_java_text(spark):
    assert one(spark, JAVA, "java", tx.comment_lines) == 3
    assert one(spark, JAVA, "java", tx.fan_out) == 2
    assert one(spark, JAVA, "java", lambda c, l: tx.java_classes(c)) == 3
    assert one(spark, JAVA, "java", lambda c, l: tx.java_methods(c)) == 21
    smells = one(spark, JAVA, "java", tx.smells_of)
    assert [(s.smell_type, s.severity) for s in smells] == [("god_class", "high"), ("long_method", "medium")]
    assert smells[0].message == "Class has 21 methods (threshold: 20)" and smells[1].line_start is None


@pytest.mark.parametrize("newlines,fires", [(499, False), (500, True)])
def test_large_file_needs_more_than_500_lines(spark, newlines, fires):
    smells = one(spark, "x\n" * newlines, "python", tx.smells_of)
    assert ([s.smell_type for s in smells] == ["large_file"]) == fires


@pytest.mark.parametrize("ws", ["\u00a0", "\u2003", "\x1c", "\x85", "\u3000", "\t"])
def test_white_space_is_the_unicode_set(spark, ws):
    assert ws.isspace()
    assert one(spark, f"a\n{ws}\nb", "x", lambda c, l: tx.blank_lines(c)) == 1


def test_line_rules_equal_a_plain_reading(spark):
    text = "a\r\n\r\n \t\nb # c\n#\u00a0d\n\u2028\n  * e\n/* f */\n"
    lines = text.split("\n")
    assert one(spark, text, "x", lambda c, l: tx.blank_lines(c)) == sum(not s.strip() for s in lines)
    assert one(spark, text, "python", tx.comment_lines) == sum(s.strip().startswith("#") for s in lines)
    assert one(spark, text, "java", tx.comment_lines) == sum(bool(re.match(r"//|/\*|\*", s.strip())) for s in lines)


def test_file_metrics_have_one_schema(spark):
    df = spark.createDataFrame([(1, 1, "a.py", PYTHON), (1, 2, "b.java", JAVA), (1, 3, "c.js", "x\n\n")],
                               "repo_id bigint, file_id bigint, filepath string, content string")
    got = {r.file_id: r for r in mt.file_metrics(df).collect()}
    assert got[2].cbo == got[2].fan_out == 2 and got[1].cbo == 0
    assert (got[3].loc, got[3].sloc, got[3].blank_lines, got[3].code_smells_count) == (3, 1, 2, 0)


def test_non_finite_numbers(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (float("-inf"), 3), (1.5, 4), (None, 5)], "x double, i int")
    top = 1.7976931348623157e308
    bound = [r.x for r in ft.clean_numeric(df, ["x"], "bound").orderBy("i").collect()]
    zero = [r.x for r in ft.clean_numeric(df, ["x"], "zero").orderBy("i").collect()]
    assert bound == [0.0, top, -top, 1.5, None] and zero == [0.0, 0.0, 0.0, 1.5, None]


def test_feature_columns_skip_identifiers(spark):
    df = spark.createDataFrame([(1, 2, "p", 1.0, 3, 0, 7)], "repo_id bigint, file_id bigint, filepath string, wmc double, loc int, is_buggy int, dit bigint")
    assert ft.feature_columns(df) == ["wmc", "loc", "dit"]


def test_bands(spark):
    df = spark.createDataFrame([(90.0, 0.2, 0.3), (70.0, 0.5, 0.7), (69.9, 0.51, 0.71)], "c double, r double, b double")
    rows = df.select(sx.coverage_band(F.col("c")), sx.risk_badge(F.col("r")), sx.risk_bucket(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("green", "Low", "low"), ("yellow", "Medium", "medium"), ("red", "High", "high")]


def test_smells_by_severity_drops_empty_ones(spark):
    df = spark.createDataFrame([("low",), ("high",), ("low",), ("odd",)], "severity string")
    assert [(r.name, r.value) for r in mt.smells_by_severity(df).collect()] == [("High", 1), ("Low", 2)]


def test_repositories_without_rows(spark):
    metrics = spark.createDataFrame([(1, 4.0, 2.0, None, 1.0, 3, 10)], "repo_id bigint, cyclomatic_complexity double, wmc double, cbo double, lcom double, code_smells_count int, loc int")
    repos = spark.createDataFrame([(1,), (2,)], "id bigint")
    got = {r.repo_id: r for r in db.analysis_summary(metrics, repos).collect()}
    assert got[2].status == "no_data" and got[1].status == "analyzed" and got[1].avg_cbo == 0.0
    models = spark.createDataFrame([(1, 0.5), (1, 0.9)], "repo_id bigint, accuracy double")
    quality = {r.id: r.coverage for r in db.repo_model_quality(repos, models).collect()}
    assert quality == {1: 70, 2: 85}
    commits = spark.createDataFrame([(2, True), (2, False)], "repo_id bigint, is_bugfix boolean")
    issues = spark.createDataFrame([(1, True)], "repo_id bigint, is_bug boolean")
    totals = {r.repo_id: (r.commits_total, r.commits_bugfixes, r.issues_bugs, r.total_files) for r in db.repo_metrics(repos, commits, issues, metrics).collect()}
    assert totals == {1: (0, 0, 1, 1), 2: (2, 1, 0, 0)}


def test_trend_without_previous_value(spark):
    df = spark.createDataFrame([(1, "m", 1, "2024-01-01", 5.0), (2, "m", 2, "2024-01-01", 4.0), (2, "m", 3, "2024-01-02", 6.5), (3, "m", 4, "2024-01-01", 0.0), (3, "m", 5, "2024-01-02", 3.0)],
                               "repo_id int, metric_name string, id int, recorded_at string, metric_value double")
    assert {r.repo_id: r.change for r in db.trend_delta(df).collect()} == {1: 0.0, 2: 2.5, 3: 0.0}


def test_complexity_rollup_of_a_file_without_functions(spark):
    files = spark.createDataFrame([(1, "a"), (1, "b")], "repo_id bigint, filepath string")
    functions = spark.createDataFrame([(1, "a", "f", "F", 4, 1), (1, "a", "m", "M", 6, 2), (1, "a", "C", "C", 5, 3)],
                                      "repo_id bigint, filepath string, name string, kind string, complexity int, lineno int")
    got = {r.filepath: r for r in mt.with_complexity(files, functions).collect()}
    assert (got["a"].wmc, got["a"].max_cyclomatic_complexity, got["a"].avg_cyclomatic_complexity, got["a"].num_methods, got["a"].num_classes) == (15, 6, 5.0, 2, 1)
    assert got["b"].cyclomatic_complexity == 0 and got["b"].num_methods == 0
