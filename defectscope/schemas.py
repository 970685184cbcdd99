"""Table schemas and the feature list."""

from __future__ import annotations

from pyspark.sql import types as T

# The feature vector, in its fixed order.
FEATURE_COLUMNS = [
    "wmc", "dit", "noc", "cbo", "rfc", "lcom",
    "cyclomatic_complexity", "max_cyclomatic_complexity", "avg_cyclomatic_complexity",
    "fan_in", "fan_out",
    "loc", "sloc", "num_methods", "num_classes",
    "code_smells_count",
    "change_frequency", "bug_history", "recent_changes", "author_count",
]

# Columns that are never features.
NON_FEATURES = ["file_id", "filepath", "is_buggy", "commit_sha", "created_at", "Unnamed: 0"]

# Keys our tables add to every frame; identifiers, so never features either.
TABLE_KEYS = ["repo_id", "id", "split", "dataset_id", "fold", "pos"]

METRIC_COLUMNS = FEATURE_COLUMNS[:16]

LABEL = "is_buggy"

COMMIT_JSON = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("sha", T.StringType()),
    T.StructField("commit", T.StructType([
        T.StructField("message", T.StringType()),
        T.StructField("author", T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("email", T.StringType()),
            T.StructField("date", T.StringType()),
        ])),
    ])),
])

COMMITS = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("sha", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("author_name", T.StringType()),
    T.StructField("author_email", T.StringType()),
    T.StructField("is_bugfix", T.BooleanType()),
    T.StructField("committed_at", T.TimestampNTZType()),
])

# The columns of a stored CSV dataset, in their fixed order.
DATASET_CSV = T.StructType(
    [T.StructField("file_id", T.LongType()), T.StructField("filepath", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in [
        "cyclomatic_complexity", "max_cyclomatic_complexity", "avg_cyclomatic_complexity",
        "wmc", "dit", "noc", "cbo", "rfc", "lcom", "fan_in", "fan_out", "loc", "sloc",
        "num_methods", "num_classes", "code_smells_count",
        "change_frequency", "bug_history", "recent_changes", "author_count",
    ]]
    + [T.StructField("is_buggy", T.IntegerType())]
)

CONFUSION = T.StructType([T.StructField(c, T.LongType()) for c in ("tn", "fp", "fn", "tp")])
