"""Feature columns, cleaning, splitting, folds and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectscope.functions.scoring import replace_non_finite
from defectscope.operators.ranking import ranked
from defectscope.schemas import FEATURE_COLUMNS, LABEL, METRIC_COLUMNS, NON_FEATURES, TABLE_KEYS

# Seed, test share and the size from which a split may be temporal.
SEED = 42
TEST_RATIO = 0.2
TEMPORAL_MIN_ROWS = 10


def fill_metrics(df: DataFrame, cols: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """Missing metrics (null or NaN) become 0."""
    return df.fillna(0, subset=[c for c in cols if c in df.columns])


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither identifiers nor the label, in frame order."""
    numeric = (T.IntegerType, T.LongType, T.DoubleType)
    skipped = {*NON_FEATURES, *TABLE_KEYS}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, numeric) and f.name not in skipped]


def assemble_features(df: DataFrame, cols: Sequence[str] | None = None, output: str = "features") -> DataFrame:
    """Vector column for Spark ML, plus a double `label`; rows stay distributed."""
    from pyspark.ml.feature import VectorAssembler

    cols = list(cols or feature_columns(df))
    out = VectorAssembler(inputCols=cols, outputCol=output, handleInvalid="keep").transform(df)
    return out.withColumn("label", F.col(LABEL).cast("double")) if LABEL in df.columns else out


def project_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The schema's feature columns that are present, in schema order."""
    return df.select(*keep, *[c for c in FEATURE_COLUMNS if c in df.columns])


def clean_numeric(df: DataFrame, cols: Sequence[str], mode: str = "bound") -> DataFrame:
    return df.withColumns({c: replace_non_finite(F.col(c).cast("double"), mode) for c in cols})


def shuffled(identity: Column, seed: int = SEED) -> Column:
    """A repeatable random order: the same row gets the same place on every run."""
    return F.md5(F.concat_ws("|", identity.cast("string"), F.lit(str(seed))))


def train_rows(n: Column, ratio: float) -> Column:
    return F.floor(n.cast("double") * F.lit(1.0 - ratio))


def test_rows(n: Column, ratio: float) -> Column:
    return F.ceil(n.cast("double") * F.lit(float(ratio)))


def temporal_split(df: DataFrame, ratio: float = TEST_RATIO, **limits) -> DataFrame:
    """Oldest rows of each repository train, the newest `ratio` test."""
    numbered = ranked(df, ["repo_id"], [F.asc_nulls_last("created_at"), F.asc("id")], rank="__rn",
                      totals={"__n": F.lit(1)}, **limits)
    return _split(numbered, F.col("__rn") <= train_rows(F.col("__n"), ratio))


def random_split(df: DataFrame, ratio: float = TEST_RATIO, seed: int = SEED,
                 strata: Sequence[str] = (), **limits) -> DataFrame:
    """Exact-size repeatable split of each repository (and of each stratum in it)."""
    numbered = ranked(df.withColumn("__h", shuffled(F.col("id"), seed)), ["repo_id", *strata],
                      [F.asc("__h"), F.asc("id")], rank="__rn", totals={"__n": F.lit(1)}, **limits)
    return _split(numbered, F.col("__rn") > test_rows(F.col("__n"), ratio)).drop("__h")


def stratified_split(df: DataFrame, ratio: float = TEST_RATIO, seed: int = SEED, **limits) -> DataFrame:
    return random_split(df, ratio, seed, strata=[LABEL], **limits)


def split_dataset(df: DataFrame, ratio: float = TEST_RATIO, temporal: bool = True,
                  seed: int = SEED, **limits) -> DataFrame:
    """Temporal split where asked for and the repository has more than 10 rows, else random."""
    if not temporal:
        return random_split(df, ratio, seed, **limits)
    numbered = ranked(df, ["repo_id"], [F.asc_nulls_last("created_at"), F.asc("id")], rank="__rn",
                      totals={"__n": F.lit(1)}, **limits)
    # The random branch serves groups of at most 10 rows, so its window stays tiny.
    large = _split(numbered.where(F.col("__n") > TEMPORAL_MIN_ROWS),
                   F.col("__rn") <= train_rows(F.col("__n"), ratio))
    small = random_split(numbered.where(F.col("__n") <= TEMPORAL_MIN_ROWS).drop("__rn", "__n"), ratio, seed)
    return large.unionByName(small)


def _split(numbered: DataFrame, is_train: Column) -> DataFrame:
    return numbered.withColumn("split", F.when(is_train, "train").otherwise("test")).drop("__rn", "__n")


def with_folds(df: DataFrame, k: int = 5, seed: int = SEED, **limits) -> DataFrame:
    """Stratified fold number 0..k-1 per repository and label."""
    numbered = ranked(df.withColumn("__h", shuffled(F.col("id"), seed)), ["repo_id", LABEL],
                      [F.asc("__h"), F.asc("id")], rank="__rn", **limits)
    return numbered.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__rn", "__h")


def fit_scaler(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of each column (zero deviation becomes 1), per `keys`."""
    stats = []
    for c in cols:
        deviation = F.stddev_pop(c)
        stats += [F.avg(c).alias(f"{c}__mean"),
                  F.when(deviation == 0, F.lit(1.0)).otherwise(deviation).alias(f"{c}__std")]
    return df.groupBy(*keys).agg(*stats)


def scale(df: DataFrame, cols: Sequence[str], stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Standardized columns. Statistics over all rows are one row, hence safe to broadcast; those of groups need their `keys`."""
    grouped = [c for c in stats.columns if c not in keys and not c.endswith(("__mean", "__std"))]
    if grouped:
        raise ValueError(f"the statistics are by {', '.join(grouped)}: name them as keys")
    joined = df.join(stats, list(keys)) if keys else df.join(F.broadcast(stats))
    return joined.withColumns(
        {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in cols}
    ).select(*df.columns)


def union_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()
