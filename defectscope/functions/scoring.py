"""Column expressions for scores, bands and metric limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weights and item defaults of the priority score.
DEFAULT_WEIGHTS = {"risk": 1.0, "crit": 0.5, "coverage": 0.2}
DEFAULT_CRITICITE = 1.0
DEFAULT_COVERAGE_GAP = 0.0

# Recommended upper limits (exclusive) of class metrics.
RECOMMENDED_LIMITS = {"wmc": 20, "dit": 5, "cbo": 10, "rfc": 50}

MAX_DOUBLE = 1.7976931348623157e308


def priority_score(
    risk: Column, effort: Column, criticite: Column, coverage_gap: Column,
    weights: Mapping[str, float] | None = None,
) -> Column:
    """Weighted value of an item per square root of its effort."""
    w = {**DEFAULT_WEIGHTS, **(weights or {})}
    value = (
        risk * F.lit(float(w["risk"]))
        + F.coalesce(criticite, F.lit(DEFAULT_CRITICITE)) * F.lit(float(w["crit"]))
        + F.coalesce(coverage_gap, F.lit(DEFAULT_COVERAGE_GAP)) * F.lit(float(w["coverage"]))
    )
    return value / F.sqrt(F.greatest(effort, F.lit(1.0)))


def coverage_band(coverage: Column) -> Column:
    return F.when(coverage >= 90, "green").when(coverage >= 70, "yellow").otherwise("red")


def risk_badge(risk: Column) -> Column:
    return F.when(risk <= 0.2, "Low").when(risk <= 0.5, "Medium").otherwise("High")


def risk_bucket(risk: Column) -> Column:
    return F.when(risk <= 0.3, "low").when(risk <= 0.7, "medium").otherwise("high")


def replace_non_finite(value: Column, mode: str) -> Column:
    """`bound`: NaN to 0, infinities to the largest double. `zero`: all three to 0."""
    if mode not in ("bound", "zero"):
        raise ValueError(f"unknown mode {mode!r}")
    edge = MAX_DOUBLE if mode == "bound" else 0.0
    return (
        F.when(F.isnan(value), F.lit(0.0))
        .when(value == F.lit(float("inf")), F.lit(edge))
        .when(value == F.lit(float("-inf")), F.lit(-edge))
        .otherwise(value)
    )


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)))
