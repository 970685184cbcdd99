"""All registered queries."""

from checks import balancing, learning, ranking, relational, storage, streams, texts  # noqa: F401
from checks.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
