"""Every registered query with SQL gives the same rows in DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import catalog
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    problem = difference(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name])
    # A rule may have no case at all in the smallest tables.
    assert problem in (None, "both empty"), problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
