"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from foliospark import catalog

from . import compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(spark, con, SF, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert QUERIES.keys() <= e.queries().keys()
    assert e.oracle_sql().keys() <= e.queries().keys()
