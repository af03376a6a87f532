"""The SQL counterparts of the operators' queries, on the smallest tables."""

import pytest

from foliospark.llm import queries

from .. import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare.differences(spark, compare.duck(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) == ""
