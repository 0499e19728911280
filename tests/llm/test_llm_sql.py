"""Queries with SQL give the SQL's rows."""

import pytest
from oracle import compare

from folioflow.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", queries()[name], oracle_sql()[name]) is None
