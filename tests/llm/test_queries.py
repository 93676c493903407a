"""Queries that SQL can express, on whole tables."""

import pytest
from oracle import compare, connect
from polyagg.llm.queries import SQL, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_duckdb(spark, name):
    assert compare(spark, connect(SF), queries()[name], SQL[name], SF) > 0
