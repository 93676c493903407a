import pytest
from oracle import compare, connect
from polyagg.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_have_sql():
    assert set(QUERIES) - set(SQL) == {"poly_grid_index"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_duckdb(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SF) > 0
