"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    if name not in SQL:
        assert got.count() > 0
        return
    problem = compare(got.toPandas(), con.execute(SQL[name]).df())
    assert problem is None, problem


def test_entry(spark):
    assert contract.entry(spark).count() == 4


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
