"""Every listed query runs; those with SQL give the SQL's rows."""

import pytest

import __spark_entry__ as entry

from .oracle import DATA, TABLES, compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(n for n in QUERIES if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con():
    return connect()


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(QUERIES) and len(TABLES) == 14


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    if name in SQL:
        compare(spark, con, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
