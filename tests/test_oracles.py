"""Every registered query against its SQL, or at least to a stable schema, on the smallest tables."""

import pytest
from conftest import SF
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    ok, why = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
