"""Every registered query against its SQL twin, at the smallest scale."""

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

SQL, QUERIES = oracle_sql(), queries()


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, folder, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], folder) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
