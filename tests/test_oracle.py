"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import SF, connection, same

from tramline import queries as core


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query(spark, con, name):
    same(core.QUERIES[name](spark, SF), core.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() >= 1


def test_every_sql_has_a_query():
    assert set(core.ORACLE_SQL) <= set(core.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[0] == "corridor_id"
    assert set(core.QUERIES) <= set(e.queries())
