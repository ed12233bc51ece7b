"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest
from oracle_check import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def connection(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, tiny, connection, name):
    assert difference(queries()[name](spark, tiny), connection, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLE)))
def test_query_without_sql_runs(spark, tiny, name):
    assert queries()[name](spark, tiny).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
