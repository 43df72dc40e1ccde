"""Every query with SQL gives the SQL's rows; every query without keeps its contract on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

CORE = [q for q in sorted(entry.queries()) if not entry.queries()[q].__module__.startswith("sievework.llm")]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", [q for q in CORE if q in entry.oracle_sql()])
def test_same_rows_as_sql(spark, data, con, name):
    assert differences(entry.queries()[name](spark, data), con, entry.oracle_sql()[name]) == ([], [])


@pytest.mark.parametrize("name", [q for q in CORE if q not in entry.oracle_sql()])
def test_runs_without_sql(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
