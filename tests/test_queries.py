"""Every query outside the llm package runs at the smallest size and, where there is SQL, gives the same rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, connect, rows, sql_rows

SF = "sf0.001"
pytestmark = pytest.mark.skipif(not (DATA / SF).exists(), reason="no test data")
CORE = [k for k, f in entry.queries().items() if not f.__module__.startswith("tidemark.llm")]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, str(DATA / SF))
    columns = sorted(df.columns)
    found = rows(df, columns)
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert found == sql_rows(con, sql, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
