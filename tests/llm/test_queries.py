"""The queries of the llm package at the smallest size, against SQL where there is any."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, connect, rows, sql_rows

SF = "sf0.001"
pytestmark = pytest.mark.skipif(not (DATA / SF).exists(), reason="no test data")
NAMES = [k for k, f in entry.queries().items() if f.__module__.startswith("tidemark.llm")]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, str(DATA / SF))
    columns = sorted(df.columns)
    found = rows(df, columns)
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert found == sql_rows(connect(SF), sql, columns)
