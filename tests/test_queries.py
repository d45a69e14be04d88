"""Every registered query of the metering engine against its SQL in another engine."""

from __future__ import annotations

import pytest
from comparing import by_duckdb, by_spark
from conftest import SMALL

from meterlark import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    columns, rows = by_spark(catalog.QUERIES[name](spark, SMALL))
    wanted_columns, wanted = by_duckdb(catalog.SQL[name], SMALL)
    assert columns == wanted_columns
    assert rows == wanted
