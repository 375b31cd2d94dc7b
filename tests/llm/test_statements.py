"""Queries of this subpackage that SQL can state equal DuckDB's result."""

import pytest
from duck import connection, same

from affinis.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_duckdb(spark, name, sf):
    at = f"/root/testdata/sf{sf}"
    same(QUERIES[name](spark, at), connection(at), ORACLES[name])
