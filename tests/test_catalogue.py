"""Every catalogue query with a statement equals DuckDB's result at the smallest scale."""

import pytest
from duck import connection, same

from affinis.plans.catalogue import QUERIES
from affinis.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_duckdb(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_fixture_roundtrip(spark):
    rows = QUERIES["fixture_roundtrip"](spark, SF).collect()
    assert len(rows) == 6 and all(r.violations == 0 for r in rows)


def test_bootstrap_contains_the_ratio(spark):
    ci = QUERIES["bootstrap_ci"](spark, SF).first()
    ratio = QUERIES["paired_log_ratio"](spark, SF).first().ratio
    assert ci.draws == 5000 and ci.low < ratio < ci.high
    assert QUERIES["bootstrap_ci"](spark, SF).first() == ci


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["i", "j", "n", "sim"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
