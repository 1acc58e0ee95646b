"""Every registered query that SQL expresses equals its DuckDB text; every other one runs."""

import pytest

from passwatch.queries import ORACLES, QUERIES
from tests.oracle import SF, same

#: Covered by the queries that they are made of.
SLOW: set[str] = set()


@pytest.mark.parametrize("name", sorted(ORACLES.keys() - SLOW))
def test_equals_duckdb(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys() - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
