"""Every registered query against its DuckDB oracle (row count, columns, values) on sf0.001,
plus the driver's entry point."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from fieldwork.plans import queries as registry
from oracle_check import compare, duck_conn

QUERIES = registry.queries()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_conn(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    r = compare(spark, SF_SMALL, key, QUERIES[key], ORACLES.get(key), duck)
    assert r["status"] in ("ok", "rows-only"), r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["project", "interview", "report_no", "report_block"]
    assert df.count() > 0
