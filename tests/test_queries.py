"""Every query with SQL against DuckDB, every other one for its invariants."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.oracle import assert_same, connect
from tidepanel.plans import book_queries, liquidity_queries, market_queries, panel_queries, report_queries, trade_queries

SF = "/root/testdata/sf0.001"
MODULES = (panel_queries, trade_queries, report_queries, book_queries, market_queries, liquidity_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE[name])


#: Of each query without SQL: columns, and what every row of it must hold. Values are tested on their operators.
INVARIANTS = {
    "panel_fingerprint": lambda r: r["n"] > 0 and int(r["total"]) != 0,
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_invariants(spark, name):
    rows = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    assert rows and all(INVARIANTS.get(name, lambda r: any(v is not None for v in r.values()))(r) for r in rows), name


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["symbol", "month", "n_entries", "net_side"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
