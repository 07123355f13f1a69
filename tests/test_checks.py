"""Fees, listings, checks and sessions against SQL and hand-made cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tidepanel.operators import checks, fees, listings, sessions
from tidepanel.plans import check_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(check_queries.ORACLE))
def test_matches_sql(spark, name):
    assert_same(check_queries.QUERIES[name](spark, SF), connect(SF), check_queries.ORACLE[name])


def test_edge_fees_of_a_hand_made_path(spark):
    """Opens at 2 (before prices: no event at 1), turns, closes below the least fee, stays open at the end."""
    pos = [1, 1, -1, 0, None, 1]
    rows = [("p", dt.date(2020, 1, 1 + i), p, None if i == 0 else 100.0, None if i == 0 else 50.0, 2.0) for i, p in enumerate(pos)]
    df = spark.createDataFrame(rows, "pair string, ts date, pos int, y double, x double, size double")
    one = -(2 * 0.5 + 2 * 0.01 * 2 + 2 * 150 * 10e-4)
    got = [r.cost for r in fees.edge_fees(df, 0.5, 10.0, 0.01).orderBy("ts").collect()]
    # the position held before the first prices never opened, so its turn only opens the next trade
    assert got == pytest.approx([0, 0, one, one, 0, one])
    least = [r.cost for r in fees.edge_fees(df, 0.5, 10.0, 0.01, min_fee=10.0).orderBy("ts").collect()]
    assert least == pytest.approx([0, 0, -5, -5, 0, one])
    most = [r.cost for r in fees.edge_fees(df, 0.5, 10.0, 0.01, max_fee=1.0).orderBy("ts").collect()]
    assert most == pytest.approx([0, 0, -0.5, -0.5, 0, one])


def test_event_fees_keep_rebates(spark):
    df = spark.createDataFrame([(10.0, -5.0, 100.0, 50.0, "maker"), (10.0, -5.0, 100.0, 50.0, None), (None, None, None, None, None)], "units_y double, units_x double, price_y double, price_x double, liquidity_y string")
    rows = fees.event_fees(df, maker_bps=-10.0, taker_bps=5.0, max_fee=0.5).collect()
    # maker leg: 1000 * 10 bps back twice; taker leg: 250 * 5 bps twice
    assert rows[0].fees == pytest.approx(2 * 1.0 - 2 * 0.125) and rows[0].fees_entry == pytest.approx(0.875)
    assert rows[1].fees == -0.5 and rows[1].fees_exit == -0.25 and rows[2].fees == 0 and rows[2].fees_entry == 0


def test_common_equity_by_name(spark):
    names = {"Acme Common Stock": True, "Acme Corp": True, "Acme ETF": False, "Growth Fund Inc": False, "Funding Circle Corp": True, "Acme Realty Trust": True, "Acme Trust": False, "Acme Trust Common Stock": True, "XYZ Income Trust Common Stock": False, "Acme 5% Notes due 2030": False}
    df = spark.createDataFrame([(n, "Technology") for n in names], "Name string, Sector string")
    assert {r.Name: r.yes for r in df.select("Name", listings.common_equity(df).alias("yes")).collect()} == names
    odd = spark.createDataFrame([(None, "Y", None), ("Acme", "n", "Closed-End Fund"), ("Acme Total Return", None, None)], "name string, ETF string, Type string").withColumns({"sector": F.lit("Finance"), "industry": F.lit("Finance Companies")})
    assert [r[0] for r in odd.select(listings.common_equity(odd)).collect()] == [False, False, False]


def test_rules_of_an_empty_table(spark):
    out = checks.check_rows(spark.createDataFrame([], "a int"), [checks.Rule("X", "warn", F.col("a") > 0, F.col("a"))]).collect()
    assert [tuple(r) for r in out] == [("X", "warn", 0, 0, None, None)]


def test_sessions_move_with_daylight_saving(spark):
    days = spark.createDataFrame([(dt.date(2024, 3, 8),), (dt.date(2024, 3, 11),)], "day date")
    rows = sessions.session_bars(days, 60).groupBy("day").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("day").collect()
    assert [(r.a.hour, r.a.minute, r.b.hour, r.n) for r in rows] == [(14, 30, 19, 6), (13, 30, 18, 6)]
    panel = spark.createDataFrame([("A", dt.datetime(2024, 3, 8, 3), 1.0)], "symbol string, ts timestamp, v double")
    assert sessions.on_union(panel, sessions.session_bars(days, 60)).groupBy("tradable").count().orderBy("tradable").collect() == [(False, 1), (True, 12)]
