"""Hand-computed cases of trade logs, fills, universe rules, gap fills and curves."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import book, clean, fills, reports, stats, universe

D0 = dt.date(2021, 1, 4)  # a Monday


def day(i):
    return D0 + dt.timedelta(days=i)


def test_weekdays_against_numpy(spark):
    rows = [(day(i), day(i + n)) for i in range(7) for n in range(-3, 20)]
    out = spark.createDataFrame(rows, "a date, b date").select("a", "b", book.weekdays_between(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == max(0, np.busday_count(r.a, r.b)) for r in out)


def test_log_without_times_or_rows(spark):
    assert book.normalize(spark.createDataFrame([(1, "x")], "k int, start_px string"), "P").count() == 0
    empty = spark.createDataFrame([], "entry_date string, exit_date string")
    assert book.holding_days(book.normalize(empty)).count() == 0
    one = spark.createDataFrame([("2021-01-08", "2021-01-08", None, "BLOCKED")], "start string, end string, exit_date string, exec_entry_status string")
    assert book.holding_days(book.normalize(one)).first().holding_days == 0


def test_cost_semantics_and_finalize(spark):
    rows = [(100.0, -1.0, 2.0, -3.0, False), (100.0, None, 2.0, 3.0, True)]
    df = spark.createDataFrame(rows, "gross_pnl double, fee double, slippage double, impact double, exec_diag_costs_only boolean")
    told = book.cost_semantics(book.cost_columns(df)).collect()
    assert [(r.total_costs, r.execution_diagnostic_costs, r.net_pnl) for r in told] == [(-2.0, 0.0, 98.0), (0.0, 5.0, 100.0)]
    final = book.finalize(df).collect()
    assert [(r.slippage_cost, r.impact_cost, r.total_costs, r.costs, r.net_pnl) for r in final] == [(-2.0, -3.0, -6.0, 6.0, 94.0), (-2.0, -3.0, 0.0, 0.0, 100.0)]


def test_net_without_gross(spark):
    df = book.cost_columns(spark.createDataFrame([(10.0, -2.0)], "net_pnl double, fees double"))
    r = book.cost_semantics(df).first()
    assert (r.gross_pnl, r.net_pnl) == (12.0, 10.0)


def test_leg_notionals_take_the_first_complete_set(spark):
    cols = "notional_y double, notional_x double, y_units double, x_units double, price_y double, price_x double, size double, gross_notional double, signal double"
    rows = [(5.0, -6.0, 1.0, 1.0, 2.0, 2.0, 9.0, 9.0, 1.0), (5.0, None, 3.0, -4.0, 2.0, 2.5, 9.0, 9.0, 1.0), (None, None, 3.0, None, 2.0, 2.5, 4.0, 9.0, -1.0), (None,) * 7 + (8.0, None), (None,) * 9]
    out = book.leg_notionals(spark.createDataFrame(rows, cols)).collect()
    assert [(r.notional_1, r.notional_2, r.gross_notional) for r in out] == [(5, -6, 11), (6, -10, 16), (-8, 10, 18), (4, -4, 8), (0, 0, 0)]


def test_rate_in_force(spark):
    rates = spark.createDataFrame([("A", day(2), 0.1), ("A", day(5), -1.0), ("A", day(7), 0.2)], "symbol string, ts date, rate double")
    asks = spark.createDataFrame([("A", day(i)) for i in range(9)] + [("B", day(3)), ("A", None)], "symbol string, d date")
    out = {(r.symbol, r.d): r.rate for r in book.rate_on(asks, rates, "d", 0.03).collect()}
    assert [out["A", day(i)] for i in range(9)] == [0.03, 0.03, 0.1, 0.1, 0.1, 0.03, 0.03, 0.2, 0.2] and out["B", day(3)] == 0.03 and out["A", None] == 0.03


def test_fills_of_an_order(spark):
    t = dt.datetime(2021, 1, 4, 10)
    rows = [(1, "buy", 10.0, 100.0, "M", t, 99.0, 100.5, t - dt.timedelta(seconds=2)), (1, "buy", 10.0, 98.0, "t", t, 99.0, 100.5, t), (1, "buy", -5.0, 1.0, "M", t, 99.0, 100.5, t), (1, "buy", 5.0, None, "M", t, 99.0, 100.5, t)]
    df = spark.createDataFrame(rows, "o int, side string, qty double, price double, liquidity string, ts timestamp, ref double, mid double, order_ts timestamp")
    r = fills.fees(df, ["o"], -1.0, 2.0).first()
    assert (r.fees, r.maker_fills, r.taker_fills) == (pytest.approx(0.1 - 0.196), 1, 1) and fills.fees(df, ["o"], -1.0, 2.0, 5.0).first().fees == -5.0
    e = fills.execution(df, ["o"], 0.01).first()
    assert (e.vwap, e.slippage, e.slippage_ticks, e.ms_to_fill) == (99.0, 10.0, 50.0, 2000.0) and e.spread_bps == pytest.approx((100.5 - 99) / 100.5 * 1e4)


def test_annual_factor(spark):
    for step, want in ((1, 252), (7, 52), (30, 12), (91, 4), (365, 1), (50, 252)):
        assert fills.annual_factor(spark.createDataFrame([(day(i * step),) for i in range(5)], "ts date")).first()[0] == want


def plain_fill(x, tradable, max_gap, hard=False):
    """Walk over the rows of one symbol; of other gaps only what was read counts."""
    y = np.array([np.nan if v is None else v for v in x], float)
    out, i, removed = y.copy(), 0, False
    while i < len(x):
        if x[i] is not None or not tradable[i]:
            i += 1
            continue
        j = i
        while j < len(x) and x[j] is None and tradable[j]:
            j += 1
        n, left, right = j - i, y[i - 1] if i else np.nan, y[j] if j < len(x) else np.nan
        v = None
        if n == 1 <= max_gap and (left == left or right == right):
            v = [np.nanmean([left, right])]
        elif n <= max_gap and left == left and right == right:
            v = np.linspace(left, right, n + 2)[1:-1] if n == 2 else clean.smooth_level(out[max(0, i - 5) : j + 5])[i - max(0, i - 5) :][:n]
        if v is not None:
            out[i:j] = v
        elif hard and i > 0 and j < len(x):
            removed = True
            break
        i = j
    return [None if a != a else float(a) for a in out], removed


def test_safe_fill_against_a_walk(spark):
    rng = np.random.default_rng(2)
    for seed in range(3):
        x = [None if rng.random() < 0.4 else round(float(100 + rng.normal()), 3) for _ in range(120)]
        ok = [bool(rng.random() < 0.9) for _ in x]
        df = spark.createDataFrame([("A", day(i), v, t) for i, (v, t) in enumerate(zip(x, ok, strict=True))], "symbol string, ts date, close double, tradable boolean")
        for hard in (False, True):
            rows = clean.safe_fill(df, 4, hard_drop=hard).orderBy("ts").collect()
            want, removed = plain_fill(x, ok, 4, hard)
            assert all((r.close is None) == (w is None) and (w is None or abs(r.close - w) < 1e-9) for r, w in zip(rows, want, strict=True))
            assert {r.removed for r in rows} == {removed} and {r.method for r in rows if r.method} <= set(clean.FILLS)


def test_level_smoother_fills_the_leading_run():
    y = clean.smooth_level(np.array([np.nan, np.nan, 1.0, np.nan, 3.0]))
    assert y[0] == y[1] == y[2] and y[2] < y[3] < 3.0 and np.isnan(clean.smooth_level(np.array([np.nan]))).all()


def test_events_once_and_in_order(spark):
    df = spark.createDataFrame([("B", day(1), 1.0, True), ("A", day(1), 2.0, True), ("A", day(0), 3.0, None)], "symbol string, ts date, close double, hit boolean")
    one = clean.events(df, "hit", "s", "close", "r", "warn", "null")
    assert [(r.symbol, r.value_close) for r in clean.event_log(one, one).collect()] == [("A", 2.0), ("B", 1.0)]


def test_float_share_sources(spark):
    cols = "float_shares double, shares_out double, shares_short double, short_of_float double, insiders double, institutions double, institutions_of_float double"
    rows = [(5.0, 10.0, 1.0, 0.5, 0.1, 0.2, 0.3), (50.0, 10.0, 1.0, 0.2, 0.1, 0.2, 0.3), (None, 10.0, None, 0.2, 0.3, None, 0.9), (None,) * 7, (None, 0.0, None, None, None, 1.4, None)]
    out = universe.float_share(spark.createDataFrame(rows, cols)).collect()
    assert [(r.float_pct, r.float_source) for r in out] == [(0.5, "native"), (0.5, "derived"), (0.7, "conservative"), (None, "low_confidence"), (1.0, "conservative")]


def test_periods():
    with pytest.raises(ValueError):
        universe.shift_period(F.lit(D0), "3h")


def test_nearest_positive_matrix():
    bad = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    good = stats.nearest_positive(bad)
    assert np.linalg.eigvalsh(good).min() > 0 and np.array_equal(good, good.T) and np.allclose(stats.nearest_positive(np.eye(3)), np.eye(3))


def test_precision_recall_by_trapezoids(spark):
    rng = np.random.default_rng(0)
    s, y = np.round(rng.random(400), 2), rng.integers(0, 2, 400)
    pts = [(y[s >= c].sum() / y.sum(), y[s >= c].mean()) for c in sorted(set(s), reverse=True)]
    want = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts[:-1], pts[1:], strict=True))
    got = reports.precision_recall(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int"), "s", "y").first()
    assert got.auc_pr == pytest.approx(want) and got.n_points == len(pts)
