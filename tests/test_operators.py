"""Operators on small tables with results worked out by hand."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import rolling as R
from tidepanel.functions import scalars as S
from tidepanel.operators import align, clean, cointegration, reports, signals, stats, trades, universe, validation
from tidepanel.sources import panel

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def closes(spark, **series):
    rows = [(s, day(i), None if v is None else float(v)) for s, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "symbol string, ts date, close double")


def column(df, name, symbol="A"):
    return [r[name] for r in df.where(F.col("symbol") == symbol).orderBy("ts").collect()]


def test_gaps_of_a_random_mask_rebuild_it(spark):
    rng = np.random.default_rng(5)
    mask = rng.random(120) < 0.4
    runs = clean.null_runs(closes(spark, A=[None if m else 1 for m in mask])).collect()
    rebuilt = np.zeros(120, bool)
    for r in runs:
        rebuilt[(r.start - D0).days : (r.end - D0).days + 1] = True
    assert (rebuilt == mask).all()


def test_fill_carries_inner_gaps_only(spark):
    df = clean.causal_fill(closes(spark, A=[None, 1, None, None, 2, None, None, None, 3, None]), 2)
    assert column(df, "close") == [None, 1, 1, 1, 2, None, None, None, 3, None]


def test_spike_and_reversal_are_scrubbed(spark):
    values = (100 * np.exp(np.cumsum(np.random.default_rng(2).normal(0, 0.01, 40)))).tolist()
    values[30] *= 10
    out = column(clean.scrub_outliers(closes(spark, A=values)), "close")
    assert [i for i, v in enumerate(out) if v is None] == [30, 31]


def test_clip_walks_on_from_the_clipped_value(spark):
    assert column(clean.clip_returns(closes(spark, A=[100, 200, 200, None, 200]), 0.1), "close") == [100, pytest.approx(110), pytest.approx(121), None, pytest.approx(133.1)]


def test_ohlc_mask_rules(spark):
    rows = [("A", D0, 10.0, 9.0, 11.0, 10.0), ("A", day(1), 10.0, 9.5, 9.0, 9.2), ("A", day(2), 10.0, 12.0, 11.0, 11.5), ("A", day(3), 10.0, 12.0, 9.0, 11.0)]
    out = clean.mask_ohlc(spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double"))
    assert column(out, "rule") == ["high_below_low", "high_too_low", "low_too_high", None]


def test_asof_stops_at_the_last_row_or_looks_further(spark):
    prices = closes(spark, A=[1, None, 3])
    asks = spark.createDataFrame([("A", day(1), 7), ("A", day(9), 8), ("B", day(1), 9)], "symbol string, at date, k int")
    get = lambda skip: {r.k: r.close for r in align.asof(asks, prices, "close", "at", skip_null=skip).collect()}
    assert get(False) == {7: None, 8: 3, 9: None}
    assert get(True) == {7: 1, 8: 3, 9: None}


def test_calendar_map(spark):
    cal = spark.createDataFrame([(day(0),), (day(4),)], "ts date")
    days = spark.createDataFrame([(day(i),) for i in range(5)], "d date")
    for how, want in (("prior", [0, 0, 0, 0, 4]), ("next", [0, 4, 4, 4, 4]), ("nearest", [0, 0, 0, 4, 4])):
        got = align.map_to_calendar(days, "d", cal, how).orderBy("d").collect()
        assert [(r.session - D0).days for r in got] == want


def test_past_zscore_excludes_today(spark):
    x = [1.0, 2, 3, 4, 50, 6]
    got = column(closes(spark, A=x).withColumn("z", R.past_zscore(F.col("close"), 4, 2)), "z")
    want = [None, None] + [(x[i] - np.mean(x[max(0, i - 4) : i])) / np.std(x[max(0, i - 4) : i]) for i in range(2, 6)]
    assert got[:2] == [None, None] and got[2:] == pytest.approx(want[2:])


@pytest.mark.parametrize("n,buckets", [(11, 3), (8, 4), (12, 5)])
def test_rank_bucket_is_qcut_of_ranks(spark, n, buckets):
    # sizes whose cut points fall between ranks; on a rank itself floating edges may go either way
    df = spark.createDataFrame([(i,) for i in range(n)], "v int").withColumn("b", R.rank_bucket(["v"], buckets))
    want = pd.qcut(pd.Series(range(n)).rank(method="first"), buckets, labels=False) + 1
    assert [r.b for r in df.orderBy("v").collect()] == want.tolist()


@pytest.mark.parametrize("n,w,step", [(10, 4, 3), (5, 5, 2), (3, 4, 1)])
def test_hopping_windows(spark, n, w, step):
    out = stats.hopping(closes(spark, A=range(n)), w, step)
    got = {}
    for r in out.collect():
        got.setdefault(r.window_id, set()).add((r.ts - D0).days)
    assert got == {k: set(range(s, s + w)) for k, s in enumerate(range(0, n - w + 1, step))}


def test_ledoit_wolf_shrinks_towards_the_identity():
    x = np.random.default_rng(0).normal(size=(30, 8))
    s = np.cov(x.T, bias=True)
    lw = stats.ledoit_wolf(x)
    assert np.trace(lw) == pytest.approx(np.trace(s))
    assert np.linalg.cond(lw) < np.linalg.cond(s)


def test_false_discovery_counts_grow_with_alpha(spark):
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.001, 0.01, 0.02, 0.04, 0.2, 0.5, 0.9])], "i int, p double")
    n = lambda a, dep=False: stats.false_discovery(p, "p", a, dep).where("rejected").count()
    assert n(0.05) == 3 and n(0.05) <= n(0.10) and n(0.05, True) <= n(0.05)


def test_cointegrated_pair_is_found(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=400)) + 50
    y = 2 * x + rng.normal(size=400)
    z = np.cumsum(rng.normal(size=400)) + 50
    rows = [("in", day(i), float(y[i]), float(x[i])) for i in range(400)] + [("out", day(i), float(z[i]), float(x[i])) for i in range(400)]
    out = {r.pair: r.level for r in cointegration.levels(cointegration.engle_granger(spark.createDataFrame(rows, "pair string, ts date, y double, x double"))).collect()}
    assert out["in"] == 0.01 and out["out"] > 0.05


def test_state_machine(spark):
    z = [0, 2.5, 1, 0.2, 2.5, 0, 0, 0, 0, 2.5, 5, None]
    df = spark.createDataFrame([("A", day(i), None if v is None else float(v)) for i, v in enumerate(z)], "symbol string, ts date, z double")
    assert column(signals.positions(df), "pos") == [0, -1, -1, 0, 0, 0, 0, 0, 0, -1, 0, 0]


def states(spark, *z, **options):
    df = spark.createDataFrame([("A", day(i), None if v is None else float(v)) for i, v in enumerate(z)], "symbol string, ts date, z double")
    return column(signals.positions(df, **options), "pos"), [(r.side, (r.ts - D0).days) for r in signals.entries(df, 2.0, 4.0).orderBy("ts").collect()]


def test_entry_compares_the_signed_value_before(spark):
    assert states(spark, None, 2.5, 2.6) == ([0, -1, -1], [(-1, 1)])  # nothing before: enters
    assert states(spark, 5, 3, 2.5) == ([0, 0, 0], [])  # back from beyond the stop: does not
    assert states(spark, -2.5, 2.5, 2.4) == ([1, 0, 0], [(1, 0), (-1, 1)])  # from one side to the other: an entry; the open position leaves there
    assert states(spark, 4, -4, -3) == ([0, 0, 0], [])


def test_opposite_level_closes_and_a_change_of_sign_does_not(spark):
    assert states(spark, -2.5, 1.5, 1.9, 2.0, 0)[0] == [1, 1, 1, 0, 0]
    assert states(spark, 2.5, -1.5, -2.5, 0)[0] == [-1, -1, 0, 0]


def test_cooldown_counts_whole_rows_and_holding_ends(spark):
    assert states(spark, 2.5, 0, 2.5, 0, 2.5, cooldown=2)[0] == [-1, 0, 0, 0, -1]
    assert states(spark, 2.5, 0, 2.5, 0, 2.5, cooldown=0)[0] == [-1, 0, -1, 0, -1]
    assert states(spark, 2.5, 1, 1, 1, max_hold=2, cooldown=0)[0] == [-1, -1, 0, 0]
    assert states(spark, 2.5, None, 1, cooldown=0)[0] == [-1, 0, 0] and states(spark, 2.5, None, 1, nan_holds=True)[0] == [-1, -1, -1]


def test_exits_count_rows_not_days(spark):
    z = [(0, 2.5), (1, 1.0), (10, 1.5), (30, 1.2), (31, 0.1)]
    df = spark.createDataFrame([("A", day(i), v) for i, v in z] + [("B", day(0), 3.0), ("C", day(0), 2.2), ("C", day(1), -2.0)], "symbol string, ts date, z double")
    opened = df.where("ts = date'%s'" % day(0)).select("symbol", F.col("ts").alias("entry_ts"), F.lit(-1).alias("side"))
    end = lambda n: {r.symbol: (r.exit_ts - D0).days for r in signals.exit_hits(opened, df, 2.0, 0.5, 4.0, n).collect()}
    assert end(3) == {"A": 30, "B": 0, "C": 1} and end(20) == {"A": 31, "B": 0, "C": 1}


def test_markov_bins_and_smoothing(spark):
    z = spark.createDataFrame([("A", day(i), v) for i, v in enumerate([-1.5, -0.5, 0.5, 1.5, -1.4, 1.4])], "symbol string, ts date, z double")
    assert column(z.withColumn("s", S.markov_state(F.col("z"))), "s") == [-2, 0, 0, 2, -1, 1]
    rows = signals.transitions(z, smoothing=1.0).collect()
    assert len(rows) == 20 and {round(sum(r.share for r in rows if r.state == s), 9) for s in (-2, 0, 2, -1)} == {1.0}


def test_hit_probability_against_matrix_power(spark):
    rng = np.random.default_rng(3)
    z = spark.createDataFrame([(k, day(i), float(v)) for k in "AB" for i, v in enumerate(rng.normal(size=200) * 1.5)], "symbol string, ts date, z double")
    moves = signals.transitions(z, by=("symbol",))
    for k in "AB":
        m = np.zeros((5, 5))
        for r in moves.where(F.col("symbol") == k).collect():
            m[r.state + 2, r.next_state + 2] = r.share
        m[2] = np.eye(5)[2]
        want = np.linalg.matrix_power(m, 10)[:, 2]
        got = {r.state: r.p for r in signals.hit_probability(moves, 10, ("symbol",)).where(F.col("symbol") == k).collect()}
        assert np.allclose([got[i] for i in range(-2, 3)], want)


def test_calendar_map_beyond_its_ends(spark):
    cal = spark.createDataFrame([(day(10),), (day(17),)], "ts date")
    days = spark.createDataFrame([(day(i),) for i in (3, 12, 18, 900)] + [(None,)], "d date")
    get = lambda how: {r.d and (r.d - D0).days: r.session and (r.session - D0).days for r in align.map_to_calendar(days, "d", cal, how).collect()}
    assert get("prior") == {3: None, 12: 10, 18: 17, 900: 17, None: None}
    assert get("next") == {3: 10, 12: 17, 18: None, 900: None, None: None}
    assert get("nearest") == {3: 10, 12: 10, 18: 17, 900: 17, None: None}


def test_junk_symbols_by_their_ends(spark):
    df = spark.createDataFrame([(s,) for s in ("X-RAY", "A-PLUS", "CONTEST", "ABC-W", "abc.u", "$X", "A^B", "AB-PA")], "s string")
    assert [r[0] for r in df.select(universe.is_junk(F.col("s"))).collect()] == [False, False, False, True, True, True, True, True]


def test_fingerprint_sees_repeated_rows(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert validation.fingerprint(a).first() != validation.fingerprint(a.where("x = 1").union(spark.createDataFrame([(3,), (3,)], "x int"))).first()


def test_edges_and_open_trades(spark):
    pos = spark.createDataFrame([("A", day(i), p) for i, p in enumerate([0, 1, 1, 0, -1, 1, 1])], "symbol string, ts date, pos int")
    got = [(r.side, (r.entry_ts - D0).days, r.exit_ts and (r.exit_ts - D0).days) for r in trades.edges(pos).orderBy("entry_ts").collect()]
    assert got == [(1, 1, 3), (-1, 4, 5), (1, 5, None)]


def test_mark_to_market_total(spark):
    bars = closes(spark, AAA=[100, 105, 110], BBB=[50, 49, 48])
    t = spark.createDataFrame([(1, "AAA", D0, day(2), 1, 1.0, 100.0), (2, "BBB", D0, day(2), -1, 1.0, 50.0)], "trade_id long, symbol string, entry_date date, exit_date date, side int, qty double, exec_px double")
    pnl = trades.daily_pnl(trades.daily_values(t, bars))
    assert pnl.agg(F.sum("pnl")).first()[0] == pytest.approx(12.0)


def test_borrow_of_a_short(spark):
    bars = closes(spark, X=[100, 110, 90])
    t = spark.createDataFrame([(1, "X", dt.date(2019, 12, 31), day(2), -1, 10.0, 100.0)], "trade_id long, symbol string, entry_date date, exit_date date, side int, qty double, exec_px double")
    cost = trades.borrow_cost(trades.daily_values(t, bars), 0.10).first()
    assert cost.borrow == pytest.approx(-(0.10 / 360) * (1000 + 1100 + 900))


def test_ledger_depends_on_what_was_kept(spark):
    spans = [(0, 5), (3, 12), (6, 8), (8, 9), (9, 11)]
    t = spark.createDataFrame([(i, "A", day(a), day(b)) for i, (a, b) in enumerate(spans)], "trade_id long, symbol string, entry_date date, exit_date date")
    assert sorted(r.trade_id for r in trades.ledger(t).collect()) == [0, 2, 4]


def test_overfit_symmetric_case(spark):
    s = spark.createDataFrame([(0, "a", 3.0, 1.0), (0, "b", 2.0, 2.0), (0, "c", 1.0, 3.0), (1, "a", 3.0, 3.0), (1, "b", 2.0, 2.0), (1, "c", 1.0, 1.0)], "fold int, model string, is_score double, oos_score double")
    assert reports.overfit_probability(s).first().pbo == 0.5


def test_gini(spark):
    v = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (8.0,)], "v double")
    assert reports.concentration(v, "v").first().gini == pytest.approx(0.75)


def test_monthly_returns_beyond_a_total_loss(spark):
    """Days that lose more than all, all, or start from zero, beside a month as usual, and what DuckDB says to the same rows."""
    import duckdb

    rows = [(1, 10.0, 110.0), (1, -11.0, 99.0), (2, -150.0, -50.0), (2, 20.0, -30.0), (3, -100.0, 0.0), (3, 5.0, 105.0), (4, 7.0, 7.0), (5, -7.0, -7.0), (6, 0.0, 0.0), (7, -50.0, -100.0), (8, None, None)]
    days = spark.createDataFrame([(dt.date(2020, m, i + 1), p, e) for i, (m, p, e) in enumerate(rows)], "day date, pnl double, equity double")
    got = {r.month: r.ret for r in reports.monthly(days).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (m INT, pnl DOUBLE, equity DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT m, exp(sum(ln(1 + pnl / (equity - pnl)))) - 1 FROM t GROUP BY m").fetchall())
    assert got == pytest.approx(want, nan_ok=True)
    assert got[1] == pytest.approx(-0.01) and np.isnan(got[2]) and got[3] == -1 and got[4] == np.inf and got[7] == 1 and got[8] is None


def test_symbols(spark):
    df = spark.createDataFrame([(" brk/b",), ("abc.to",), ("a.b",), (None,)], "s string")
    assert [r[0] for r in df.select(S.normalize_symbol(F.col("s"))).collect()] == ["BRK-B", "ABC.TO", "A-B", None]


def test_csv_reader(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Ticker,Date,Adj_Close\na,2020-01-01,1.5\nb,bad,2\nc,2020-01-02,inf\n")
    rows = panel.read_prices(spark, str(tmp_path / "p.csv"), "csv").orderBy("symbol").collect()
    assert [(r.symbol, r.price) for r in rows] == [("A", 1.5), ("C", None)]


def test_panel_round_trip_prunes_partitions(spark, tmp_path):
    panel.write_panel(closes(spark, A=[1, 2], B=[3]), str(tmp_path / "t"), by_symbol=True)
    assert spark.read.parquet(str(tmp_path / "t")).where("symbol = 'B'").count() == 1
