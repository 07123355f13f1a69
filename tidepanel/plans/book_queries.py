"""Queries over trade logs and fills: names, legs, costs, borrow, execution; each has its SQL beside it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidepanel.operators import book, fills
from tidepanel.plans.panel_queries import rounded
from tidepanel.sources.panel import BARS, TRADES, bars, table, trades

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def cents(x: str) -> str:
    """Exact sum of x in whole ten-thousandths."""
    return f"CAST(sum(CAST(round(({x}) * 10000) AS BIGINT)) AS BIGINT) / 10000"


#: Weekdays in [entry_date, exit_date).
WEEKDAYS = "len(list_filter(range(0, greatest(exit_date - entry_date, 0)), lambda i: isodow(entry_date + CAST(i AS INT)) < 6))"


@query(f"""WITH {TRADES}, g AS (SELECT * FROM trades WHERE trade_id % 17 <> 0 AND trade_id % 19 <> 0)
SELECT trade_id, CAST(entry_date AS TIMESTAMP) AS entry_date, CAST(exit_date AS TIMESTAMP) AS exit_date, 'P-Q' AS pair, CAST(CASE WHEN trade_id % 23 = 0 THEN 0 ELSE greatest(1, {WEEKDAYS}) END AS INT) AS holding_days FROM g""")
def normalized_trades(spark, sf_dir):
    """A log whose times stand under other names, some missing or unreadable."""
    k = F.col("trade_id")
    log = trades(spark, sf_dir).select(
        "trade_id", F.lit(None).cast("string").alias("entry_dt"), F.when(k % 17 == 0, None).when(k % 19 == 0, "bad").otherwise(F.col("entry_date").cast("string")).alias("open_time"),
        F.col("exit_date").cast("string").alias("fill_ts"), F.when(k % 23 == 0, "Blocked").otherwise("ok").alias("exec_entry_status"),
    )
    return book.holding_days(book.normalize(log, "P-Q")).select("trade_id", "entry_date", "exit_date", "pair", "holding_days")


@query(f"""WITH {BARS}, {TRADES}, t AS (SELECT trade_id, entry_date, CASE WHEN trade_id % 3 = 0 THEN entry_date - 1 ELSE exit_date END AS exit_date FROM trades), cal AS (SELECT ts, coalesce(lead(ts) OVER (ORDER BY ts), ts) AS nx FROM (SELECT DISTINCT ts FROM bars WHERE isodow(ts) < 6))
SELECT trade_id, entry_date, CASE WHEN exit_date > entry_date THEN exit_date ELSE coalesce(nx, exit_date) END AS exit_date FROM t ASOF LEFT JOIN cal ON cal.ts >= t.entry_date""")
def exits_after_entries(spark, sf_dir):
    t = trades(spark, sf_dir).select("trade_id", "entry_date", F.when(F.col("trade_id") % 3 == 0, F.date_sub("entry_date", 1)).otherwise(F.col("exit_date")).alias("exit_date"))
    return book.exit_after_entry(t, bars(spark, sf_dir).where(F.weekday("ts") < 5).select("ts"))


END = dt.date(1998, 12, 31)


@query(f"""WITH {BARS}, {TRADES}, l AS (SELECT symbol, arg_max(close, ts) AS px FROM bars WHERE ts <= DATE '1998-12-31' GROUP BY symbol), t AS (SELECT *, side * qty * (arrival_px - exec_px) AS g, exit_date > DATE '1998-12-31' AS hard FROM trades WHERE entry_date <= DATE '1998-12-31')
SELECT trade_id, least(exit_date, DATE '1998-12-31') AS exit_date, hard AS hard_exit, round(CASE WHEN hard AND px IS NOT NULL THEN px ELSE arrival_px END, 9) AS exit_px, round((CASE WHEN hard AND px IS NOT NULL THEN side * qty * (px - exec_px) ELSE g END) * 10000) / 10000 + 0 AS gross_pnl FROM t LEFT JOIN l ON l.symbol = t.symbol""")
def trades_clipped(spark, sf_dir):
    """Trades still open at the end of 1998 close there, at the last close."""
    t = trades(spark, sf_dir).withColumns({"exit_px": F.col("arrival_px"), "gross_pnl": F.col("side") * F.col("qty") * (F.col("arrival_px") - F.col("exec_px"))})
    out = book.clip_to_end(t, END, bars(spark, sf_dir).select("symbol", "ts", "close"))
    return rounded(out.select("trade_id", "exit_date", "hard_exit", "exit_px", (F.round(F.col("gross_pnl") * 10000) / 10000).alias("gross_pnl")), 9)


def leg_log(spark, sf_dir):
    """Pair trades that tell their size in four ways."""
    k = F.col("trade_id")
    way = lambda i, x: F.when(k % 5 == i, x)
    return trades(spark, sf_dir).select(
        "trade_id", F.col("symbol").alias("y_symbol"), F.lower("venue").alias("x_symbol"), F.when(k % 3 > 0, F.col("side").cast("double")).alias("signal"),
        way(0, F.col("qty") * F.col("exec_px")).alias("notional_y"), way(0, -F.col("qty") * F.col("arrival_px")).alias("notional_x"),
        way(1, F.col("qty") * F.col("side")).alias("y_units"), way(1, F.col("qty") * -2).alias("x_units"),
        F.when(k % 5 < 3, F.col("exec_px")).alias("price_y"), F.when(k % 5 < 3, F.col("arrival_px").cast("string")).alias("price_x"),
        way(2, F.col("qty")).alias("qty"), way(3, F.col("qty") * 100).alias("gross_notional"),
    )


LEGS = f"""{TRADES}, legs AS (SELECT trade_id, symbol AS y_symbol, lower(venue) AS x_symbol, CASE WHEN trade_id % 3 > 0 AND side < 0 THEN -1.0 ELSE 1.0 END AS sg, trade_id % 5 AS w, qty, side, exec_px, arrival_px FROM trades),
sized AS (SELECT *, CASE w WHEN 0 THEN qty * exec_px WHEN 1 THEN qty * side * exec_px WHEN 2 THEN abs(qty * exec_px) * sg WHEN 3 THEN qty * 100 / 2 * sg ELSE 0.0 END AS n1,
CASE w WHEN 0 THEN -qty * arrival_px WHEN 1 THEN qty * -2 * arrival_px WHEN 2 THEN -abs(qty * arrival_px) * sg WHEN 3 THEN -qty * 100 / 2 * sg ELSE 0.0 END AS n2 FROM legs)"""


@query(f"WITH {LEGS} SELECT trade_id, round(n1, 6) + 0 AS notional_1, round(n2, 6) + 0 AS notional_2, round(CASE WHEN w = 3 THEN qty * 100 ELSE abs(n1) + abs(n2) END, 6) AS gross_notional FROM sized")
def leg_payloads(spark, sf_dir):
    return rounded(book.leg_notionals(leg_log(spark, sf_dir)).select("trade_id", "notional_1", "notional_2", "gross_notional"))


@query(f"""WITH {LEGS} SELECT trade_id, CASE WHEN w IN (0, 3) THEN upper(CASE WHEN sg > 0 THEN x_symbol ELSE y_symbol END) END AS short_symbol,
round(CASE w WHEN 0 THEN CASE WHEN sg > 0 THEN qty * arrival_px ELSE qty * exec_px END WHEN 3 THEN qty * 50 ELSE 0.0 END, 6) AS short_notional FROM sized""")
def short_legs(spark, sf_dir):
    return rounded(book.short_leg(leg_log(spark, sf_dir)).select("trade_id", "short_symbol", "short_notional"))


def cost_log(spark, sf_dir):
    value, k = F.col("qty") * F.col("exec_px"), F.col("trade_id")
    return trades(spark, sf_dir).select(
        "trade_id", "symbol", "exit_date", (F.col("side") * F.col("qty") * (F.col("arrival_px") - F.col("exec_px"))).alias("gross_pnl"), F.when(k % 7 > 0, -value * 0.001).alias("commission"),
        (value * 0.0004).cast("string").alias("slippage"), (-value * 0.0002).alias("market_impact"), (value * F.col("rate") / 100).alias("borrow"), (value * 0.0001).alias("realized_spread"),
        F.when(k % 4 > 0, k % 4 == 1).alias("exec_diag_costs_only"), F.when(k % 50 == 0, 2.5).alias("buyin_penalty_cost"),
    )


COST = f"""{TRADES}, v AS (SELECT *, qty * exec_px AS value FROM trades), cost AS (SELECT trade_id, symbol, exit_date, side * qty * (arrival_px - exec_px) AS gross_pnl, CASE WHEN trade_id % 7 > 0 THEN -value * 0.001::DOUBLE ELSE 0.0 END AS fees, value * 0.0004::DOUBLE AS slippage_cost,
-value * 0.0002::DOUBLE AS impact_cost, value * rate / 100 AS borrow_cost, value * 0.0001::DOUBLE AS spread, trade_id % 4 = 1 AS shown, CASE WHEN trade_id % 50 = 0 THEN 2.5 ELSE 0.0 END AS buyin_penalty_cost FROM v)"""
FULL = f"""{COST}, total AS (SELECT *, 0.0::DOUBLE AS exec_emergency_penalty_cost, CASE WHEN shown THEN slippage_cost + impact_cost ELSE 0.0 END AS execution_diagnostic_costs,
fees + borrow_cost + buyin_penalty_cost + CASE WHEN shown THEN 0.0 ELSE slippage_cost + impact_cost END AS total_costs FROM cost), netted AS (SELECT *, gross_pnl + total_costs AS net_pnl FROM total)"""
SUMS = ", ".join(f"{cents(c)} AS {c}" for c in book.SUMS)


@query(f"WITH {FULL} SELECT symbol, exit_date, {SUMS}, count(net_pnl) AS trades FROM netted GROUP BY ALL")
def cost_breakdown(spark, sf_dir):
    """All cost components by symbol and day, under the log's own names."""
    return book.components(book.cost_semantics(book.cost_columns(cost_log(spark, sf_dir))), ["symbol", "exit_date"])


@query(f"""WITH {COST}, f AS (SELECT *, -abs(slippage_cost) AS s, -abs(impact_cost) AS i, -abs(borrow_cost) AS b, -abs(buyin_penalty_cost) AS p FROM cost), t AS (SELECT *, fees + CASE WHEN shown THEN 0.0 ELSE s + i END + b + p AS total_costs FROM f)
SELECT symbol, {cents('s')} AS slippage_cost, {cents('b')} AS borrow_cost, {cents('total_costs')} AS total_costs, {cents('abs(total_costs)')} AS costs, {cents('gross_pnl + total_costs')} AS net_pnl FROM t GROUP BY symbol""")
def finalized_costs(spark, sf_dir):
    out = book.finalize(cost_log(spark, sf_dir))
    exact = lambda c: (F.sum(F.round(F.col(c) * 10000).cast("long")) / 10000).alias(c)
    return out.groupBy("symbol").agg(*[exact(c) for c in ("slippage_cost", "borrow_cost", "total_costs", "costs", "net_pnl")])


@query(f"""WITH {COST} SELECT count(*) AS n, CAST(count(*) FILTER (exit_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') AS BIGINT) AS n_eval, {cents("CASE WHEN exit_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN gross_pnl ELSE 0 END")} AS gross FROM cost""")
def evaluated_trades(spark, sf_dir):
    log = cost_log(spark, sf_dir)
    inside = book.closed_in(log, dt.date(1997, 1, 1), END).agg(F.count(F.lit(1)).alias("n_eval"), (F.sum(F.round(F.col("gross_pnl") * 10000).cast("long")) / 10000).alias("gross"))
    return log.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(inside)).select("n", "n_eval", "gross")  # one row each


@query(f"WITH {BARS} SELECT DISTINCT ts AS day, 1000000.0::DOUBLE AS equity, 0.0::DOUBLE AS returns, 0.0::DOUBLE AS drawdown FROM bars")
def flat_equity(spark, sf_dir):
    return book.flat_equity(bars(spark, sf_dir).select("ts").distinct(), 1e6)


RATES = """rates AS (SELECT symbol, ts, CASE WHEN day(ts) = 15 THEN -1.0 ELSE (day(ts) % 9) / 100.0::DOUBLE END AS rate FROM bars WHERE day(ts) % 5 = 0)"""


def rate_series(spark, sf_dir):
    day = F.dayofmonth("ts")
    return bars(spark, sf_dir).where(day % 5 == 0).select("symbol", "ts", F.when(day == 15, -1.0).otherwise((day % 9) / 100.0).alias("rate"))


@query(f"""WITH {BARS}, {TRADES}, {RATES} SELECT trade_id, round(CASE WHEN r.rate >= 0 THEN r.rate ELSE 0.03 END, 6) AS rate FROM trades t ASOF LEFT JOIN rates r ON r.symbol = t.symbol AND r.ts <= t.entry_date""")
def borrow_rates(spark, sf_dir):
    """The borrow rate in force on each trade's entry day."""
    t = trades(spark, sf_dir).select("trade_id", "symbol", "entry_date")
    return rounded(book.rate_on(t, rate_series(spark, sf_dir), "entry_date", 0.03).select("trade_id", "rate"))


@query(f"""WITH {BARS}, {TRADES}, {RATES}, s AS (SELECT t.*, CASE WHEN r.rate >= 0 THEN r.rate ELSE 0.03 END AS br FROM trades t ASOF LEFT JOIN rates r ON r.symbol = t.symbol AND r.ts <= t.entry_date WHERE side < 0),
d AS (SELECT -br / 252 * abs(qty * exec_px) AS b, CAST(unnest(generate_series(CAST(entry_date + 1 AS TIMESTAMP), CAST(exit_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM s WHERE br > 0) SELECT day, {cents('b')} AS borrow FROM d WHERE isodow(day) < 6 GROUP BY day""")
def borrow_series(spark, sf_dir):
    """Daily borrow cost over all short trades."""
    return book.by_day(book.borrow_daily(trades(spark, sf_dir), rate_series(spark, sf_dir), 0.03), "borrow")


@query("SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day FROM events")
def settle_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", book.settle_day(F.col("ts")).alias("day"))


def order_fills(spark, sf_dir):
    """Line items as fills of their order: every fifth without a quantity, makers by return flag."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("order_ts"), (F.col("o_totalprice") / 100).alias("ref"))
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.when(k % 5 == 0, 0.0).otherwise(F.col("l_quantity")).alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_returnflag") == "R", "m").when(F.col("l_returnflag") == "A", "T").alias("liquidity"), F.col("l_shipdate").alias("ts"),
    )
    return items.join(orders, "l_orderkey").withColumn("mid", F.col("ref") * 1.001)


FILLS = """fills AS (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 0.0 ELSE l_quantity END AS qty, l_extendedprice / l_quantity AS price, l_returnflag = 'R' AS maker, l_shipdate AS ts,
o_orderdate AS order_ts, o_totalprice / 100 AS ref, o_totalprice / 100 * 1.001::DOUBLE AS mid FROM lineitem JOIN orders ON o_orderkey = l_orderkey), good AS (SELECT * FROM fills WHERE qty > 0)"""


@query(f"WITH {FILLS} SELECT l_orderkey, least({cents('-(qty * price * CASE WHEN maker THEN -0.2::DOUBLE ELSE 0.5::DOUBLE END / 10000)')}, -1.0) AS fees, CAST(count(*) FILTER (maker) AS BIGINT) AS maker_fills, CAST(count(*) FILTER (NOT maker) AS BIGINT) AS taker_fills FROM good GROUP BY l_orderkey")
def fill_fees(spark, sf_dir):
    return fills.fees(order_fills(spark, sf_dir), ["l_orderkey"], -0.2, 0.5, 1.0)


@query(f"""WITH {FILLS}, a AS (SELECT l_orderkey, sum(qty) AS qty, {cents('qty * price')} AS notional, {cents("greatest(0.0, CASE WHEN side = 'buy' THEN price - ref ELSE ref - price END) * qty")} AS slippage, min(ts) AS f, min(order_ts) AS o, min(side) AS side, min(mid) AS mid FROM good GROUP BY l_orderkey)
SELECT l_orderkey, qty, notional, slippage, round(notional / qty, 9) AS vwap, round(slippage / 0.01::DOUBLE / qty, 9) AS slippage_ticks, round(CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (mid - notional / qty) / mid * 10000, 9) AS spread_bps, CAST(epoch_ms(f) - epoch_ms(o) AS DOUBLE) AS ms_to_fill FROM a""")
def fill_execution(spark, sf_dir):
    return rounded(fills.execution(order_fills(spark, sf_dir), ["l_orderkey"], 0.01), 9)


@query(f"""WITH {TRADES} SELECT trade_id, round(CASE WHEN trade_id % 3 = 0 AND trade_id % 4 > 0 THEN decision_px ELSE arrival_px END, 9) AS ref, round(CASE WHEN trade_id % 5 > 0 THEN arrival_px * CASE WHEN side > 0 THEN 1.0025::DOUBLE ELSE 0.9975::DOUBLE END END, 9) AS cap,
CAST(CASE WHEN trade_id % 6 = 0 THEN greatest(1, qty) WHEN trade_id % 6 = 1 THEN 1 ELSE greatest(1, round_even(10000 / exec_px, 0)) END AS BIGINT) AS units,
CASE trade_id % 4 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' WHEN 2 THEN CASE WHEN side > 0 THEN 'buy' ELSE 'sell' END ELSE 'buy' END AS way FROM trades""")
def order_rules(spark, sf_dir):
    """Reference price, cross cap, units and side of orders told in different ways."""
    t, k = trades(spark, sf_dir), F.col("trade_id")
    word = F.when(k % 4 == 0, " Long ").when(k % 4 == 1, "SH").otherwise("?")
    return rounded(t.select(
        "trade_id", fills.reference_price(F.when(k % 3 == 0, "VWAP_target").otherwise("mid_on_submit"), F.col("arrival_px"), F.when(k % 4 > 0, F.col("decision_px"))).alias("ref"),
        fills.cross_cap(F.when(F.col("side") > 0, "buy").otherwise("sell"), F.col("arrival_px"), F.when(k % 5 > 0, 25.0)).alias("cap"),
        fills.units([F.when(k % 6 == 0, -F.col("qty"))], F.when(k % 6 > 1, F.lit(-10000.0)), F.col("exec_px")).alias("units"),
        fills.side_of([word], [F.when(k % 4 == 2, F.col("side") * F.col("qty"))]).alias("way"),
    ), 9)
