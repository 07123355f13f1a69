"""Trades: building, sizing, fees, shortfall, borrow, valuation, ledger."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.rolling import by_time
from tidepanel.functions.scalars import bps, money
from tidepanel.operators.align import asof, expand_days


def edges(pos: DataFrame, key: str = "symbol") -> DataFrame:
    """Position changes to trades: key, trade_no, side, entry_ts, exit_ts (null: still open), rows. pos: key, ts, pos."""
    w = by_time(key)
    prev = F.coalesce(F.lag("pos").over(w), F.lit(0))
    at = pos.withColumns({"_open": ((F.col("pos") != 0) & (F.col("pos") != prev)).cast("int"), "_next": F.lead("pos").over(w), "_next_ts": F.lead("ts").over(w)})
    at = at.withColumn("trade_no", F.sum("_open").over(w)).where("pos <> 0")
    last = F.max_by(F.struct(F.when(F.col("_next") != F.col("pos"), F.col("_next_ts")).alias("x")), "ts")
    return at.groupBy(key, "trade_no").agg(F.min_by("pos", "ts").alias("side"), F.min("ts").alias("entry_ts"), last.alias("_l"), F.count(F.lit(1)).alias("rows")).withColumn("exit_ts", F.col("_l.x")).drop("_l")


def size_by_risk(price: Column, sigma: Column, capital: float, risk: float, max_notional: float, max_share: float, adv: Column) -> Column:
    """Units: risk budget over the risk of a unit, under a notional and a participation cap."""
    budget = F.floor(F.try_divide(F.lit(capital * risk), price * sigma))
    return F.greatest(F.lit(0), F.least(budget, F.floor(max_notional / price), F.floor(max_share * adv / price)))


def light_fees(qty: Column, price: Column, per_trade: float = 1.0, rate_bps: float = 1.0, per_share: float = 0.005, least: float = 1.0, most_share: float = 0.005) -> Column:
    """Signed fee (<= 0) of one fill: fixed, by value and by share, between a minimum and a share of the value. Null price: no fill, null fee."""
    value = F.abs(qty * price)
    raw = per_trade + value * rate_bps / 1e4 + F.abs(qty) * per_share
    return -F.least(F.greatest(raw, F.lit(least)), F.greatest(F.lit(least), value * most_share))


def tier_fees(trades: DataFrame, tiers: DataFrame, metric: str) -> DataFrame:
    """Adds rate_bps: the tier with the greatest threshold <= metric (below the first: the first). tiers: venue, threshold, rate_bps; a venue's tiers go as one array."""
    ladder = tiers.groupBy("venue").agg(F.sort_array(F.collect_list(F.struct("threshold", "rate_bps"))).alias("ladder"))  # a fee schedule
    reached = F.filter("ladder", lambda t: t["threshold"] <= F.col(metric))
    pick = F.when(F.size(reached) > 0, F.element_at(reached, -1)["rate_bps"]).otherwise(F.col("ladder")[0]["rate_bps"])
    return trades.join(ladder, "venue", "left").withColumn("rate_bps", pick).drop("ladder")


def shortfalls(trades: DataFrame) -> DataFrame:
    side = F.col("side")
    return trades.withColumns({"decision_bps": bps(side, F.col("exec_px"), F.col("decision_px")), "arrival_bps": bps(side, F.col("exec_px"), F.col("arrival_px"))})


def priced_exit(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds exit_px (close at or before exit_date) and gross_pnl; no price, no trade."""
    out = asof(trades, bars.select("symbol", "ts", "close"), "close", "exit_date", out="exit_px").where("exit_px > 0")
    return out.withColumn("gross_pnl", F.col("side") * F.col("qty") * (F.col("exit_px") - F.col("exec_px")))


def daily_values(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Trade x day path: trade_id, symbol, day, side, qty, px (close at or before the day, else the entry price)."""
    days = expand_days(trades.select("trade_id", "symbol", "entry_date", "exit_date", "side", "qty", "exec_px"))
    return asof(days, bars.select("symbol", "ts", "close"), "close", "day", skip_null=True, out="px").withColumn("px", F.coalesce("px", "exec_px"))


def borrow_cost(paths: DataFrame, rate: float, basis: int = 360) -> DataFrame:
    """Per trade: borrow (<= 0), short trades only, days after entry, at each day's value."""
    due = paths.where("side < 0 and day > entry_date")
    return due.groupBy("trade_id").agg((-F.lit(rate) / basis * F.sum(F.col("qty") * F.col("px"))).alias("borrow"), F.count(F.lit(1)).alias("days"))


def daily_pnl(paths: DataFrame) -> DataFrame:
    """day, pnl: the change of each trade's value against the day before (the entry price first), summed in whole ten-thousandths, so that the sum is exact."""
    prev = F.coalesce(F.lag("px").over(by_time("trade_id", "day")), F.col("exec_px"))
    return paths.withColumn("_d", F.col("side") * F.col("qty") * (F.col("px") - prev)).groupBy("day").agg((F.sum(money(F.col("_d"))) / 10000).alias("pnl"))


def equity(pnl: DataFrame, capital: float) -> DataFrame:
    """day, pnl, equity, peak, drawdown. One row per day: a running sum over days."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    out = pnl.withColumn("equity", (round(capital * 10000) + F.sum(money(F.col("pnl"))).over(w)) / 10000)
    return out.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def ledger(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """Keeps a trade if it enters after the last kept exit of its key. What is kept depends on what was kept, so a key's trades are walked in order."""
    cols = trades.select("trade_id", key, "entry_date", "exit_date")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["entry_date", "exit_date", "trade_id"])
        kept, last = [], None
        for a, b in zip(rows["entry_date"], rows["exit_date"], strict=True):
            ok = last is None or a > last
            kept.append(ok)
            last = b if ok else last
        return rows[kept]

    return cols.groupBy(key).applyInPandas(walk, cols.schema)


def orders_of(trades: DataFrame) -> DataFrame:
    """Each trade as its entry and exit order."""
    legs = F.array(
        F.struct(F.lit("entry").alias("leg"), F.col("entry_date").alias("ts"), (F.col("side") * F.col("qty")).alias("signed_qty")),
        F.struct(F.lit("exit").alias("leg"), F.col("exit_date").alias("ts"), (-F.col("side") * F.col("qty")).alias("signed_qty")),
    )
    return trades.select("trade_id", "symbol", F.inline(legs))


def enforce_recalls(trades: DataFrame, recalls: DataFrame, grace: int) -> DataFrame:
    """Clips short trades to their first recall in [entry, exit] plus grace days. recalls: symbol, day."""
    days = expand_days(trades.where("side < 0").select("trade_id", "symbol", "entry_date", "exit_date"))
    first = days.join(recalls.select("symbol", "day").distinct(), ["symbol", "day"]).groupBy("trade_id").agg(F.min("day").alias("recall"))
    out = trades.join(first, "trade_id", "left")
    return out.withColumn("exit_date", F.coalesce(F.least("exit_date", F.date_add("recall", grace)), "exit_date"))
