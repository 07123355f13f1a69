"""Liquidity statistics and expected execution of orders: rolling medians, shifted as-of values, cost of an event, short availability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.rolling import at_least, by_time, ffill, log_return, median, trailing
from tidepanel.functions.scalars import fill_probability, impact_bps


def least_rows(window: int, share: float, floor: int) -> int:
    return max(floor, math.ceil(window * share))


def liquidity(bars: DataFrame, vol_window: int = 20, adv_window: int = 20, share: float = 0.5) -> DataFrame:
    """Adds sigma (rolling deviation of log returns, ddof 0), sigma_median, adv_usd and volume_median (rolling medians), each carried over rows without one."""
    w1, w2, w3 = max(2, vol_window), max(5, vol_window), max(5, adv_window)
    at = bars.withColumn("_r", log_return(F.col("close")))
    at = at.withColumn("_s", at_least(F.stddev_pop("_r"), F.col("_r"), trailing(w1), least_rows(w1, share, 2)))
    at = at.withColumn("sigma", ffill(F.col("_s"))).withColumn("_value", F.col("close") * F.col("volume"))
    rolled = lambda c, w: at_least(median(F.col(c)), F.col(c), trailing(w), least_rows(w, share, 5))
    at = at.withColumns({"_sm": rolled("sigma", w2), "_adv": rolled("_value", w3), "_vm": rolled("volume", w3)})
    return at.withColumns({"sigma_median": ffill(F.col("_sm")), "adv_usd": ffill(F.col("_adv")), "volume_median": ffill(F.col("_vm"))}).drop("_r", "_s", "_value", "_sm", "_adv", "_vm")


def shifted(rows: DataFrame, value: str, shift: int = 1, key: str = "symbol") -> DataFrame:
    """rows with value taken `shift` rows earlier: an as-of join with the result sees only what was known so many rows before. Missing values are looked at, not skipped."""
    return rows.withColumn(value, F.lag(value, shift).over(by_time(key)))


def event_cost(size: Column, price_1: Column, price_2: Column, fixed: float, slippage: Column, min_fee: float = 0.0, fixed_without_fill: bool = True) -> Column:
    """Cost (positive) of one event of a pair trade: the fixed part of each leg, slippage on both notionals, the minimum fee at least."""
    units = F.greatest(F.lit(0), F.bround(F.coalesce(size, F.lit(0.0))))
    both = F.lit(2.0 * fixed) if fixed_without_fill else F.when(units > 0, 2.0 * fixed).otherwise(0.0)
    total = both + (F.abs(price_1) + F.abs(price_2)) * units * slippage
    return F.greatest(F.lit(0.0), F.lit(float(min_fee)), total) if min_fee > 0 else F.greatest(F.lit(0.0), total)


def expected_execution(orders: DataFrame, base: float = 0.0005, coef: float = 0.1, power: float = 0.5, cap: float = 0.02, k: float = 5.0, least_fill: float = 0.05, fixed: float = 1.0, min_fee: float = 0.0) -> DataFrame:
    """Adds slippage, fill_prob, filled, fill_ratio, base_cost, impact_cost, fixed_cost, topup and total (all positive) of orders: size, price_1, price_2, adv.

    Slippage is a share of the notional (base plus impact, capped); the expected fill is floored to whole units; what is below the minimum fee is topped up.
    """
    units = F.greatest(F.lit(0), F.bround(F.coalesce(F.col("size"), F.lit(0.0))))
    prices = F.abs("price_1") + F.abs("price_2")
    out = orders.withColumn("_n", units).withColumn("_notional", prices * F.col("_n"))
    out = out.withColumn("slippage", impact_bps(F.col("_notional"), F.col("adv"), base, coef, power, 0.0, cap))
    known = (F.col("_notional") > 0) & (F.col("adv") > 0)
    out = out.withColumn("fill_prob", F.when(known, fill_probability(F.col("_notional"), F.col("adv"), k, least_fill)).otherwise(1.0))
    out = out.withColumn("filled", F.floor(F.col("_n") * F.col("fill_prob") + 1e-9))
    out = out.withColumn("fill_ratio", F.when(F.col("_n") > 0, F.col("filled") / F.col("_n")).otherwise(0.0))
    done, first = F.col("_notional") * F.col("fill_ratio"), F.least(F.lit(base), F.col("slippage"))
    out = out.withColumns({"base_cost": done * first, "impact_cost": done * F.greatest(F.lit(0.0), F.col("slippage") - first), "fixed_cost": F.lit(2.0 * fixed)})
    raw = F.col("fixed_cost") + F.col("base_cost") + F.col("impact_cost")
    out = out.withColumn("topup", F.greatest(F.lit(0.0), F.lit(min_fee) - raw) if min_fee > 0 else F.lit(0.0))
    return out.withColumn("total", raw + F.col("topup")).drop("_n", "_notional")


def edge_costs(rows: DataFrame, fixed: float, slippage: float, per_lot: float = 0.0, coef: float = 0.12, key: str = "pair") -> DataFrame:
    """Adds cost: charged on rows where the position changes (the first position counts), by that row's size: twice the fixed part and the lot fee, linear slippage and square-root
    impact on the notional. Positions and prices are carried over missing values; a row without a price costs nothing. rows: key, ts, pos, y, x, size, adv."""
    pos, y, x = F.coalesce(ffill(F.col("pos"), key), F.lit(0)), ffill(F.col("y"), key), ffill(F.col("x"), key)
    at = rows.withColumns({"_p": pos, "_y": y, "_x": x})
    changed = F.coalesce(F.col("_p") != F.lag("_p").over(by_time(key)), F.col("_p") != 0)
    size = F.when(changed, F.coalesce("size", F.lit(0.0))).otherwise(0.0)
    notional = (F.abs("_y") + F.abs("_x")) * size
    impact = F.when(F.col("adv") > 0, coef * F.sqrt(F.greatest(notional, F.lit(0.0)) / F.col("adv")) * notional).otherwise(0.0)
    cost = F.when(size > 0, 2.0 * fixed + per_lot * size).otherwise(0.0) + slippage * notional + impact
    return at.withColumn("cost", F.when(changed, F.coalesce(cost, F.lit(0.0))).otherwise(0.0)).drop("_p", "_y", "_x")


def short_blocked(legs: DataFrame, min_price: float, min_adv: float, block_missing: bool = True) -> DataFrame:
    """Adds blocked: why a short leg (negative notional or units) cannot be borrowed, null if it can: no or a low price, no or a low traded value."""
    short = F.coalesce(F.col("notional") < 0, F.lit(False)) | F.coalesce(F.col("units") < 0, F.lit(False))
    cases = []
    for name, bound in (("price", min_price), ("adv", min_adv)):
        if bound > 0:
            cases += ([(F.col(name).isNull(), f"missing_{name}")] if block_missing else []) + [(F.col(name) < bound, f"low_{name}")]
    reason = F.lit(None).cast("string")
    for cond, why in reversed(cases):
        reason = F.when(F.coalesce(cond, F.lit(False)), why).otherwise(reason)
    return legs.withColumn("blocked", F.when(short, reason))


def borrow_events(symbols: DataFrame, rates: Column, locate_bps: float, lead_days: int) -> DataFrame:
    """One locate event per symbol (trimmed, upper case, once) and day: its rate, fee and lead. symbols: symbol, day."""
    clean = symbols.select(F.upper(F.trim("symbol")).alias("symbol"), "day").where("symbol <> '' and day is not null").distinct()
    return clean.select(F.col("day").alias("date"), "symbol", F.lit("locate").alias("type"), rates.alias("rate_annual"), F.lit(locate_bps).alias("locate_fee_bps"), F.lit(lead_days).alias("lead_days"))


def plausibility(trades: DataFrame, outlier_bps: float, most_outliers: float, low: float, high: float, deciles: int = 10) -> DataFrame:
    """One row: outlier_share of exec bps, and penalties for too many outliers and for volume deciles whose median is outside [low, high]. trades: bps, adv.

    Deciles come from approximate quantiles of the volume, so no task ranks all trades.
    """
    edges = trades.agg(F.percentile_approx("adv", [i / deciles for i in range(1, deciles)], 10_000).alias("_e"))  # one row
    at = trades.where("bps is not null").join(F.broadcast(edges)).withColumn("decile", F.size(F.filter("_e", lambda e: e < F.col("adv"))))
    share = at.agg(F.avg((F.col("bps") > outlier_bps).cast("double")).alias("outlier_share"))
    medians = at.groupBy("decile").agg(F.percentile("bps", F.lit(0.5)).alias("m"))
    outside = medians.agg(F.sum(F.greatest(F.lit(0.0), F.lit(low) - F.col("m"), F.col("m") - high)).alias("decile_penalty"))
    both = share.join(F.broadcast(outside))  # one row each
    return both.withColumn("outlier_penalty", F.greatest(F.lit(0.0), F.col("outlier_share") - most_outliers) * 10_000)


def unadjusted_differs(adjusted: DataFrame, raw: DataFrame, min_rows: int = 5) -> DataFrame:
    """One row: compared (symbols with min_rows common closes), equal (those without a difference), suspicious (all are equal)."""
    both = adjusted.select("symbol", "ts", F.col("close").alias("a")).join(raw.select("symbol", "ts", F.col("close").alias("b")), ["symbol", "ts"]).where("a is not null and b is not null")
    each = both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("d")).where(F.col("n") >= min_rows)
    return each.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("d") == 0).alias("equal")).withColumn("suspicious", (F.col("compared") > 0) & (F.col("compared") == F.col("equal")))


def drop_missing_history(universe: DataFrame, missing: DataFrame, allowed: bool) -> DataFrame:
    """The universe without symbols that lack history; raises if that is not allowed and there are any. missing: symbol."""
    if not allowed and not missing.isEmpty():
        raise ValueError("symbols without history: " + ", ".join(r[0] for r in missing.select("symbol").limit(5).collect()))
    return universe.join(missing.select("symbol").distinct(), "symbol", "left_anti")


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Panels side by side: every key of either, columns of both."""
    return left.join(right, keys, "full_outer")
