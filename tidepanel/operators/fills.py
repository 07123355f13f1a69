"""Fills of orders: fees, slippage, spread, time to fill; reference prices, units and sides of orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalars import money


def valid(fills: DataFrame) -> DataFrame:
    """Fills with a positive quantity and a price."""
    return fills.where((F.col("qty") > 0) & F.col("price").isNotNull() & ~F.isnan("price"))


def fees(fills: DataFrame, keys: Sequence[str], maker_bps: float, taker_bps: float, min_fee: float = 0.0) -> DataFrame:
    """keys, fees (costs negative, rebates positive, at least min_fee as a cost), maker_fills, taker_fills. What is not marked M takes."""
    maker = F.upper(F.coalesce("liquidity", F.lit("T"))) == "M"
    each = -(F.col("qty") * F.col("price") * F.when(maker, maker_bps).otherwise(taker_bps) / 1e4)
    total = F.sum(money(each)) / 10000
    out = valid(fills).groupBy(*keys).agg(total.alias("fees"), F.count_if(maker).alias("maker_fills"), F.count_if(~maker).alias("taker_fills"))
    return out.withColumn("fees", F.least("fees", F.lit(-abs(min_fee)))) if min_fee else out


def execution(fills: DataFrame, keys: Sequence[str], tick: float) -> DataFrame:
    """Per order: qty, notional, vwap, slippage (money lost against ref, gains count 0), slippage_ticks (mean per unit), spread_bps (realised, against mid), ms_to_fill.

    fills: keys, side (buy or sell), qty, price, ts, and the order's ref, mid and order_ts.
    """
    buy = F.col("side") == "buy"
    adverse = F.greatest(F.lit(0.0), F.when(buy, F.col("price") - F.col("ref")).otherwise(F.col("ref") - F.col("price")))
    out = valid(fills).groupBy(*keys).agg(
        F.sum("qty").alias("qty"), (F.sum(money(F.col("qty") * F.col("price"))) / 10000).alias("notional"), (F.sum(money(adverse * F.col("qty"))) / 10000).alias("slippage"),
        F.min("ts").alias("_first"), F.min("order_ts").alias("_sent"), F.min("side").alias("_side"), F.min("mid").alias("_mid"),
    )
    vwap = F.col("notional") / F.col("qty")
    spread = F.when(F.col("_mid") > 0, F.when(F.col("_side") == "buy", 1).otherwise(-1) * (F.col("_mid") - vwap) / F.col("_mid") * 1e4)
    waited = (F.unix_millis(F.col("_first").cast("timestamp")) - F.unix_millis(F.col("_sent").cast("timestamp"))).cast("double")
    return out.withColumns({"vwap": vwap, "slippage_ticks": F.col("slippage") / tick / F.col("qty"), "spread_bps": spread, "ms_to_fill": waited}).drop("_first", "_sent", "_side", "_mid")


def reference_price(policy: Column, submit_mid: Column, target_vwap: Column) -> Column:
    """The target where the policy asks for it and there is one, else the mid at submission."""
    return F.coalesce(F.when(F.lower(policy) == "vwap_target", target_vwap), submit_mid)


def cross_cap(side: Column, mid: Column, cap_bps: Column) -> Column:
    """Worst price an order may cross to; null without a mid or a cap."""
    share = cap_bps / 1e4
    return F.when((mid > 0) & (cap_bps > 0), F.when(side == "buy", mid * (1 + share)).otherwise(mid * (1 - share)))


def units(candidates: Sequence[Column], notional: Column, price: Column) -> Column:
    """Whole units, 1 at least: the first present candidate's size, else notional over price."""
    implied = F.when((F.abs(price) > 0) & (F.abs(notional) > 0), F.abs(notional) / F.abs(price))
    return F.greatest(F.lit(1), F.bround(F.coalesce(*[F.abs(c) for c in candidates], implied, F.lit(1.0))).cast("long"))


#: How logs write a side.
BUYS, SELLS = ("buy", "long", "+", "b", "l", "1"), ("sell", "short", "-", "s", "sh", "-1")


def side_of(words: Sequence[Column], amounts: Sequence[Column], default: str = "buy") -> Column:
    """buy or sell: by the first word that says so, else by the sign of the first amount that has one, else the default."""
    found = []
    for w in words:
        x = F.lower(F.trim(w))
        found.append(F.when(x.isin(*BUYS), "buy").when(x.isin(*SELLS), "sell"))
    found += [F.when(a < 0, "sell").when(a > 0, "buy") for a in amounts]
    return F.coalesce(*found, F.lit(default))


def annual_factor(days: DataFrame) -> DataFrame:
    """One row with periods: 252, 52, 12, 4 or 1 a year, by the usual distance of neighbouring days; 252 where the distances agree with none. days: ts."""
    from pyspark.sql import Window

    gap = F.datediff("ts", F.lag("ts").over(Window.orderBy("ts")))  # one row per day
    at = days.select("ts").distinct().select(gap.alias("g")).agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    within = lambda a, b: (F.col("lo") >= a) & (F.col("hi") <= b)
    return at.select(F.when(within(1, 3), 252).when(within(7, 7), 52).when(within(28, 31), 12).when(within(89, 92), 4).when(within(365, 366), 1).otherwise(252).alias("periods"))
