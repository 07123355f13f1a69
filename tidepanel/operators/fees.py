"""Fees of pair trades: by execution event after the fills, and on position edges; slippage of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.rolling import by_time, ffill

#: Columns that give a leg's price or liquidity, in the order they are asked.
PRICES = {"entry": ("exec_entry_vwap_{}", "entry_price_{}", "price_{}"), "exit": ("exec_exit_vwap_{}", "exit_price_{}", "price_{}")}
LIQUIDITY = {"entry": ("liquidity_entry_{}", "liquidity_{}"), "exit": ("liquidity_exit_{}", "liquidity_{}")}


def _first(df: DataFrame, names: tuple[str, ...], leg: str, other: Column) -> Column:
    return F.coalesce(*[F.col(n.format(leg)) for n in names if n.format(leg) in df.columns], other)


def _capped(total: Column, least: float, most: float) -> Column:
    """A cost (negative) of `least` at least and `most` at most; rebates are left alone."""
    if least > 0:
        total = F.when(total < 0, F.least(total, F.lit(-least))).otherwise(total)
    if most > 0:
        total = F.when(total < 0, F.greatest(total, F.lit(-most))).otherwise(total)
    return total


def event_fees(trades: DataFrame, per_trade: float = 0.0, maker_bps: float = 0.0, taker_bps: float = 0.0, maker_per_share: float = 0.0, taker_per_share: float = 0.0, min_fee: float = 0.0, max_fee: float = 0.0) -> DataFrame:
    """Adds fees, fees_entry and fees_exit (costs negative, rebates positive) of pair trades: four execution events, each with its leg's basis points and per-share fee by liquidity (taker where
    none is said), and per_trade. min_fee and max_fee bound the whole trade's cost, shared over entry and exit in proportion. trades: units_y, units_x and the columns of PRICES and LIQUIDITY that there are.
    """
    events = {}
    for when in ("entry", "exit"):
        parts = []
        for leg in ("y", "x"):
            before = F.lit(0.0) if when == "entry" else _first(trades, PRICES["entry"], leg, F.lit(0.0))
            price = _first(trades, PRICES[when], leg, before)
            units = F.coalesce(F.col(f"units_{leg}"), F.lit(0.0))
            maker = F.lower(F.trim(_first(trades, LIQUIDITY[when], leg, F.lit("taker")))) == "maker"
            rate, share = F.when(maker, maker_bps).otherwise(taker_bps), F.when(maker, maker_per_share).otherwise(taker_per_share)
            parts.append(-(rate / 1e4) * F.abs(units * price) - share * F.greatest(units, F.lit(0.0)))
        events[when] = parts[0] + parts[1] - 2.0 * abs(per_trade)
    out = trades.withColumns({"_e": events["entry"], "_x": events["exit"]})
    raw = F.col("_e") + F.col("_x")
    out = out.withColumn("fees", _capped(raw, abs(min_fee), abs(max_fee)))
    scale = F.coalesce(F.try_divide("fees", raw), F.lit(0.0))
    return out.withColumns({"fees_entry": F.col("_e") * scale, "fees_exit": F.col("_x") * scale}).drop("_e", "_x")


def edge_fees(rows: DataFrame, per_trade: float, fee_bps: float, per_share: float, min_fee: float = 0.0, max_fee: float = 0.0, key: str = "pair") -> DataFrame:
    """Adds cost (negative) on the rows where a position opens or closes: per_trade and per_share of both legs and basis points of both notionals, for one unit at least. A round trip's cost is bounded by min_fee
    and max_fee, in proportion; one still open pays its entry. A position that turns closes and opens on that row. Positions and prices are carried over missing values; a row before the first prices is no event.
    rows: key, ts, pos, y, x, size.
    """
    w = by_time(key)
    at = rows.withColumns({"_p": F.coalesce(ffill(F.col("pos"), key), F.lit(0)).cast("int"), "_y": ffill(F.col("y"), key), "_x": ffill(F.col("x"), key)})
    seen = F.col("_y").isNotNull() & F.col("_x").isNotNull()
    before = F.coalesce(F.lag("_p").over(w), F.lit(0))
    at = at.withColumns({"_in": seen & (F.col("_p") != 0) & (F.col("_p") != before), "_out": seen & (before != 0) & (F.col("_p") != before)})
    at = at.withColumn("_no", F.sum(F.col("_in").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    qty = F.greatest(F.abs(F.coalesce("size", F.lit(0.0))), F.lit(1.0))
    raw = -(2.0 * abs(per_trade) + 2.0 * abs(per_share) * qty + qty * (F.abs("_y") + F.abs("_x")) * abs(fee_bps) * 1e-4)
    closed = F.col("_no") - F.col("_in").cast("int")  # the trade that an exit on this row closes
    event = lambda on, no, way: F.struct(on.alias("on"), no.cast("long").alias("no"), F.lit(way).alias("way"))
    events = F.filter(F.array(event(F.col("_in"), F.col("_no"), "in"), event(F.col("_out"), closed, "out")), lambda e: e["on"] & (e["no"] > 0))
    each = at.select(key, "ts", raw.alias("raw"), F.explode(events).alias("e")).select(key, "ts", "raw", "e.no", "e.way")
    trade = Window.partitionBy(key, "no")
    total = F.sum("raw").over(trade)
    done = F.max(F.col("way") == "out").over(trade)
    cost = F.when(done, F.coalesce(F.col("raw") * _capped(total, abs(min_fee), abs(max_fee)) / F.nullif(total, F.lit(0.0)), F.lit(0.0))).otherwise(F.col("raw"))
    paid = each.withColumn("cost", cost).groupBy(key, "ts").agg(F.sum("cost").alias("cost"))
    return rows.join(paid, [key, "ts"], "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def pair_slippage(size: Column, y: Column, x: Column, adv_y: Column, adv_x: Column, vol_y: Column, vol_x: Column, base: float = 0.0002, model: str = "sqrt", coef: float = 0.1, power: float = 0.5, floor_bps: float = 0.0, cap: float = 0.02) -> Column:
    """Slippage of both legs as a share of the notional: base plus impact, capped. Impact by the share of the pair's daily value (the sum of the known ones) that is traded: its square root times the root mean
    square volatility (1 if unknown), linear, or a power; floor_bps at least. The base alone where no volume is known, nothing without a notional."""
    known = lambda v: F.when(v > 0, v)
    adv = F.coalesce(known(adv_y) + known(adv_x), known(adv_y), known(adv_x))
    vol = F.coalesce(F.sqrt((known(vol_y) * known(vol_y) + known(vol_x) * known(vol_x)) / 2), known(vol_y), known(vol_x), F.lit(1.0))
    notional = (F.abs(y) + F.abs(x)) * F.greatest(size, F.lit(0.0))
    share = notional / adv
    impact = {"sqrt": coef * vol * F.sqrt(share), "linear": coef * share, "power": coef * F.pow(share, F.lit(power))}[model]
    if floor_bps > 0:
        impact = F.greatest(impact, F.lit(floor_bps / 1e4))
    whole = F.least(F.greatest(base + F.greatest(impact, F.lit(0.0)), F.lit(0.0)), F.lit(cap))
    return F.when(~F.coalesce(notional > 0, F.lit(False)), 0.0).when(adv.isNull(), min(base, cap)).otherwise(whole)
