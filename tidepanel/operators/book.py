"""Trade logs as they come: names, times, legs, costs and their net, daily components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.align import map_to_calendar

#: Names under which trade logs carry a field, in order of preference.
NAMES = {
    "entry_date": ("entry_date", "entry_dt", "entry_ts", "entry_time", "entry_datetime", "open_date", "open_dt", "open_ts", "open_time", "open_datetime", "timestamp_entry", "exec_entry_ts", "start", "start_time", "start_dt"),
    "exit_date": ("exit_date", "exit_dt", "exit_ts", "exit_time", "exit_datetime", "close_date", "close_dt", "close_ts", "close_time", "close_datetime", "timestamp_exit", "exec_exit_ts", "end", "end_time", "end_dt", "fill_ts"),
    "fees": ("fees", "fee", "commissions", "commission"),
    "slippage_cost": ("slippage_cost", "slippage", "exec_slippage"),
    "impact_cost": ("impact_cost", "market_impact", "impact"),
    "borrow_cost": ("borrow_cost", "borrow", "stock_borrow", "sb_cost"),
    "spread": ("spread", "spread_cost", "spread_pnl", "realized_spread", "realized_spread_pnl"),
}
PENALTIES = ("buyin_penalty_cost", "exec_emergency_penalty_cost")
COSTS = ("fees", "slippage_cost", "impact_cost", "borrow_cost", *PENALTIES)


def number(name: str) -> Column:
    """A column as a double, null where it is none."""
    return F.expr(f"try_cast(`{name}` AS double)")


def first_number(df: DataFrame, names: Sequence[str]) -> Column:
    """The first present number among those of the names that df has; null if there is none."""
    have = [number(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


def _source(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of the names that df has with any value; one aggregation finds out."""
    have = [n for n in names if n in df.columns]
    if not have:
        return None
    filled = df.agg(*[F.count(n).alias(n) for n in have]).first()
    return next((n for n in have if filled[n]), None)


def normalize(df: DataFrame, pair: str | None = None) -> DataFrame:
    """df with entry_date and exit_date (timestamps) from whichever columns hold them, and pair if given. Rows without both times go; so does a log that has no such column."""
    out = df
    for name in ("entry_date", "exit_date"):
        found = _source(df, NAMES[name])
        value = F.try_to_timestamp(F.col(found).cast("string")) if found else F.lit(None).cast("timestamp")
        out = out.withColumn(name, value)
    out = out.where("entry_date is not null and exit_date is not null")
    return out.withColumn("pair", F.lit(pair)) if pair is not None else out


def weekdays_between(start: Column, end: Column) -> Column:
    """Weekdays in [start, end), 0 if end is not later."""
    day = F.weekday(start)
    rest = F.datediff(end, start) % 7
    part = F.least(F.greatest(5 - day, F.lit(0)), rest) + F.greatest(rest - (7 - day), F.lit(0))
    return F.when(end > start, F.floor(F.datediff(end, start) / 7).cast("int") * 5 + part).otherwise(0)


def holding_days(df: DataFrame) -> DataFrame:
    """Adds holding_days: weekdays from entry to exit, 1 at least; 0 where the entry was blocked."""
    days = F.greatest(F.lit(1), weekdays_between(F.to_date("entry_date"), F.to_date("exit_date")))
    if "exec_entry_status" in df.columns:
        days = F.when(F.lower("exec_entry_status") == "blocked", 0).otherwise(days)
    return df.withColumn("holding_days", F.coalesce(days, F.lit(1)).cast("int"))


def exit_after_entry(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Moves exits that are not after their entry to the session behind the entry's (the last session at most). Dates; calendar: ts."""
    w = Window.orderBy("ts")  # one row per session
    following = calendar.select("ts").distinct().select("ts", F.coalesce(F.lead("ts").over(w), F.col("ts")).alias("_after"))
    at = map_to_calendar(df, "entry_date", calendar, "next").join(following, F.col("session") == F.col("ts"), "left")
    return at.withColumn("exit_date", F.when(F.col("exit_date") > F.col("entry_date"), F.col("exit_date")).otherwise(F.coalesce("_after", "exit_date"))).drop("session", "ts", "_after")


def closed_in(df: DataFrame, start, end) -> DataFrame:
    """Trades that are closed within [start, end]."""
    return df.where((F.col("exit_date") >= F.lit(start)) & (F.col("exit_date") <= F.lit(end)))


def clip_to_end(df: DataFrame, end, closes: DataFrame) -> DataFrame:
    """Trades still open at the end close there: exit_date, exit_px (the symbol's close at or before the end) and gross_pnl are computed anew, hard_exit is set.
    Trades that enter after the end go. closes: symbol, ts, close."""
    last = closes.where((F.col("ts") <= F.lit(end)) & F.col("close").isNotNull()).groupBy("symbol").agg(F.max_by("close", "ts").alias("_px"))
    out = df.where(F.col("entry_date") <= F.lit(end)).join(last, "symbol", "left").withColumn("hard_exit", F.col("exit_date") > F.lit(end))
    moved = F.col("hard_exit") & F.col("_px").isNotNull()
    out = out.withColumn("exit_px", F.when(moved, F.col("_px")).otherwise(F.col("exit_px"))).withColumn("exit_date", F.when(F.col("hard_exit"), F.lit(end)).otherwise(F.col("exit_date")))
    return out.withColumn("gross_pnl", F.when(moved, F.col("side") * F.col("qty") * (F.col("exit_px") - F.col("exec_px"))).otherwise(F.col("gross_pnl"))).drop("_px")


def leg_notionals(df: DataFrame) -> DataFrame:
    """Adds notional_1, notional_2 and gross_notional of a pair's legs, from the first set of columns that is complete in a row: notionals, units and prices, size and
    prices, or a gross notional cut in half. The signal's sign (missing: long) gives the legs theirs, but where notionals or units carry it."""
    get = lambda *names: first_number(df, names)
    sign = F.when(get("signal") < 0, -1.0).otherwise(1.0)
    n1, n2 = get("notional_y", "leg1_notional", "t1_notional"), get("notional_x", "leg2_notional", "t2_notional")
    u1, u2 = get("y_units", "units_y"), get("x_units", "units_x")
    p1, p2 = get("entry_price_y", "price_y", "y_price", "py", "entry_y"), get("entry_price_x", "price_x", "x_price", "px", "entry_x")
    size = get("size", "units", "qty", "quantity")
    gross = F.coalesce(get("gross_notional", "notional", "abs_notional"), F.abs(size * get("entry_price", "price", "px")))
    whole = lambda *cols: F.greatest(*[c.isNull() for c in cols]) == F.lit(False)
    case = F.when(whole(n1, n2), F.array(n1, n2)).when(whole(u1, u2, p1, p2), F.array(u1 * p1, u2 * p2)).when(whole(size, p1, p2), F.array(F.abs(size * p1) * sign, -F.abs(size * p2) * sign))
    legs = case.when(gross.isNotNull(), F.array(gross / 2 * sign, -gross / 2 * sign)).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    direct = whole(n1, n2) | whole(u1, u2, p1, p2) | whole(size, p1, p2)
    out = df.withColumns({"_legs": legs, "_gross": F.when(direct, F.abs(legs[0]) + F.abs(legs[1])).otherwise(F.coalesce(gross, F.lit(0.0)))})
    return out.withColumns({"notional_1": F.col("_legs")[0], "notional_2": F.col("_legs")[1], "gross_notional": F.col("_gross")}).drop("_legs", "_gross")


def short_leg(df: DataFrame) -> DataFrame:
    """Adds short_symbol and short_notional: of a long signal the second leg, of a short one the first; half the gross notional where the legs have none; of a single
    symbol its notional, or size times price."""
    get = lambda *names: first_number(df, names)
    text = lambda name: F.upper(F.trim(F.col(name).cast("string"))) if name in df.columns else F.lit(None).cast("string")
    long = F.coalesce(get("signal", "position", "side_sign"), F.lit(1.0)) >= 0
    n1, n2 = get("notional_y", "t1_notional", "leg1_notional"), get("notional_x", "t2_notional", "leg2_notional")
    gross, size = get("gross_notional", "notional", "abs_notional"), get("size", "units", "qty", "quantity")
    price = get("entry_price", "price", "px", "entry_price_y", "entry_price_x")
    legs = n1.isNotNull() & n2.isNotNull()
    pair_symbol = F.when(long, text("x_symbol")).otherwise(text("y_symbol"))
    single = F.coalesce(text("symbol"), text("ticker"), text("asset"))
    notional = F.when(legs, F.when(long, F.abs(n2)).otherwise(F.abs(n1))).when(gross > 0, gross / 2).when(size.isNotNull() & (price > 0), F.abs(size) * price).otherwise(0.0)
    return df.withColumns({"short_symbol": F.when(legs | F.coalesce(gross > 0, F.lit(False)), pair_symbol).otherwise(single), "short_notional": notional})


def cost_columns(df: DataFrame) -> DataFrame:
    """df with the standard cost columns: each from the first of its names that df has, 0 where missing."""
    out = df
    for name in (*COSTS, "spread"):
        found = next((n for n in NAMES.get(name, (name,)) if n in df.columns), None)
        out = out.withColumn(name, F.coalesce(number(found), F.lit(0.0)) if found else F.lit(0.0))
    return out


def _diagnostic(df: DataFrame) -> Column:
    return F.coalesce(F.col("exec_diag_costs_only").cast("boolean"), F.lit(False)) if "exec_diag_costs_only" in df.columns else F.lit(False)


def cost_semantics(df: DataFrame) -> DataFrame:
    """Adds execution_diagnostic_costs, total_costs, gross_pnl and net_pnl where they are missing. Slippage and impact of a row marked exec_diag_costs_only are told, not charged."""
    shown, moved = _diagnostic(df), F.col("slippage_cost") + F.col("impact_cost")
    rest = F.col("fees") + F.col("borrow_cost") + sum((F.col(p) for p in PENALTIES), F.lit(0.0))
    out = df.withColumns({"execution_diagnostic_costs": F.when(shown, moved).otherwise(0.0), "total_costs": rest + F.when(shown, 0.0).otherwise(moved)})
    net = F.col("net_pnl") if "net_pnl" in df.columns else None
    gross = F.coalesce(number("gross_pnl"), F.lit(0.0)) if "gross_pnl" in df.columns else F.coalesce(net, F.lit(0.0)) - F.col("total_costs") if net is not None else -F.col("total_costs")
    out = out.withColumn("gross_pnl", gross)
    settled = F.col("gross_pnl") + F.col("total_costs")
    return out.withColumn("net_pnl", F.coalesce(number("net_pnl"), settled) if net is not None else settled)


def finalize(df: DataFrame) -> DataFrame:
    """Charges every cost but fees with a negative sign and computes total_costs, costs (their size) and net_pnl anew. Fees keep their sign: rebates are positive."""
    out = cost_columns(df)
    out = out.withColumns({c: -F.abs(c) for c in COSTS if c != "fees"} | {"gross_pnl": F.coalesce(number("gross_pnl"), F.lit(0.0)) if "gross_pnl" in df.columns else F.lit(0.0)})
    shown = _diagnostic(df)
    charged = F.col("slippage_cost") + F.col("impact_cost")
    total = F.col("fees") + F.when(shown, 0.0).otherwise(charged) + F.col("borrow_cost") + sum((F.col(p) for p in PENALTIES), F.lit(0.0))
    out = out.withColumn("total_costs", total)
    return out.withColumns({"costs": F.abs("total_costs"), "net_pnl": F.col("gross_pnl") + F.col("total_costs")})


SUMS = ("gross_pnl", *COSTS, "execution_diagnostic_costs", "spread", "total_costs", "net_pnl")


def components(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of every cost component per group, and the trades with a net. Null groups stay. Sums run in whole ten-thousandths, so they are exact."""
    exact = lambda c: (F.sum(F.round(F.col(c) * 10000).cast("long")) / 10000).alias(c)
    return df.groupBy(*by).agg(*[exact(c) for c in SUMS], F.count("net_pnl").alias("trades"))


def settle_day(ts: Column, zone: str = "America/New_York", utc: bool = True) -> Column:
    """Day of a time in the exchange's zone; naive times are UTC, or already local."""
    return F.to_date(F.from_utc_timestamp(ts, zone)) if utc else F.to_date(ts)


def flat_equity(calendar: DataFrame, capital: float) -> DataFrame:
    """The equity of no trades: one row per session."""
    return calendar.select(F.col("ts").alias("day"), F.lit(capital).alias("equity"), F.lit(0.0).alias("returns"), F.lit(0.0).alias("drawdown"))


def rate_on(df: DataFrame, rates: DataFrame, day: str, default: float, symbol: str = "symbol") -> DataFrame:
    """Adds rate: the symbol's rate in force on a day, that is the last observed at or before it; the default where there is none, or a negative one.

    Observations become periods up to the next one, exploded to days within the asked range, so the join is on symbol and day. rates: symbol, ts, rate.
    """
    keyed = df.select(F.col(symbol).alias("symbol"), F.col(day).alias("day")).distinct()
    ends = keyed.groupBy("symbol").agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))  # one row per symbol
    seen = rates.where("rate is not null").groupBy("symbol", "ts").agg(F.max("rate").alias("rate"))
    spans = seen.join(ends, "symbol").withColumn("_to", F.coalesce(F.date_sub(F.lead("ts").over(Window.partitionBy("symbol").orderBy("ts")), 1), F.col("_hi")))
    spans = spans.withColumns({"_from": F.greatest("ts", "_lo"), "_to": F.least("_to", "_hi")}).where("_from <= _to")
    daily = spans.select(F.col("symbol").alias("_s"), F.explode(F.sequence("_from", "_to")).alias("_d"), F.col("rate").alias("_rate"))
    out = df.join(daily, (F.col(symbol) == F.col("_s")) & (F.col(day) == F.col("_d")), "left")
    return out.withColumn("rate", F.when(F.col("_rate") >= 0, F.col("_rate")).otherwise(default)).drop("_s", "_d", "_rate")


def borrow_daily(trades: DataFrame, rates: DataFrame, default: float, basis: int = 252) -> DataFrame:
    """trade_id, day, borrow (<= 0): the entry notional of short trades at the rate in force on the entry day, a share of it for each weekday behind the entry up to the exit
    (the entry's own if there is none)."""
    short = rate_on(trades.where("side < 0"), rates, "entry_date", default).where("rate > 0")
    first = F.least(F.date_add("entry_date", 1), "exit_date")
    days = short.withColumn("day", F.explode(F.sequence(first, F.col("exit_date")))).where((F.weekday("day") < 5) | (F.col("entry_date") == F.col("exit_date")))
    return days.select("trade_id", "symbol", "day", (-F.col("rate") / basis * F.abs(F.col("qty") * F.col("exec_px"))).alias("borrow"))


def by_day(daily: DataFrame, value: str, day: str = "day") -> DataFrame:
    """day, value: a daily series over all trades, exact to ten-thousandths."""
    return daily.groupBy(day).agg((F.sum(F.round(F.col(value) * 10000).cast("long")) / 10000).alias(value))
