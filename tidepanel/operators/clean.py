"""Panel cleaning over long (symbol, ts) tables. Missing is null; all rules look back only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.rolling import at_least, by_time, median, trailing


def mask_ohlc(bars: DataFrame, eps_abs: float = 1e-9, eps_rel: float = 1e-9) -> DataFrame:
    """Nulls inconsistent prices: the whole row if high < low, else the offending high or low; then what is not positive. Adds rule."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    eps = eps_abs + eps_rel * F.greatest(*[F.abs(x) for x in (o, h, l, c)])
    crossed, tall, deep = h < l - eps, h < F.greatest(o, c, l) - eps, l > F.least(o, c, h) + eps
    rule = F.when(crossed, "high_below_low").when(tall, "high_too_low").when(deep, "low_too_high")
    bad = {"open": crossed, "close": crossed, "high": crossed | tall, "low": crossed | deep}
    return bars.withColumns({"rule": rule} | {x: F.when(~F.coalesce(b, F.lit(False)) & (F.col(x) > eps_abs), F.col(x)) for x, b in bad.items()})


def causal_return(bars: DataFrame, value: str = "close", max_gap: int = 5) -> DataFrame:
    """Adds ret: against the last present value, null if that is more than max_gap + 1 rows back."""
    w = by_time()
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    at = bars.withColumn("pos", F.row_number().over(w))
    seen = at.withColumns({"_v": F.last(value, ignorenulls=True).over(earlier), "_p": F.last(F.when(F.col(value).isNotNull(), F.col("pos")), ignorenulls=True).over(earlier)})
    return seen.withColumn("ret", F.when(F.col("pos") - F.col("_p") <= max_gap + 1, F.try_divide(F.col(value), F.col("_v")) - 1)).drop("_v", "_p")


def mad_zscore(bars: DataFrame, value: str, window: int) -> DataFrame:
    """Adds z: deviation from the trailing median over 1.4826 times the trailing median of such deviations."""
    frame, least = trailing(window), max(5, window // 2)
    with_med = bars.withColumn("_dev", F.abs(F.col(value) - at_least(median(F.col(value)), F.col(value), frame, least)))
    with_med = with_med.withColumn("_med", at_least(median(F.col(value)), F.col(value), frame, least))
    scale = 1.4826 * at_least(median(F.col("_dev")), F.col("_dev"), frame, least)
    return with_med.withColumn("z", F.try_divide(F.col(value) - F.col("_med"), F.nullif(scale, F.lit(0.0)))).drop("_dev", "_med")


def scrub_outliers(bars: DataFrame, window: int = 20, limit: float = 8.0, max_gap: int = 5) -> DataFrame:
    """Nulls closes whose causal return is an outlier. The mask comes from the values as read, so a spike and its reversal both go."""
    z = mad_zscore(causal_return(bars, max_gap=max_gap), "ret", window)
    hit = F.coalesce(F.abs("z") > limit, F.lit(False))
    return z.withColumn("outlier", hit).withColumn("close", F.when(~hit, F.col("close")))


def cap_returns(bars: DataFrame, limit: float) -> DataFrame:
    """Nulls closes whose return against the row before exceeds the limit."""
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_time())) - 1
    return bars.withColumn("capped", F.coalesce(F.abs(ret) > limit, F.lit(False))).withColumn("close", F.when(~F.col("capped"), F.col("close")))


def clip_returns(bars: DataFrame, limit: float) -> DataFrame:
    """Moves closes to the return limit; a moved close is the next reference, so a symbol's rows are walked in order. symbol, ts, close."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        last, out = None, []
        for x in rows["close"].tolist():
            if x == x and x is not None and last is not None:
                x = min(max(x, last * (1 - limit)), last * (1 + limit))
            out.append(x)
            last = x if x == x and x is not None else last
        return rows.assign(close=out)

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandas(walk, "symbol string, ts date, close double")


def zero_volume(bars: DataFrame, min_price: float = 0.0) -> DataFrame:
    """Volume 0 beside a price is missing. Adds zero_volume."""
    hit = F.coalesce((F.col("volume") == 0) & (F.col("close") > min_price), F.lit(False))
    return bars.withColumn("zero_volume", hit).withColumn("volume", F.when(~hit, F.col("volume")))


def reconcile(bars: DataFrame) -> DataFrame:
    """Widens high and low to hold the close, then clips the open into them. Never fills what is missing."""
    wide = bars.withColumns({"high": F.when(F.col("high").isNotNull(), F.greatest("high", "close")), "low": F.when(F.col("low").isNotNull(), F.least("low", "close"))})
    wide = wide.withColumns({"high": F.when(F.col("low") > F.col("high"), F.col("low")).otherwise(F.col("high"))})
    return wide.withColumn("open", F.when(F.col("open").isNotNull(), F.greatest(F.least("open", F.coalesce("high", "open")), F.coalesce("low", "open"))))


def null_runs(grid: DataFrame, value: str = "close") -> DataFrame:
    """Gaps and islands: symbol, start, end (ts), length, before (a present value precedes) and after."""
    w = by_time()
    at = grid.withColumns({"pos": F.row_number().over(w), "n_rows": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    missing = at.where(F.col(value).isNull()).withColumn("island", F.col("pos") - F.row_number().over(w))
    runs = missing.groupBy("symbol", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("length"), F.min("pos").alias("p0"), F.max("pos").alias("p1"), F.first("n_rows").alias("n_rows"))
    return runs.select("symbol", "start", "end", "length", (F.col("p0") > 1).alias("before"), (F.col("p1") < F.col("n_rows")).alias("after"))


def coverage(grid: DataFrame, value: str = "close") -> DataFrame:
    """Per symbol: rows, share present, missing at the start and end, longest gap."""
    at = grid.withColumn("pos", F.row_number().over(by_time()))
    have = F.when(F.col(value).isNotNull(), F.col("pos"))
    stats = at.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(value).isNotNull().cast("double")).alias("present"), F.coalesce(F.min(have) - 1, F.count(F.lit(1))).alias("lead_na"), F.coalesce(F.count(F.lit(1)) - F.max(have), F.count(F.lit(1))).alias("trail_na"))
    longest = null_runs(grid, value).groupBy("symbol").agg(F.max("length").alias("longest_gap"))
    return stats.join(longest, "symbol", "left").fillna(0, ["longest_gap"])


def gate(stats: DataFrame, min_present: float, max_lead: int, max_trail: int, max_gap: int, hard_drop: bool = True) -> DataFrame:
    """First failed check as reason, in order: coverage, start, end, gap. A soft gap check only warns."""
    reason = F.when(F.col("present") < min_present, "coverage").when(F.col("lead_na") > max_lead, "leading").when(F.col("trail_na") > max_trail, "trailing").when(F.col("longest_gap") > max_gap, "gap" if hard_drop else "gap_warning")
    return stats.withColumn("reason", reason).withColumn("kept", F.coalesce(reason == "gap_warning", F.lit(True)))


def causal_fill(grid: DataFrame, max_gap: int, value: str = "close") -> DataFrame:
    """Carries the last value over inner gaps of up to max_gap rows; longer gaps and both ends stay. Adds filled."""
    w = by_time()
    at = grid.withColumn("pos", F.row_number().over(w))
    island = F.when(F.col(value).isNull(), F.col("pos") - F.sum(F.col(value).isNull().cast("int")).over(w))
    at = at.withColumn("island", island)
    length = F.count(F.lit(1)).over(Window.partitionBy("symbol", "island"))
    last = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    more = F.max(F.when(F.col(value).isNotNull(), F.col("pos"))).over(Window.partitionBy("symbol"))
    use = F.col(value).isNull() & (length <= max_gap) & last.isNotNull() & (F.col("pos") < more)
    out = at.withColumns({"filled": use, "_last": last})
    return out.withColumn(value, F.when(F.col("filled"), F.col("_last")).otherwise(F.col(value))).drop("island", "_last", "pos")


def stale_rows(bars: DataFrame, flat: int, value: str = "close") -> DataFrame:
    """Adds stale: the value has not changed over `flat` rows before this one."""
    same = (F.col(value) == F.lag(value).over(by_time())).cast("int")
    at = bars.withColumn("_same", F.coalesce(same, F.lit(0)))
    return at.withColumn("stale", F.sum("_same").over(trailing(flat)) == flat).drop("_same")


def mask_flags(bars: DataFrame, flags: DataFrame, fields: Sequence[str] = ("close",)) -> DataFrame:
    """Nulls fields where flags (symbol, ts, flag) say so; no flag means not flagged."""
    hit = F.coalesce(F.col("flag"), F.lit(False))
    return bars.join(flags.dropDuplicates(["symbol", "ts"]), ["symbol", "ts"], "left").withColumns({f: F.when(~hit, F.col(f)) for f in fields}).drop("flag")


def last_present(rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """One row per keys: of rows that repeat a key, each field's last present value by order."""
    return rows.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def log_causal_return(bars: DataFrame, value: str = "close", max_gap: int = 5) -> DataFrame:
    """As causal_return, in logs; what is not positive is missing."""
    positive = bars.withColumn("_log", F.when(F.col(value) > 0, F.ln(value)))
    w = by_time()
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    at = positive.withColumn("pos", F.row_number().over(w))
    seen = at.withColumns({"_v": F.last("_log", ignorenulls=True).over(earlier), "_p": F.last(F.when(F.col("_log").isNotNull(), F.col("pos")), ignorenulls=True).over(earlier)})
    return seen.withColumn("ret", F.when(F.col("pos") - F.col("_p") <= max_gap + 1, F.col("_log") - F.col("_v"))).drop("_v", "_p", "_log")


def centered_outliers(bars: DataFrame, window: int = 21, limit: float = 8.0) -> DataFrame:
    """The older scrub: log returns against the median of a window around them (it looks ahead). Marks outlier and nulls those closes; symbols with an outlier
    also lose what is not positive; symbols with under five closes are left as they are."""
    w = by_time()
    half = window // 2
    frame, least = w.rowsBetween(-half, half), max(5, half)
    log = F.when(F.col("close") > 0, F.ln("close"))
    at = bars.withColumn("_r", log - F.lag(log).over(w))
    at = at.withColumn("_med", at_least(median(F.col("_r")), F.col("_r"), frame, least)).withColumn("_dev", F.abs(F.col("_r") - F.col("_med")))
    scale = F.nullif(1.4826 * at_least(median(F.col("_dev")), F.col("_dev"), frame, least), F.lit(0.0))
    whole = Window.partitionBy("symbol")
    hit = F.coalesce(F.abs(F.try_divide(F.col("_r") - F.col("_med"), scale)) > limit, F.lit(False))
    at = at.withColumn("_s", hit & (F.count("close").over(whole) >= 5))
    touched = F.max("_s").over(whole)
    return at.withColumn("close", F.when(~F.col("_s") & ~(touched & (F.col("close") <= 0)), F.col("close"))).withColumnRenamed("_s", "outlier").drop("_r", "_med", "_dev")


def tradable(bars: DataFrame, calendar: DataFrame | None = None, opens: str = "09:30", closes: str = "16:00") -> DataFrame:
    """Adds tradable: whether ts is a session (a day of the calendar, else a weekday); for times of day also whether it is within the session's hours."""
    day = F.to_date("ts")
    kind = dict(bars.dtypes)["ts"]
    inside = F.lit(True) if kind == "date" else F.date_format("ts", "HH:mm").between(opens, closes)
    if calendar is None:
        return bars.withColumn("tradable", (F.weekday(day) < 5) & inside)
    days = calendar.select(F.col("ts").alias("_day"), F.lit(True).alias("_open")).distinct()
    return bars.join(days, day == F.col("_day"), "left").withColumn("tradable", F.coalesce("_open", F.lit(False)) & inside).drop("_day", "_open")


def is_intraday(bars: DataFrame) -> DataFrame:
    """One row: intraday, whether half of the neighbouring distances of a symbol's rows or more are under a day."""
    gap = F.col("ts").cast("timestamp").cast("long") - F.lag(F.col("ts").cast("timestamp").cast("long")).over(by_time())
    return bars.select(gap.alias("g")).where("g is not null").agg(F.coalesce(F.avg((F.col("g") < 86400).cast("double")) >= 0.5, F.lit(False)).alias("intraday"))


#: What was done with a missing tradable row.
FILLS = ("filled_single_avg", "filled_ffill", "filled_bfill", "filled_linear", "filled_kalman", "skip_nontradable", "skip_edge_unfilled", "drop")


def safe_fill(grid: DataFrame, max_gap: int, causal: bool = False, hard_drop: bool = True, value: str = "close") -> DataFrame:
    """symbol, ts, close, filled, method (one of FILLS, or null), removed: gaps of up to max_gap tradable rows are filled, in order. One row: the mean of its neighbours, or the one there is;
    two rows: a line between them; more: a local-level smoother over the five rows on each side, of which those in front have been filled by then and those behind have not.
    causal: the value before, only. Longer gaps, gaps of two and more without both neighbours, and rows that are not tradable stay. hard_drop: a gap that stays and is not at an end of the symbol's rows
    marks the symbol as removed, and nothing behind it is filled. grid: symbol, ts, close, tradable.

    One and two rows come from their neighbours by windows. A smoothed gap depends on an earlier one only if that ends within five rows in front of it: such gaps form a chain, and each chain is solved in order
    as one small group, rows of the chain only.
    """
    w, whole = by_time(), Window.partitionBy("symbol")
    at = grid.select("symbol", "ts", F.col(value).alias("close"), F.coalesce("tradable", F.lit(False)).alias("tradable"), F.row_number().over(w).alias("pos"), F.count(F.lit(1)).over(whole).alias("n"))
    missing = F.col("close").isNull()
    at = at.withColumn("hole", missing & F.col("tradable")).withColumn("gap", F.when(F.col("hole"), F.col("pos") - F.sum(F.col("hole").cast("int")).over(w)))
    at = at.withColumn("run", F.when(missing, F.col("pos") - F.sum(missing.cast("int")).over(w)))
    by_gap = Window.partitionBy("symbol", "gap")
    at = at.withColumns({"length": F.count(F.lit(1)).over(by_gap), "first": F.min("pos").over(by_gap), "closed": ~F.max("hole").over(Window.partitionBy("symbol", "run"))})
    at = at.withColumns({"before": F.lag("close").over(w), "after": F.lead("close").over(w)})
    # the neighbours of the whole gap, carried to each of its rows
    at = at.withColumns({"left": F.max(F.when(F.col("pos") == F.col("first"), F.col("before"))).over(by_gap), "right": F.max(F.when(F.col("pos") == F.col("first") + F.col("length") - 1, F.col("after"))).over(by_gap)})
    step, length = F.col("pos") - F.col("first") + 1, F.col("length")
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    if causal:
        found, how = F.col("left"), F.when(F.col("left").isNotNull(), "filled_ffill")
    else:
        line = F.col("left") + (F.col("right") - F.col("left")) * step / (length + 1)
        found = F.when(length == 1, F.when(both, (F.col("left") + F.col("right")) / 2).otherwise(F.coalesce("left", "right"))).when((length == 2) & both, line)
        one = F.when(both, "filled_single_avg").when(F.col("left").isNotNull(), "filled_ffill").when(F.col("right").isNotNull(), "filled_bfill")
        how = F.when(length == 1, one).when((length == 2) & both, "filled_linear").when((length > 2) & both, "filled_kalman")
    end = (F.col("first") == 1) | (F.col("first") + length - 1 == F.col("n"))
    how = F.when(length <= max_gap, how)
    told = F.when(F.col("hole"), F.coalesce(how, F.when(end, "skip_edge_unfilled").otherwise("drop"))).when(missing & F.col("closed"), "skip_nontradable")
    at = at.withColumn("method", told)
    at = at.withColumn("stop", F.min(F.when((F.col("method") == "drop") & F.lit(hard_drop), F.col("first"))).over(whole))
    reached = F.col("stop").isNull() | (F.when(F.col("hole"), F.col("first")).otherwise(F.col("pos") + 1) <= F.col("stop"))
    at = at.withColumn("method", F.when(reached, F.col("method"))).withColumn("value", F.when(F.col("method").startswith("filled"), found))
    if not causal:
        gaps = at.where("method = 'filled_kalman' AND pos = first").select("symbol", "first", "length")
        order = Window.partitionBy("symbol").orderBy("first")
        last = F.lag(F.col("first") + length - 1).over(order)
        gaps = gaps.withColumn("new", (last.isNull() | (last < F.col("first") - 5)).cast("int")).withColumn("chain", F.sum("new").over(order))
        chains = gaps.groupBy("symbol", "chain").agg(F.sort_array(F.collect_list(F.struct("first", "length"))).alias("gaps"), F.min("first").alias("lo"), F.max(F.col("first") + length).alias("hi"))
        around = chains.withColumn("pos", F.explode(F.sequence(F.greatest(F.col("lo") - 5, F.lit(1)), (F.col("hi") + 4).cast("int"))))
        near = around.join(at.select("symbol", "pos", "close", "value"), ["symbol", "pos"])
        near = near.groupBy("symbol", "chain").agg(F.first("gaps").alias("gaps"), F.sort_array(F.collect_list(F.struct("pos", "close", "value"))).alias("rows"))
        smooth = near.select("symbol", F.explode(_smooth_chain(F.col("gaps"), F.col("rows"))).alias("x")).select("symbol", "x.pos", F.col("x.level").alias("_level"))
        at = at.join(smooth, ["symbol", "pos"], "left").withColumn("value", F.coalesce("value", "_level"))
    return at.select("symbol", "ts", F.coalesce("close", "value").alias("close"), F.col("value").isNotNull().alias("filled"), "method", F.col("stop").isNotNull().alias("removed"))


def _smooth_chain(gaps, rows):
    """pos and level of the rows of a chain's gaps, filled one after the other."""

    @F.pandas_udf("array<struct<pos:int,level:double>>")
    def run(gaps: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        number = lambda v: np.nan if v is None else float(v)
        for holes, window in zip(gaps, rows, strict=True):
            base = window[0]["pos"]
            raw = np.array([number(r["close"]) for r in window])
            now = np.array([number(r["close"] if r["value"] is None else r["value"]) for r in window])
            found = []
            for gap in holes:
                a = gap["first"] - base
                b = a + gap["length"]
                lo = max(0, a - 5)
                level = smooth_level(np.concatenate([now[lo:a], raw[a : b + 5]]))
                now[a:b] = level[a - lo : b - lo]
                found += [{"pos": int(base + i), "level": float(now[i])} for i in range(a, b)]
            out.append(found)
        return pd.Series(out)

    return run(gaps, rows)


def smooth_level(y: np.ndarray, q: float = 1e-4) -> np.ndarray:
    """The fixed-interval smoother of Rauch, Tung and Striebel (1965) for a local level: steps of variance q, noise of the present values' variance, unit variance at the first present value; rows before
    that take its level."""
    have = np.isfinite(y)
    if not have.any():
        return np.full(len(y), np.nan)
    noise, start = float(np.var(y[have])), int(np.argmax(have))
    level, var = np.zeros(len(y)), np.zeros(len(y))
    level[start], var[start] = y[start], 1.0
    for t in range(start + 1, len(y)):
        ahead = var[t - 1] + q
        gain = ahead / (ahead + noise) if have[t] and ahead + noise > 0 else 0.0
        level[t] = level[t - 1] + (gain * (y[t] - level[t - 1]) if have[t] else 0.0)
        var[t] = (1 - gain) * ahead
    back = level.copy()
    for t in range(len(y) - 2, start - 1, -1):
        if var[t]:
            back[t] += var[t] / (var[t] + q) * (back[t + 1] - level[t])
    back[:start] = back[start]
    return back


def events(masked: DataFrame, mask: str, stage: str, field: str, rule: str, severity: str, action: str) -> DataFrame:
    """A row for each masked (symbol, ts): what was done to which field by which rule, with the bar's values as they were."""
    told = {"stage": stage, "field": field, "rule": rule, "severity": severity, "action": action}
    values = [F.col(c).alias(f"value_{c}") for c in ("open", "high", "low", "close", "volume") if c in masked.columns]
    return masked.where(F.coalesce(F.col(mask), F.lit(False))).select("ts", "symbol", *[F.lit(v).alias(k) for k, v in told.items()], *values)


def event_log(*parts: DataFrame) -> DataFrame:
    """All events once, in one order: time, symbol, stage, field, rule. Sorted by ranges, not in one task."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(["ts", "symbol", "stage", "field", "rule"]).orderBy("ts", "symbol", "stage", "field", "rule")


def hard_errors(bars: DataFrame, max_bad: float) -> DataFrame:
    """symbol, n, n_bad, share, dropped: symbols of whose rows more than a share have prices that cannot be (crossed, or not positive)."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    bad = F.coalesce((h < l) | (h < F.greatest(o, c)) | (l > F.least(o, c)) | (F.least(o, h, l, c) <= 0), F.lit(False))
    out = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"))
    return out.withColumn("share", F.col("n_bad") / F.col("n")).withColumn("dropped", F.col("share") > max_bad)
