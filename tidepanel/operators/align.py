"""Joins in time: grids, as-of, calendars, intervals, day expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def on_grid(bars: DataFrame, mode: str = "union") -> DataFrame:
    """Every symbol on every ts of the grid, missing where it has no row.

    mode: union (all ts), leader (those of the symbol with most closes), intersection (those all symbols have). Days are exploded per symbol between
    the grid's ends, so no cross join of the two tables is planned.
    """
    if mode == "leader":
        best = bars.where("close is not null").groupBy("symbol").count().orderBy(F.desc("count"), "symbol").limit(1)
        days = bars.where("close is not null").join(best, "symbol", "left_semi").select("ts")
    elif mode == "intersection":
        n = bars.select("symbol").distinct().agg(F.count(F.lit(1)).alias("n"))
        days = bars.groupBy("ts").agg(F.countDistinct("symbol").alias("have")).join(n, F.col("have") == F.col("n")).select("ts")
    else:
        days = bars.select("ts").distinct()
    wide = days.agg(F.sort_array(F.collect_set("ts")).alias("days"))  # a calendar: one array of days
    keys = bars.select("symbol").distinct()
    grid = keys.join(F.broadcast(wide)).select("symbol", F.explode("days").alias("ts"))
    return grid.join(bars, ["symbol", "ts"], "left")


def asof(left: DataFrame, right: DataFrame, value: str, left_ts: str, key: str = "symbol", right_ts: str = "ts", skip_null: bool = False, out: str | None = None) -> DataFrame:
    """Adds right's value of the last row at or before left_ts; validity is the caller's check, unless skip_null looks further back.

    For days, right is spread once to one row per key and day between its observations, and left meets it by an equi-join on both, so neither side is held per key; days
    behind a key's last observation take that. For other times both sides are united and carried forward in one window per key.
    """
    out = out or value
    seen = right.where(F.col(value).isNotNull()) if skip_null else right
    if dict(right.dtypes)[right_ts] != "date" or dict(left.dtypes)[left_ts] != "date":
        return _asof_times(left, seen, value, left_ts, key, right_ts, out)
    following = F.lead(right_ts).over(Window.partitionBy(key).orderBy(right_ts))
    spans = seen.where(F.col(right_ts).isNotNull()).select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.col(value).alias("_v"), following.alias("_next"))
    daily = spans.where("_next > _t").select("_k", F.explode(F.sequence("_t", F.date_sub("_next", 1))).alias("_d"), F.struct("_v").alias("_hit"))
    last = spans.where("_next is null").select(F.col("_k").alias("_lk"), F.col("_t").alias("_lt"), F.col("_v").alias("_lv"))  # one row per key
    met = left.join(daily, (F.col(key) == F.col("_k")) & (F.col(left_ts) == F.col("_d")), "left").join(last, F.col(key) == F.col("_lk"), "left")
    found = F.when(F.col(left_ts) >= F.col("_lt"), F.col("_lv")).otherwise(F.col("_hit._v"))
    return met.select(*[F.col(c) for c in left.columns if c != out], found.alias(out))


def _asof_times(left: DataFrame, right: DataFrame, value: str, left_ts: str, key: str, right_ts: str, out: str) -> DataFrame:
    marks = right.select(F.col(key), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"), F.lit(None).alias("_row").cast(left.select(F.struct("*").alias("s")).schema["s"].dataType))
    asks = left.select(F.col(key), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = marks.unionByName(asks).withColumn("_hit", F.last("_v", ignorenulls=True).over(w))
    return hit.where("_side = 1").select("_row.*", F.col("_hit.v").alias(out))


def map_to_calendar(df: DataFrame, day: str, calendar: DataFrame, how: str = "prior") -> DataFrame:
    """Adds session: the calendar day at or before (prior), at or after (next), or nearest (ties to the earlier); null where the calendar has none on that side.

    The distinct days of both sides are put in one order and looked at both ways; df meets the result by an equi-join on the day.
    """
    both = calendar.select(F.col("ts").alias("_d"), F.col("ts").alias("_s")).distinct().union(df.select(F.col(day), F.lit(None).cast("date")).where(F.col(day).isNotNull()).distinct())
    w = Window.orderBy("_d")  # one row per distinct day
    marks = both.groupBy("_d").agg(F.max("_s").alias("_s"))
    prior = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first("_s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = marks.select("_d", prior.alias("_p"), later.alias("_n"))
    near = F.when(F.col("_n").isNull() | (F.datediff("_d", "_p") <= F.datediff("_n", "_d")), F.col("_p")).otherwise(F.col("_n"))
    pick = {"prior": F.col("_p"), "next": F.col("_n"), "nearest": near}[how]
    return df.join(found.select("_d", pick.alias("session")), F.col(day) == F.col("_d"), "left").drop("_d")


def mask_outside(bars: DataFrame, intervals: DataFrame, field: str = "close") -> DataFrame:
    """Nulls field outside the symbol's [start_date, end_date]; open ends are null. Rows stay."""
    spans = intervals.groupBy("symbol").agg(F.collect_list(F.struct("start_date", "end_date")).alias("spans"))  # a symbol's listing periods
    inside = F.exists("spans", lambda s: (s["start_date"].isNull() | (F.col("ts") >= s["start_date"])) & (s["end_date"].isNull() | (F.col("ts") <= s["end_date"])))
    return bars.join(spans, "symbol", "left").withColumn(field, F.when(F.coalesce(inside, F.lit(False)), F.col(field))).drop("spans")


def expand_days(trades: DataFrame, start: str = "entry_date", end: str = "exit_date", weekdays_only: bool = False) -> DataFrame:
    """One row per trade and day in [start, end]."""
    out = trades.withColumn("day", F.explode(F.sequence(start, end)))
    return out.where(~F.dayofweek("day").isin(1, 7)) if weekdays_only else out
