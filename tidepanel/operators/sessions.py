"""Trading sessions within the day: bars from opening hours in a time zone, and grids that unite them with what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekdays(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """day: the weekdays on which there are rows."""
    return rows.select(F.to_date(ts).alias("day")).distinct().where(F.weekday("day") < 5)


def session_bars(days: DataFrame, minutes: int, opens: str = "09:30", closes: str = "16:00", zone: str = "America/New_York") -> DataFrame:
    """day, ts: bars of so many minutes from the opening up to the closing hour of each day, in UTC (the session's time zone). Hours are those of the zone, so bars move with its daylight saving. days: day."""
    at = lambda clock: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.lit(f"{clock}:00"))), zone)
    last = at(closes) - F.expr(f"INTERVAL {minutes} MINUTES")
    return days.select("day", F.explode(F.when(at(opens) <= last, F.sequence(at(opens), last, F.expr(f"INTERVAL {minutes} MINUTES"))).otherwise(F.array().cast("array<timestamp>"))).alias("ts"))


def union_of(*grids: DataFrame) -> DataFrame:
    """ts: every time of any of the grids, once."""
    out = grids[0].select("ts")
    for g in grids[1:]:
        out = out.union(g.select("ts"))
    return out.distinct()


def on_union(panel: DataFrame, bars: DataFrame) -> DataFrame:
    """The panel (symbol, ts, ...) on the union of its own times and the session bars, for every symbol, with tradable: whether the time is a session bar. Each symbol's rows are made by exploding one day's times,
    so the symbols meet a day's list and not every time."""
    inside = bars.select("ts").distinct().withColumn("tradable", F.lit(True))
    times = union_of(panel, bars).join(inside, "ts", "left").withColumn("tradable", F.coalesce("tradable", F.lit(False)))
    per_day = times.groupBy(F.to_date("ts").alias("_day")).agg(F.collect_list(F.struct("ts", "tradable")).alias("_at"))  # one day's times
    symbols = panel.agg(F.collect_set("symbol").alias("_symbols"))  # one row: the panel's symbols
    grid = per_day.join(F.broadcast(symbols)).select(F.explode("_symbols").alias("symbol"), "_at").select("symbol", F.inline("_at"))
    return grid.join(panel, ["symbol", "ts"], "left")
