"""Queries that replay tables as streams. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.plans.panel_queries import POSITIONS, rounded, scored
from tidepanel.plans.research_queries import query as _query
from tidepanel.streaming import live, machines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    return _query(sql, QUERIES, ORACLE)


def replayed(spark, sf_dir) -> DataFrame:
    """What the position machine emits on the scores of all bars, with settlements two sessions after each exit."""
    scores = scored(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = [r.ts for r in scores.select("ts").distinct().orderBy("ts").collect()]  # the calendar's days
    return machines.drained(spark, machines.positions(machines.as_stream(scores, "ts"), sessions))


@query(f"WITH RECURSIVE {POSITIONS} SELECT symbol, ts, round(z, 6) AS z, pos FROM walk")
def streaming_positions(spark, sf_dir):
    """Positions by keyed state and timers, the same as those of position_states."""
    out = replayed(spark, sf_dir).where("kind = 'position'")
    return rounded(out.select("symbol", F.to_date("ts").alias("ts"), "z", "pos"))


@query(f"""WITH RECURSIVE {POSITIONS}, e AS (SELECT symbol, ts, pos, lag(pos) OVER (PARTITION BY symbol ORDER BY ts) AS q FROM walk), cal AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars))
SELECT symbol, e.ts AS exit_ts, s.ts AS settles FROM e JOIN cal c ON c.ts = e.ts JOIN cal s ON s.i = least(c.i + 2, c.n) WHERE q <> 0 AND pos = 0""")
def streaming_settlements(spark, sf_dir):
    """Exits and their settlement days, emitted by timers."""
    out = replayed(spark, sf_dir).where("kind = 'settled'")
    return out.select("symbol", F.to_date("exit_ts").alias("exit_ts"), F.to_date("ts").alias("settles"))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS slot, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT * FROM h WHERE slot + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def streaming_last_versions(spark, sf_dir):
    """Of each user's events of an hour the last one, emitted once the watermark has passed the hour."""
    events = live.event_stream(spark, sf_dir).withColumn("slot", F.window("ts", "1 hour"))
    out = machines.drained(spark, machines.last_versions(events, ["user_id"], "slot", "event_id", ["event_type", "value"]))
    return rounded(out.select("user_id", F.col("slot.start").alias("slot"), "event_type", "value", "event_id"))
