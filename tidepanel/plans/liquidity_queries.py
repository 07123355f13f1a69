"""Queries of liquidity, expected execution, availability and folds; each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import align, liquidity
from tidepanel.plans.panel_queries import W, rounded
from tidepanel.sources.panel import BARS, TRADES, bars, trades

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


FF = f"({W} ROWS UNBOUNDED PRECEDING)"
LIQ = f"""{BARS}, lr AS (SELECT *, ln(close) - lag(ln(close)) OVER ({W}) AS r, close * volume AS dv FROM bars), s0 AS (SELECT *, CASE WHEN count(r) OVER f >= 10 THEN stddev_pop(r) OVER f END AS s, CASE WHEN count(dv) OVER f >= 10 THEN quantile_cont(dv, 0.5) OVER f END AS a,
CASE WHEN count(volume) OVER f >= 10 THEN quantile_cont(volume, 0.5) OVER f END AS v FROM lr WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), s1 AS (SELECT *, last_value(s IGNORE NULLS) OVER {FF} AS sigma, last_value(a IGNORE NULLS) OVER {FF} AS adv_usd, last_value(v IGNORE NULLS) OVER {FF} AS volume_median FROM s0),
s2 AS (SELECT *, CASE WHEN count(sigma) OVER f >= 10 THEN quantile_cont(sigma, 0.5) OVER f END AS m FROM s1 WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), liq AS (SELECT *, last_value(m IGNORE NULLS) OVER {FF} AS sigma_median FROM s2)"""


@query(f"WITH {LIQ} SELECT symbol, ts, round(sigma, 9) AS sigma, round(sigma_median, 9) AS sigma_median, round(adv_usd, 9) AS adv_usd, volume_median FROM liq")
def liquidity_stats(spark, sf_dir):
    out = liquidity.liquidity(bars(spark, sf_dir))
    return rounded(out.select("symbol", "ts", "sigma", "sigma_median", "adv_usd", "volume_median"), 9)


@query(f"""WITH {BARS}, {TRADES}, sh AS (SELECT symbol, ts, lag(close) OVER ({W}) AS close FROM bars) SELECT trade_id, round(s.close, 9) AS known_px FROM trades t ASOF LEFT JOIN sh s ON s.symbol = t.symbol AND s.ts <= t.entry_date""")
def shifted_asof(spark, sf_dir):
    """The close known one row before the last bar at or before the entry."""
    known = liquidity.shifted(bars(spark, sf_dir).select("symbol", "ts", "close"), "close")
    t = trades(spark, sf_dir).select("trade_id", "symbol", "entry_date")
    return rounded(align.asof(t, known, "close", "entry_date", out="known_px").select("trade_id", "known_px"), 9)


def adv_of(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"))


ADV = f"{BARS}, {TRADES}, adv AS (SELECT symbol, avg(close * volume) AS adv FROM bars GROUP BY symbol)"


@query(f"""WITH {ADV}, o AS (SELECT trade_id, greatest(0, round_even(qty / 3, 0)) AS n, exec_px AS p1, arrival_px AS p2, CASE WHEN trade_id % 9 > 0 THEN adv END AS adv FROM trades t JOIN adv a ON a.symbol = t.symbol), m AS (SELECT *, (p1 + p2) * n AS notional FROM o),
s AS (SELECT *, CASE WHEN NOT notional > 0 THEN 0.0 WHEN adv > 0 THEN least(0.02::DOUBLE, greatest(0.0, 0.0005::DOUBLE + 0.1::DOUBLE * sqrt(notional / adv))) ELSE 0.0005::DOUBLE END AS slip, CASE WHEN notional > 0 AND adv > 0 THEN greatest(0.05::DOUBLE, 1 / (1 + (5 * notional / adv) * (5 * notional / adv))) ELSE 1.0 END AS fp FROM m),
f AS (SELECT *, floor(n * fp + 1e-9) AS filled FROM s), c AS (SELECT *, notional * CASE WHEN n > 0 THEN filled / n ELSE 0.0 END AS done, least(0.0005::DOUBLE, slip) AS b FROM f), d AS (SELECT *, 2.0 + done * b + done * greatest(0.0, slip - b) AS raw FROM c)
SELECT trade_id, CAST(filled AS BIGINT) AS filled, round(slip, 9) AS slippage, round(fp, 9) AS fill_prob, round(greatest(0.0, 5.0 - raw), 6) AS topup, round(raw + greatest(0.0, 5.0 - raw), 6) AS total FROM d""")
def expected_execution(spark, sf_dir):
    o = trades(spark, sf_dir).join(adv_of(spark, sf_dir), "symbol").select("trade_id", (F.col("qty") / 3).alias("size"), F.col("exec_px").alias("price_1"), F.col("arrival_px").alias("price_2"), F.when(F.col("trade_id") % 9 > 0, F.col("adv")).alias("adv"))
    out = liquidity.expected_execution(o, min_fee=5.0)
    return rounded(out.select("trade_id", F.col("filled").cast("long").alias("filled"), "slippage", "fill_prob", "topup", "total"), 6, slippage=9, fill_prob=9)


@query(f"""WITH {TRADES} SELECT trade_id, round(greatest(3.0, CASE WHEN round_even(qty / 40, 0) > 0 THEN 2.5 ELSE 0.0 END + (exec_px + arrival_px) * round_even(qty / 40, 0) * (rate / 100)), 9) AS cost FROM trades""")
def event_costs(spark, sf_dir):
    cost = liquidity.event_cost(F.col("qty") / 40, F.col("exec_px"), F.col("arrival_px"), 1.25, F.col("rate") / 100, 3.0, fixed_without_fill=False)
    return rounded(trades(spark, sf_dir).select("trade_id", cost.alias("cost")), 9)


EDGES = f"""{BARS}, e0 AS (SELECT symbol AS pair, ts, CASE WHEN day(ts) % 5 > 0 THEN CASE WHEN day(ts) % 10 < 5 THEN 1 ELSE 0 END END AS pos, CASE WHEN day(ts) % 7 > 0 THEN close END AS y, open AS x, volume AS size FROM bars),
e1 AS (SELECT *, coalesce(last_value(pos IGNORE NULLS) OVER w, 0) AS p, last_value(y IGNORE NULLS) OVER w AS fy FROM e0 WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING)), e2 AS (SELECT *, coalesce(p <> lag(p) OVER (PARTITION BY pair ORDER BY ts), p <> 0) AS ch FROM e1), e3 AS (SELECT *, (abs(fy) + abs(x)) * size AS nt FROM e2)"""


@query(f"""WITH {EDGES} SELECT pair, CAST(count(*) FILTER (ch AND nt > 0) AS BIGINT) AS n_edges, CAST(sum(CAST(round(CASE WHEN ch THEN coalesce(2.0 + 0.01::DOUBLE * size + 0.001::DOUBLE * nt + 0.12::DOUBLE * sqrt(nt / 100000.0) * nt, 0.0) ELSE 0.0 END * 10000) AS BIGINT)) AS BIGINT) / 10000 AS cost FROM e3 GROUP BY pair""")
def edge_costs(spark, sf_dir):
    d = F.dayofmonth("ts")
    rows = bars(spark, sf_dir).select(F.col("symbol").alias("pair"), "ts", F.when(d % 5 > 0, F.when(d % 10 < 5, 1).otherwise(0)).alias("pos"), F.when(d % 7 > 0, F.col("close")).alias("y"), F.col("open").alias("x"), F.col("volume").alias("size"), F.lit(100000.0).alias("adv"))
    out = liquidity.edge_costs(rows, 1.0, 0.001, 0.01)
    return out.groupBy("pair").agg(F.count_if(F.col("cost") > 0).alias("n_edges"), (F.sum(F.round(F.col("cost") * 10000).cast("long")) / 10000).alias("cost"))


@query(f"""WITH {ADV} SELECT CASE WHEN side < 0 THEN CASE WHEN trade_id % 8 = 0 THEN 'missing_price' WHEN exec_px < 1000 THEN 'low_price' WHEN trade_id % 9 = 0 THEN 'missing_adv' WHEN adv < 55000 THEN 'low_adv' END END AS blocked, count(*) AS n FROM trades t JOIN adv a ON a.symbol = t.symbol GROUP BY ALL""")
def short_availability(spark, sf_dir):
    k = F.col("trade_id")
    legs = trades(spark, sf_dir).join(adv_of(spark, sf_dir), "symbol").select((F.col("side") * F.col("qty")).alias("notional"), F.lit(None).cast("double").alias("units"), F.when(k % 8 > 0, F.col("exec_px")).alias("price"), F.when(k % 9 > 0, F.col("adv")).alias("adv"))
    return liquidity.short_blocked(legs, 1000.0, 55000.0).groupBy("blocked").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BARS} SELECT DISTINCT ts AS date, upper(trim(symbol)) AS symbol, 'locate' AS type, 0.03::DOUBLE AS rate_annual, 12.0::DOUBLE AS locate_fee_bps, 2 AS lead_days FROM bars WHERE day(ts) = 1""")
def locate_events(spark, sf_dir):
    asked = bars(spark, sf_dir).where(F.dayofmonth("ts") == 1).select(F.concat(F.lit(" "), "symbol").alias("symbol"), F.col("ts").alias("day"))
    return liquidity.borrow_events(asked, F.lit(0.03), 12.0, 2)


@query(f"WITH {BARS}, e AS (SELECT symbol, count(*) AS n, count(*) FILTER (symbol = 'Brand#3' AND day(ts) = 7) AS d FROM bars GROUP BY symbol HAVING count(*) >= 5) SELECT count(*) AS compared, CAST(count(*) FILTER (d = 0) AS BIGINT) AS equal, count(*) FILTER (d = 0) = count(*) AS suspicious FROM e")
def unadjusted_check(spark, sf_dir):
    b = bars(spark, sf_dir)
    split = (F.col("symbol") == "Brand#3") & (F.dayofmonth("ts") == 7)
    return liquidity.unadjusted_differs(b, b.withColumn("close", F.when(split, F.col("close") * 2).otherwise(F.col("close"))))


@query(f"WITH {BARS}, h AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) < 1500) SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN (SELECT symbol FROM h)")
def complete_history(spark, sf_dir):
    b = bars(spark, sf_dir)
    short = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n < 1500")
    return liquidity.drop_missing_history(b.select("symbol").distinct(), short, allowed=True)


@query(f"""WITH {BARS}, x AS (SELECT symbol, ts, close FROM bars WHERE day(ts) <= 20), y AS (SELECT symbol, ts, volume FROM bars WHERE day(ts) >= 10) SELECT coalesce(x.symbol, y.symbol) AS symbol, count(*) AS n, count(close) AS n_close, count(volume) AS n_volume FROM x FULL JOIN y ON x.symbol = y.symbol AND x.ts = y.ts GROUP BY ALL""")
def panels_side_by_side(spark, sf_dir):
    b, d = bars(spark, sf_dir), F.dayofmonth("ts")
    both = liquidity.full_outer(b.where(d <= 20).select("symbol", "ts", "close"), b.where(d >= 10).select("symbol", "ts", "volume"), ["symbol", "ts"])
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("n_close"), F.count("volume").alias("n_volume"))
