"""Queries over the daily bars: cleaning, windows, alignment, universe, statistics, signals. Each has its SQL beside it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions import rolling as R
from tidepanel.functions import scalars as S
from tidepanel.operators import align, clean, covariance, reports, signals, stats, universe, validation
from tidepanel.operators.storage import Rounds
from tidepanel.sources.panel import BARS, bars, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, n: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, so sums in another order agree; zeros without sign."""
    return df.select(*[(F.round(F.col(c), other.get(c, n)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with planted defects: missing closes, crossed and low highs, zero volumes, spikes; by day of month and symbol number."""
    k = F.dayofmonth("ts") + F.substring("symbol", 7, 2).cast("int")
    return bars(spark, sf_dir).withColumns({
        "close": F.when(k % 11 == 0, None).when(k % 19 == 0, F.col("close") * 10).otherwise(F.col("close")),
        "high": F.when(k % 17 == 0, F.col("low") * 0.9).when(k % 23 == 0, F.least("open", "low") * 1.0).otherwise(F.col("high")),
        "volume": F.when(k % 13 == 0, 0.0).otherwise(F.col("volume")),
    })


K = "(day(ts) + CAST(substr(symbol, 7, 2) AS INT))"
RAW = f"""{BARS}, raw AS (SELECT symbol, ts, open, CASE WHEN {K} % 17 = 0 THEN low * 0.9::DOUBLE WHEN {K} % 23 = 0 THEN least(open, low) ELSE high END AS high, low,
CASE WHEN {K} % 11 = 0 THEN NULL WHEN {K} % 19 = 0 THEN close * 10 ELSE close END AS close, CASE WHEN {K} % 13 = 0 THEN 0.0 ELSE volume END AS volume FROM bars)"""
GRID = f"{RAW}, grid AS (SELECT s.symbol, d.ts, r.open, r.high, r.low, r.close, r.volume FROM (SELECT DISTINCT symbol FROM raw) s CROSS JOIN (SELECT DISTINCT ts FROM raw) d LEFT JOIN raw r ON r.symbol = s.symbol AND r.ts = d.ts)"
W = "PARTITION BY symbol ORDER BY ts"
#: z enters at 2 and stops at 4; q is the z before.
ENTERS = "((z <= -2 AND z > -4 AND (q IS NULL OR q > -2)) OR (z >= 2 AND z < 4 AND (q IS NULL OR q < 2)))"


@query(f"""WITH {BARS}, s AS (SELECT symbol, ts, ln(close) AS x FROM bars), v AS (SELECT symbol, ts, x - lag(x) OVER ({W}) AS ret FROM s),
z AS (SELECT symbol, ts, CASE WHEN count(ret) OVER p >= 10 AND stddev_pop(ret) OVER p > 0 THEN (ret - avg(ret) OVER p) / stddev_pop(ret) OVER p END AS z FROM v WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, lag(z) OVER ({W}) AS q FROM z)
SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n_entries, CAST(sum(CASE WHEN z > 0 THEN -1 ELSE 1 END) AS BIGINT) AS net_side FROM e WHERE {ENTERS} GROUP BY ALL""")
def zscore_entries(spark, sf_dir):
    """Entry crossings of the past-only z-score of log returns, by symbol and month."""
    ret = bars(spark, sf_dir).select("symbol", "ts", R.log_return(F.col("close")).alias("ret"))
    z = ret.select("symbol", "ts", R.past_zscore(F.col("ret"), 20, 10).alias("z"))
    return signals.entries(z, 2.0, 4.0).groupBy("symbol", F.trunc("ts", "month").alias("month")).agg(F.count(F.lit(1)).alias("n_entries"), F.sum("side").alias("net_side"))


@query(f"WITH {BARS} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def bars_panel(spark, sf_dir):
    return rounded(bars(spark, sf_dir))


@query(f"""WITH {RAW}, e AS (SELECT *, 1e-9 + 1e-9 * greatest(abs(open), abs(high), abs(low), abs(close)) AS eps FROM raw),
f AS (SELECT *, coalesce(high < low - eps, false) AS a, coalesce(high < greatest(open, close, low) - eps, false) AS b, coalesce(low > least(open, close, high) + eps, false) AS c FROM e)
SELECT symbol, ts, CASE WHEN a THEN 'high_below_low' WHEN b THEN 'high_too_low' WHEN c THEN 'low_too_high' END AS rule,
round(CASE WHEN NOT a AND open > 1e-9 THEN open END, 6) AS open, round(CASE WHEN NOT (a OR b) AND high > 1e-9 THEN high END, 6) AS high, round(CASE WHEN NOT (a OR c) AND low > 1e-9 THEN low END, 6) AS low, round(CASE WHEN NOT a AND close > 1e-9 THEN close END, 6) AS close FROM f""")
def ohlc_mask(spark, sf_dir):
    return rounded(clean.mask_ohlc(raw_bars(spark, sf_dir)).select("symbol", "ts", "rule", "open", "high", "low", "close"))


CAUSAL = f"""{RAW}, p AS (SELECT *, row_number() OVER ({W}) AS pos FROM raw), l AS (SELECT *, last_value(close IGNORE NULLS) OVER b AS lv, last_value(CASE WHEN close IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS lp FROM p WINDOW b AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cr AS (SELECT *, CASE WHEN pos - lp <= 6 THEN close / lv - 1 END AS ret FROM l)"""


@query(f"WITH {CAUSAL} SELECT symbol, ts, round(ret, 6) AS ret FROM cr")
def causal_return(spark, sf_dir):
    return rounded(clean.causal_return(raw_bars(spark, sf_dir)).select("symbol", "ts", "ret"))


@query(f"""WITH {CAUSAL}, m AS (SELECT *, CASE WHEN count(ret) OVER t >= 10 THEN quantile_cont(ret, 0.5) OVER t END AS med FROM cr WINDOW t AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, abs(ret - med) AS dev FROM m), s AS (SELECT *, 1.4826 * CASE WHEN count(dev) OVER t >= 10 THEN quantile_cont(dev, 0.5) OVER t END AS sc FROM d WINDOW t AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
o AS (SELECT *, coalesce(abs((ret - med) / nullif(sc, 0)) > 8, false) AS outlier FROM s)
SELECT symbol, ts, outlier, round(CASE WHEN NOT outlier THEN close END, 6) AS close FROM o""")
def outlier_scrub(spark, sf_dir):
    return rounded(clean.scrub_outliers(raw_bars(spark, sf_dir)).select("symbol", "ts", "outlier", "close"))


@query(f"WITH {RAW}, x AS (SELECT *, coalesce(abs(close / lag(close) OVER ({W}) - 1) > 0.5, false) AS capped FROM raw) SELECT symbol, ts, capped, round(CASE WHEN NOT capped THEN close END, 6) AS close FROM x")
def return_cap(spark, sf_dir):
    return rounded(clean.cap_returns(raw_bars(spark, sf_dir), 0.5).select("symbol", "ts", "capped", "close"))


@query(f"""WITH RECURSIVE {RAW}, rn AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER ({W}) AS k FROM raw), walk AS (SELECT symbol, ts, k, close AS c, close AS kept FROM rn WHERE k = 1 UNION ALL
SELECT n.symbol, n.ts, n.k, CASE WHEN n.close IS NULL THEN NULL WHEN w.kept IS NULL THEN n.close ELSE least(greatest(n.close, w.kept * 0.8::DOUBLE), w.kept * 1.2::DOUBLE) END,
CASE WHEN n.close IS NULL THEN w.kept WHEN w.kept IS NULL THEN n.close ELSE least(greatest(n.close, w.kept * 0.8::DOUBLE), w.kept * 1.2::DOUBLE) END FROM walk w JOIN rn n ON n.symbol = w.symbol AND n.k = w.k + 1)
SELECT symbol, ts, round(c, 6) AS close FROM walk""")
def return_clip(spark, sf_dir):
    return rounded(clean.clip_returns(raw_bars(spark, sf_dir), 0.2))


@query(f"WITH {RAW} SELECT symbol, count(*) AS n, CAST(count(*) FILTER (volume = 0 AND close > 0) AS BIGINT) AS n_zero, round(sum(CASE WHEN volume = 0 AND close > 0 THEN NULL ELSE volume END), 2) AS volume FROM raw GROUP BY symbol")
def zero_volume_rule(spark, sf_dir):
    out = clean.zero_volume(raw_bars(spark, sf_dir))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if("zero_volume").alias("n_zero"), F.round(F.sum("volume"), 2).alias("volume"))


@query(f"""WITH {RAW}, a AS (SELECT symbol, ts, open, CASE WHEN high IS NOT NULL THEN greatest(high, close) END AS h0, CASE WHEN low IS NOT NULL THEN least(low, close) END AS low, close FROM raw), b AS (SELECT *, CASE WHEN low > h0 THEN low ELSE h0 END AS high FROM a)
SELECT symbol, ts, round(CASE WHEN open IS NOT NULL THEN greatest(least(open, coalesce(high, open)), coalesce(low, open)) END, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close FROM b""")
def ohlc_reconcile(spark, sf_dir):
    return rounded(clean.reconcile(raw_bars(spark, sf_dir)).select("symbol", "ts", "open", "high", "low", "close"))


RUNS = f"""{GRID}, g1 AS (SELECT symbol, ts, close, row_number() OVER ({W}) AS pos, count(*) OVER (PARTITION BY symbol) AS n_rows FROM grid), g2 AS (SELECT *, pos - row_number() OVER ({W}) AS island FROM g1 WHERE close IS NULL),
runs AS (SELECT symbol, island, min(ts) AS start, max(ts) AS "end", count(*) AS length, min(pos) > 1 AS before, max(pos) < max(n_rows) AS after FROM g2 GROUP BY symbol, island)"""


@query(f'WITH {RUNS} SELECT symbol, start, "end", length, before, after FROM runs')
def null_runs(spark, sf_dir):
    return clean.null_runs(align.on_grid(raw_bars(spark, sf_dir)))


COVER = f"""{RUNS}, cov AS (SELECT symbol, count(*) AS n_rows, avg(CASE WHEN close IS NOT NULL THEN 1.0 ELSE 0.0 END) AS present, CAST(coalesce(min(CASE WHEN close IS NOT NULL THEN pos END) - 1, count(*)) AS BIGINT) AS lead_na, CAST(coalesce(count(*) - max(CASE WHEN close IS NOT NULL THEN pos END), count(*)) AS BIGINT) AS trail_na FROM g1 GROUP BY symbol),
cover AS (SELECT c.*, coalesce(x.longest_gap, 0) AS longest_gap FROM cov c LEFT JOIN (SELECT symbol, max(length) AS longest_gap FROM runs GROUP BY symbol) x ON c.symbol = x.symbol)"""


@query(f"""WITH {COVER}, q AS (SELECT symbol, n_rows, round(present, 6) AS present, lead_na, trail_na, longest_gap, CASE WHEN present < 0.55 THEN 'coverage' WHEN lead_na > 3 THEN 'leading' WHEN trail_na > 3 THEN 'trailing' WHEN longest_gap > 8 THEN 'gap' END AS reason FROM cover) SELECT *, reason IS NULL AS kept FROM q""")
def coverage_gates(spark, sf_dir):
    stats_ = clean.coverage(align.on_grid(raw_bars(spark, sf_dir)))
    return rounded(clean.gate(stats_, 0.55, 3, 3, 8))


@query(f"""WITH {GRID}, a AS (SELECT symbol, ts, close, row_number() OVER ({W}) AS pos FROM grid), b AS (SELECT *, CASE WHEN close IS NULL THEN pos - sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER ({W}) END AS island FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY symbol, island) AS len, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lv, max(CASE WHEN close IS NOT NULL THEN pos END) OVER (PARTITION BY symbol) AS top FROM b),
d AS (SELECT *, close IS NULL AND len <= 3 AND lv IS NOT NULL AND pos < top AS filled FROM c)
SELECT symbol, CAST(count(*) FILTER (filled) AS BIGINT) AS n_filled, count(CASE WHEN filled THEN lv ELSE close END) AS n_present, round(sum(CASE WHEN filled THEN lv ELSE close END), 2) AS total FROM d GROUP BY symbol""")
def causal_fill(spark, sf_dir):
    out = clean.causal_fill(align.on_grid(raw_bars(spark, sf_dir)), 3)
    return out.groupBy("symbol").agg(F.count_if("filled").alias("n_filled"), F.count("close").alias("n_present"), F.round(F.sum("close"), 2).alias("total"))


@query(f"""WITH {BARS}, x AS (SELECT symbol, ts, floor(close / 200) AS b FROM bars), y AS (SELECT *, CASE WHEN b = lag(b) OVER ({W}) THEN 1 ELSE 0 END AS s FROM x)
SELECT symbol, ts FROM (SELECT *, sum(s) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM y) WHERE c = 3""")
def stale_runs(spark, sf_dir):
    rows = bars(spark, sf_dir).select("symbol", "ts", F.floor(F.col("close") / 200).alias("level"))
    return clean.stale_rows(rows, 3, "level").where("stale").select("symbol", "ts")


@query(f"WITH {RAW}, f AS (SELECT DISTINCT symbol, ts FROM raw WHERE extract(isodow FROM ts) = 5) SELECT r.symbol, count(*) AS n, count(CASE WHEN f.ts IS NULL THEN r.close END) AS n_close FROM raw r LEFT JOIN f ON f.symbol = r.symbol AND f.ts = r.ts GROUP BY r.symbol")
def flag_mask(spark, sf_dir):
    rows = raw_bars(spark, sf_dir)
    flags = rows.where(F.dayofweek("ts") == 6).select("symbol", "ts", F.lit(True).alias("flag"))
    return clean.mask_flags(rows, flags).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("n_close"))


@query(f"WITH {GRID} SELECT symbol, count(*) AS n, count(close) AS n_close, min(ts) AS first_ts, max(ts) AS last_ts FROM grid GROUP BY symbol")
def grid_union(spark, sf_dir):
    return align.on_grid(raw_bars(spark, sf_dir)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("n_close"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {RAW}, b AS (SELECT symbol FROM raw WHERE close IS NOT NULL GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 1), d AS (SELECT DISTINCT ts FROM raw WHERE close IS NOT NULL AND symbol IN (SELECT symbol FROM b))
SELECT s.symbol, count(*) AS n, count(r.close) AS n_close FROM (SELECT DISTINCT symbol FROM raw) s CROSS JOIN d LEFT JOIN raw r ON r.symbol = s.symbol AND r.ts = d.ts GROUP BY s.symbol""")
def grid_leader(spark, sf_dir):
    return align.on_grid(raw_bars(spark, sf_dir), "leader").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("n_close"))


@query(f"""WITH {RAW}, i AS (SELECT DISTINCT symbol, CASE WHEN CAST(substr(symbol, 7, 2) AS INT) % 3 = 0 THEN NULL ELSE DATE '1996-01-01' END AS a, CASE WHEN CAST(substr(symbol, 7, 2) AS INT) % 5 = 0 THEN NULL ELSE DATE '1999-06-30' END AS b FROM raw)
SELECT r.symbol, count(*) AS n, count(CASE WHEN (a IS NULL OR ts >= a) AND (b IS NULL OR ts <= b) THEN close END) AS n_close FROM raw r JOIN i ON i.symbol = r.symbol GROUP BY r.symbol""")
def universe_intervals(spark, sf_dir):
    rows = raw_bars(spark, sf_dir)
    no = F.substring("symbol", 7, 2).cast("int")
    spans = rows.select("symbol").distinct().select("symbol", F.when(no % 3 != 0, F.lit(dt.date(1996, 1, 1))).alias("start_date"), F.when(no % 5 != 0, F.lit(dt.date(1999, 6, 30))).alias("end_date"))
    return align.mask_outside(rows, spans).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("n_close"))


@query(f"""WITH {RAW}, v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS q FROM raw WHERE close > 0 AND volume > 0)
SELECT symbol, round(quantile_cont(close * volume, 0.5), 4) AS adv, round(quantile_cont(close, 0.5), 6) AS price, round(avg(volume), 6) AS volume, count(*) AS days FROM v WHERE q <= 60 GROUP BY symbol HAVING count(*) >= 30""")
def adv_map(spark, sf_dir):
    return rounded(universe.adv(raw_bars(spark, sf_dir), 60), adv=4)


@query(f"""WITH {RAW}, a AS (SELECT symbol, ts, close * volume AS x FROM raw), b AS (SELECT symbol, ts, CASE WHEN count(x) OVER t >= 10 THEN quantile_cont(x, 0.5) OVER t END AS adv FROM a WINDOW t AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
c AS (SELECT symbol, count(adv) AS n, CAST(count(*) FILTER (adv >= 30000) AS BIGINT) AS n_ok FROM b GROUP BY symbol)
SELECT symbol, n, n_ok, round(coalesce(n_ok / n, 0), 6) AS share, coalesce(n_ok / n, 0) >= 0.5 AS passes FROM c""")
def adv_gates(spark, sf_dir):
    return rounded(universe.adv_gate(universe.rolling_adv(raw_bars(spark, sf_dir), 20, 10), 30000.0, 0.5))


@query(f"""WITH {BARS}, v AS (SELECT symbol, ts, ln(close) - lag(ln(close)) OVER ({W}) AS ret FROM bars), s AS (SELECT symbol, ts, CASE WHEN count(ret) OVER t >= 10 THEN stddev_pop(ret) OVER t END AS sg FROM v WINDOW t AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, round(last_value(sg IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS sigma FROM s""")
def rolling_sigma(spark, sf_dir):
    ret = bars(spark, sf_dir).select("symbol", "ts", R.log_return(F.col("close")).alias("ret"))
    sg = ret.select("symbol", "ts", R.at_least(F.stddev_pop("ret"), F.col("ret"), R.trailing(20), 10).alias("sg"))
    return rounded(sg.select("symbol", "ts", R.ffill(F.col("sg")).alias("sigma")))


@query(f"""WITH {BARS}, z AS (SELECT symbol, ts, CASE WHEN count(close) OVER t >= 10 AND stddev_pop(close) OVER t > 0 THEN (close - avg(close) OVER t) / stddev_pop(close) OVER t END AS z FROM bars WINDOW t AS ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT symbol, ts, round(z, 6) AS z FROM z""")
def inclusive_zscore(spark, sf_dir):
    return rounded(bars(spark, sf_dir).select("symbol", "ts", R.inclusive_zscore(F.col("close"), 30, 10).alias("z")))


@query(f"""WITH {BARS}, a AS (SELECT symbol, ts, close, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
w AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((i - 84 + 1) / 21.0) AS BIGINT)), least(i // 21, (n - 84) // 21))) AS window_id FROM a WHERE n >= 84)
SELECT symbol, CAST(window_id AS INT) AS window_id, count(*) AS n, round(avg(close), 6) AS mean_close, min(ts) AS first_ts FROM w GROUP BY symbol, window_id""")
def hopping_windows(spark, sf_dir):
    out = stats.hopping(bars(spark, sf_dir).select("symbol", "ts", "close"), 84, 21)
    return rounded(out.groupBy("symbol", "window_id").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close"), F.min("ts").alias("first_ts")))


@query(f"""WITH {BARS}, a AS (SELECT symbol, avg(volume * close) AS value FROM bars GROUP BY symbol), b AS (SELECT *, row_number() OVER (ORDER BY value, symbol) AS q, count(*) OVER () AS n FROM a)
SELECT symbol, CAST(greatest(1, ceil((q - 1) * 10 / (n - 1))) AS INT) AS bucket FROM b""")
def rank_buckets(spark, sf_dir):
    a = bars(spark, sf_dir).groupBy("symbol").agg(F.avg(F.col("volume") * F.col("close")).alias("value"))
    return a.select("symbol", R.rank_bucket(["value", "symbol"], 10).alias("bucket"))


RET = f"""{BARS}, ret0 AS (SELECT symbol, ts, close, ln(close) - lag(ln(close)) OVER ({W}) AS ret FROM bars), fit AS (SELECT symbol FROM ret0 GROUP BY symbol HAVING avg(CASE WHEN close > 0 THEN 1.0 ELSE 0.0 END) >= 0.99 AND avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5),
rets AS (SELECT symbol, ts, ret FROM ret0 WHERE ret IS NOT NULL AND symbol IN (SELECT symbol FROM fit))"""
CORR = f'{RET}, corrs AS (SELECT a.symbol AS "left", b.symbol AS "right", count(*) AS n, corr(a.ret, b.ret) AS corr FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY ALL HAVING count(*) >= 20)'


@query(f'WITH {CORR} SELECT "left", "right", n, round(corr, 6) AS corr FROM corrs')
def pair_correlations(spark, sf_dir):
    return rounded(stats.pair_correlations(stats.returns(bars(spark, sf_dir))))


@query(f"""WITH {CORR}, p AS (SELECT "left", "right", exp(-n * corr * corr / 2) AS p FROM corrs), k AS (SELECT *, row_number() OVER (ORDER BY p, "left", "right") AS q, count(*) OVER () AS n FROM p),
h AS (SELECT sum(1.0 / q) AS h FROM k), bh AS (SELECT max(p) AS c FROM k WHERE p <= q / n * 0.1::DOUBLE), byc AS (SELECT max(p) AS c FROM k, h WHERE p <= q / n * 0.1::DOUBLE / h)
SELECT "left", "right", round(p, 6) AS p, coalesce(p <= (SELECT c FROM bh), false) AS bh, coalesce(p <= (SELECT c FROM byc), false) AS "by" FROM k""")
def false_discovery(spark, sf_dir):
    p = stats.pair_correlations(stats.returns(bars(spark, sf_dir))).select("left", "right", F.exp(-F.col("n") * F.col("corr") * F.col("corr") / 2).alias("p"))
    p = Rounds(spark, "p-values").put(p)  # read several times
    bh = stats.false_discovery(p, "p", 0.1).withColumnRenamed("rejected", "bh")
    by = stats.false_discovery(p, "p", 0.1, dependent=True).select("left", "right", F.col("rejected").alias("by"))
    return rounded(bh.join(by, ["left", "right"]))


def neighbour_pairs(spark, sf_dir) -> DataFrame:
    """pair, ts, y, x: closes of each symbol against the next one on common days."""
    b = bars(spark, sf_dir).select("symbol", "ts", "close")
    n = b.select("symbol").distinct().withColumn("no", F.row_number().over(Window.orderBy("symbol")))  # one row per symbol
    y = b.join(F.broadcast(n), "symbol").select(F.col("symbol").alias("a"), "no", "ts", F.col("close").alias("y"))
    x = b.join(F.broadcast(n), "symbol").select(F.col("symbol").alias("b"), (F.col("no") - 1).alias("no"), "ts", F.col("close").alias("x"))
    return y.join(x, ["no", "ts"]).select(S.canonical_pair(F.col("a"), F.col("b")).alias("pair"), "ts", "y", "x")


NEIGHBOURS = f"""{BARS}, no AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS no FROM (SELECT DISTINCT symbol FROM bars)), np AS (SELECT a.symbol || '-' || b.symbol AS pair, a.ts, a.close AS y, b.close AS x
FROM bars a JOIN no na ON na.symbol = a.symbol JOIN no nb ON nb.no = na.no + 1 JOIN bars b ON b.symbol = nb.symbol AND b.ts = a.ts)"""


@query(f"""WITH {NEIGHBOURS}, f AS (SELECT pair, regr_slope(y, x) AS beta, regr_intercept(y, x) AS a FROM np GROUP BY pair), s AS (SELECT np.pair, ts, beta, y - a - beta * x AS s FROM np JOIN f ON f.pair = np.pair), l AS (SELECT *, lag(s) OVER (PARTITION BY pair ORDER BY ts) AS l FROM s),
m AS (SELECT pair, any_value(beta) AS beta, sum(l * (s - l)) / sum(l * l) AS lam FROM l GROUP BY pair) SELECT pair, round(beta, 6) AS beta, round(lam, 6) AS lam, round(CASE WHEN lam > -1 AND lam < 0 THEN -ln(2) / ln(1 + lam) END, 6) AS half_life FROM m""")
def pair_half_life(spark, sf_dir):
    return rounded(stats.half_life(neighbour_pairs(spark, sf_dir)))


def all_pairs(spark, sf_dir) -> DataFrame:
    """pair, ts, y, x: closes of every two symbols on their common days."""
    return stats.day_pairs(bars(spark, sf_dir)).select(S.canonical_pair(F.col("a"), F.col("b")).alias("pair"), "ts", "y", "x")


ALL_PAIRS = f"""{BARS}, np AS (SELECT a.symbol || '-' || b.symbol AS pair, a.ts, a.close AS y, b.close AS x FROM bars a JOIN bars b ON b.ts = a.ts AND a.symbol < b.symbol)"""


@query(ORACLE["pair_half_life"].replace(NEIGHBOURS, ALL_PAIRS))
def all_pair_half_life(spark, sf_dir):
    return rounded(stats.half_life(all_pairs(spark, sf_dir)))


def window_correlations(spark, sf_dir) -> DataFrame:
    """Shrunk correlations of all symbols' pairs. Few days have a bar of every symbol at small scales, so prices are carried over days without one."""
    return covariance.shrunk_correlations(stats.every_day(stats.returns(bars(spark, sf_dir))), 42, 21, block=8)


#: Correlations of each window, shrunk (wc: window_id, left, right, corr).
SHRUNK = f"""{RET}, ed AS (SELECT f.symbol, d.ts, coalesce(r.ret, 0) AS ret FROM (SELECT symbol, min(ts) AS f FROM rets GROUP BY symbol) f JOIN (SELECT DISTINCT ts FROM rets) d ON d.ts >= f.f LEFT JOIN rets r ON r.symbol = f.symbol AND r.ts = d.ts),
wd AS (SELECT ts FROM ed GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ed)), wi AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM wd),
ww AS (SELECT ts, unnest(range(greatest(0, ceil((i - 41) / 21.0)::BIGINT), least(i // 21, (n - 42) // 21) + 1)) AS window_id FROM wi WHERE n >= 42),
x AS MATERIALIZED (SELECT window_id, symbol, ts, ret - avg(ret) OVER (PARTITION BY window_id, symbol) AS x FROM ed JOIN ww USING (ts)),
cov AS MATERIALIZED (SELECT a.window_id, a.symbol AS l, b.symbol AS r, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q FROM x a JOIN x b ON a.window_id = b.window_id AND a.ts = b.ts AND a.symbol <= b.symbol GROUP BY ALL),
sh AS (SELECT window_id, count(*) FILTER (l = r) AS p, sum(s) FILTER (l = r) AS trace, sum(CASE WHEN l = r THEN 1 ELSE 2 END * s * s) AS ss, sum(CASE WHEN l = r THEN 1 ELSE 2 END * (q - s * s)) AS noise FROM cov GROUP BY window_id),
sk AS (SELECT window_id, trace / p AS mu, (ss - p * (trace / p) * (trace / p)) / p AS delta, least((ss - p * (trace / p) * (trace / p)) / p, noise / (42 * p)) AS beta FROM sh),
sc AS MATERIALIZED (SELECT cov.window_id, l, r, (1 - CASE WHEN beta <= 0 THEN 0 ELSE beta / delta END) * s + CASE WHEN l = r AND beta > 0 THEN beta / delta * mu ELSE 0 END AS s FROM cov JOIN sk USING (window_id)),
wc AS MATERIALIZED (SELECT a.window_id, a.l AS "left", a.r AS "right", greatest(-1, least(1, coalesce(a.s / nullif(sqrt(x.s) * sqrt(y.s), 0), 0))) AS corr FROM sc a JOIN sc x ON x.window_id = a.window_id AND x.l = a.l AND x.r = a.l JOIN sc y ON y.window_id = a.window_id AND y.l = a.r AND y.r = a.r WHERE a.l < a.r),
pp AS (SELECT "left", "right", count(*) AS n, avg(corr) AS mean_corr, avg(CASE WHEN corr >= 0.1 THEN 1.0 ELSE 0.0 END) AS pct1, avg(CASE WHEN corr >= 0.2 THEN 1.0 ELSE 0.0 END) AS pct2 FROM wc GROUP BY ALL)"""

#: Resampled means of each pair's windows, by keyed draws (bs: left, right, n, mean, ci_low, ci_high, p).
BOOTSTRAP = f"""{SHRUNK}, nw AS (SELECT count(DISTINCT window_id) AS n FROM wc), bt AS (SELECT b, n, unnest(range(n)) AS t FROM range(200) r(b), nw),
dr AS (SELECT b, n, t, t = 0 OR ('0x' || substr(md5('42:f:' || b || ':' || t), 1, 8))::BIGINT * 5 < 4294967296 AS fresh, ('0x' || substr(md5('42:s:' || b || ':' || t), 1, 8))::BIGINT % n AS start FROM bt),
hd AS (SELECT *, max(CASE WHEN fresh THEN t END) OVER (PARTITION BY b ORDER BY t) AS head FROM dr), wt AS MATERIALIZED (SELECT h.b, (s.start + h.t - h.head) % h.n AS i, count(*) AS k FROM hd h JOIN hd s ON s.b = h.b AND s.t = h.head GROUP BY ALL),
bm AS (SELECT "left", "right", b, sum(k * corr) / (SELECT n FROM nw) AS m FROM wc JOIN wt ON wt.i = window_id GROUP BY ALL),
bs AS (SELECT "left", "right", any_value(n) AS n, any_value(mean_corr) AS mean, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, (count(*) FILTER (m - mean_corr >= mean_corr) + 1) / 201 AS p FROM bm JOIN pp USING ("left", "right") GROUP BY ALL)"""


@query(f'WITH {SHRUNK} SELECT "left", "right", n, round(mean_corr, 6) AS mean_corr, round(pct1, 6) AS pct1, round(pct2, 6) AS pct2 FROM pp')
def shrunk_pair_persistence(spark, sf_dir):
    return rounded(stats.pair_persistence(window_correlations(spark, sf_dir), 0.1, 0.2))


@query(f'WITH {BOOTSTRAP} SELECT "left", "right", n, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p FROM bs')
def bootstrap_pairs(spark, sf_dir):
    return rounded(covariance.bootstrap_pairs(window_correlations(spark, sf_dir), 200))


def scored(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "ts", R.past_zscore(F.col("close"), 20, 10).alias("z"))


SCORED = f"""{BARS}, scored AS (SELECT symbol, ts, CASE WHEN count(close) OVER p >= 10 AND stddev_pop(close) OVER p > 0 THEN (close - avg(close) OVER p) / stddev_pop(close) OVER p END AS z FROM bars WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


STATE = "CASE WHEN z <= -1.5 THEN -2 WHEN z < -0.5 THEN -1 WHEN z <= 0.5 THEN 0 WHEN z < 1.5 THEN 1 WHEN z >= 1.5 THEN 2 END"


def hit_sql(moves: str, by: str = "", horizon: int = 10) -> str:
    """CTEs h0 to h<horizon> (by, state, p) over moves (by, state, next_state, share): one step each."""
    b, on = (f"{by}, ", f" AND h.{by} = k.{by}") if by else ("", "")
    keys = f"(SELECT DISTINCT {by} FROM {moves})" if by else "(SELECT 1)"
    out = [f"keys AS (SELECT {b}s AS state FROM {keys} x, (VALUES (-2), (-1), (0), (1), (2)) t(s))", f"h0 AS (SELECT {b}state, CASE WHEN state = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS p FROM keys)"]
    for i in range(horizon):
        back = f" AND h.{by} = m.{by}" if by else ""
        own = f" AND m.{by} = k.{by}" if by else ""
        out.append(f"h{i + 1} AS MATERIALIZED (SELECT {'k.' + by + ', ' if by else ''}k.state, CASE WHEN k.state = 0 THEN 1.0 ELSE coalesce(sum(m.share * h.p), any_value(o.p)) END AS p FROM keys k JOIN h{i} o ON o.state = k.state{on.replace('h.', 'o.')} LEFT JOIN {moves} m ON m.state = k.state{own} LEFT JOIN h{i} h ON h.state = m.next_state{back} GROUP BY {'k.' + by + ', ' if by else ''}k.state)")
    return ", ".join(out)


@query(f"""WITH {SCORED}, s AS (SELECT symbol, ts, {STATE} AS state FROM scored), n AS (SELECT *, lead(state) OVER ({W}) AS next_state FROM s),
c AS (SELECT state, next_state, count(*) AS n FROM n WHERE state IS NOT NULL AND next_state IS NOT NULL GROUP BY ALL) SELECT state, next_state, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS share FROM c""")
def markov_transitions(spark, sf_dir):
    return rounded(signals.transitions(scored(spark, sf_dir)))


MOVES = f"""{SCORED}, st AS (SELECT symbol, ts, {STATE} AS state FROM scored), nx AS (SELECT *, lead(state) OVER ({W}) AS next_state FROM st),
mc AS (SELECT state, next_state, count(*) AS n FROM nx WHERE state IS NOT NULL AND next_state IS NOT NULL GROUP BY ALL), moves AS MATERIALIZED (SELECT state, next_state, n / sum(n) OVER (PARTITION BY state) AS share FROM mc)"""


@query(f"WITH {MOVES}, {hit_sql('moves')} SELECT state, round(p, 6) AS p FROM h10")
def markov_hit_probability(spark, sf_dir):
    return rounded(signals.hit_probability(signals.transitions(scored(spark, sf_dir))))


GATE_STATE = STATE.replace("1.5", "2")
GATED = f"""{SCORED}, st AS (SELECT symbol, ts, z, {GATE_STATE} AS state FROM scored), pst AS (SELECT * FROM st WHERE ts < DATE '1998-01-01'), nx AS (SELECT *, lead(state) OVER ({W}) AS next_state FROM pst),
mc AS (SELECT symbol, state, next_state, count(*) AS n FROM nx WHERE state IS NOT NULL AND next_state IS NOT NULL GROUP BY ALL), moves AS MATERIALIZED (SELECT symbol, state, next_state, n / sum(n) OVER (PARTITION BY symbol, state) AS share FROM mc),
seen AS (SELECT symbol, state, count(*) AS visits FROM pst WHERE state IS NOT NULL GROUP BY ALL), total AS (SELECT symbol, sum(visits) AS n_train FROM seen GROUP BY symbol), {hit_sql('moves', 'symbol')}"""


@query(f"""WITH {GATED} SELECT s.symbol, s.state, count(*) AS n, round(avg(CASE WHEN n_train >= 60 THEN p END), 6) AS hit_prob,
CAST(count(*) FILTER (n_train >= 60 AND visits >= 10 AND p < 0.9 AND EXISTS (SELECT 1 FROM moves m WHERE m.symbol = s.symbol AND m.state = s.state)) AS BIGINT) AS n_barred
FROM st s LEFT JOIN h10 h ON h.symbol = s.symbol AND h.state = s.state LEFT JOIN seen v ON v.symbol = s.symbol AND v.state = s.state LEFT JOIN total t ON t.symbol = s.symbol WHERE s.ts >= DATE '1998-01-01' GROUP BY ALL""")
def entry_gate(spark, sf_dir):
    """Entry bars per symbol from its own transitions before 1998, applied to later rows."""
    gated = signals.entry_gate(scored(spark, sf_dir), F.col("ts") < F.lit(dt.date(1998, 1, 1)), least=0.9)
    return rounded(gated.groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"), F.avg("hit_prob").alias("hit_prob"), F.count_if(~F.col("gate")).alias("n_barred")))


#: The state machine, row by row: position, rows held, rows to wait.
POSITIONS = f"""{SCORED}, sn AS MATERIALIZED (SELECT symbol, ts, z, lag(z) OVER ({W}) AS q, row_number() OVER ({W}) AS k FROM scored), walk AS (
SELECT symbol, k, ts, z, CASE WHEN z <= -2 AND z > -4 THEN 1 WHEN z >= 2 AND z < 4 THEN -1 ELSE 0 END AS pos, 0 AS held, 0 AS wait FROM sn WHERE k = 1 UNION ALL
SELECT symbol, k, ts, z, CASE WHEN act = 'stay' THEN p WHEN act = 'in' THEN CASE WHEN z < 0 THEN 1 ELSE -1 END ELSE 0 END, CASE WHEN act = 'stay' AND p <> 0 THEN h + 1 ELSE 0 END, CASE WHEN act = 'out' THEN 5 WHEN w > 0 THEN w - 1 ELSE 0 END
FROM (SELECT s.symbol, s.k, s.ts, s.z, r.pos AS p, r.held AS h, r.wait AS w, CASE WHEN r.wait > 0 THEN 'rest' WHEN r.pos <> 0 AND (s.z IS NULL OR abs(s.z) <= 0.5 OR abs(s.z) >= 4 OR r.held + 1 >= 20 OR r.pos * s.z >= 2) THEN 'out'
WHEN r.pos = 0 AND {ENTERS.replace("z", "s.z").replace("q", "s.q")} THEN 'in' ELSE 'stay' END AS act FROM walk r JOIN sn s ON s.symbol = r.symbol AND s.k = r.k + 1))"""


@query(f"WITH RECURSIVE {POSITIONS} SELECT symbol, ts, round(z, 6) AS z, pos FROM walk")
def position_states(spark, sf_dir):
    return rounded(signals.positions(scored(spark, sf_dir)))


@query(f"""WITH {SCORED}, e AS (SELECT *, lag(z) OVER ({W}) AS q, row_number() OVER ({W}) AS k, max(ts) OVER (PARTITION BY symbol) AS last_ts FROM scored), o AS (SELECT symbol, ts AS entry_ts, k, last_ts, CASE WHEN z > 0 THEN -1 ELSE 1 END AS side FROM e WHERE {ENTERS}),
h AS (SELECT o.symbol, entry_ts, min(s.ts) AS hit FROM o JOIN e s ON s.symbol = o.symbol AND s.k > o.k AND s.k <= o.k + 20 AND (abs(s.z) <= 0.5 OR abs(s.z) >= 4 OR s.z IS NULL OR s.k = o.k + 20 OR side * s.z >= 2) GROUP BY ALL)
SELECT o.symbol, o.entry_ts, o.side, coalesce(hit, last_ts) AS exit_ts FROM o LEFT JOIN h ON h.symbol = o.symbol AND h.entry_ts = o.entry_ts""")
def exit_scan(spark, sf_dir):
    z = scored(spark, sf_dir)
    opened = signals.entries(z, 2.0, 4.0).select("symbol", F.col("ts").alias("entry_ts"), "side")
    return signals.exit_hits(opened, z, 2.0, 0.5, 4.0, 20)


@query(f"""WITH {BARS}, l AS (SELECT *, lag(close) OVER ({W}) AS pc, lag(volume) OVER ({W}) AS pv FROM bars), g AS (SELECT symbol, ts, least(3.0, greatest(0.0, abs(open / pc - 1) / 0.02)) * 0.35 + least(3.0, greatest(0.0, ((high - low) / pc) / 0.03)) * 0.35 + least(3.0, greatest(0.0, (volume / pv) / 3.0)) * 0.1 AS s FROM l WHERE pc > 0 AND pv > 0)
SELECT CASE WHEN s >= 2.5 THEN 'panic' WHEN s >= 1.75 THEN 'stress' WHEN s >= 1.0 THEN 'elevated' ELSE 'normal' END AS regime, count(*) AS n, round(avg(s), 6) AS mean_score FROM g GROUP BY regime""")
def stress_regimes(spark, sf_dir):
    w = R.by_time()
    b = bars(spark, sf_dir).withColumns({"pc": F.lag("close").over(w), "pv": F.lag("volume").over(w)}).where("pc > 0 and pv > 0")
    s = S.stress_score(F.abs(F.col("open") / F.col("pc") - 1), (F.col("high") - F.col("low")) / F.col("pc"), F.lit(None).cast("double"), F.col("volume") / F.col("pv"))
    return rounded(b.withColumn("s", s).groupBy(S.stress_regime(F.col("s")).alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_score")))


@query("""WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'ab/' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 4 = 1 THEN ' x.' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 4 = 2 THEN 'q.to' ELSE 'z-w' END AS symbol FROM part), u AS (SELECT id, replace(upper(trim(symbol)), '/', '-') AS p FROM s)
SELECT id, CASE WHEN regexp_matches(p, '\\.(TO|L|DE)$') THEN p ELSE replace(p, '.', '-') END AS symbol FROM u""")
def symbol_rules(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("ab/"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit(" x."), k.cast("string"))).when(k % 4 == 2, "q.to").otherwise("z-w")
    return table(spark, sf_dir, "part").select(k.alias("id"), S.normalize_symbol(raw).alias("symbol"))


@query("""WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS price FROM part), f AS (SELECT p_partkey AS symbol, CASE WHEN price IS NULL THEN 'missing' WHEN price < 950 THEN 'price' WHEN p_size < 5 THEN 'size' WHEN p_brand IN ('Brand#11', 'Brand#22') THEN 'blacklist' END AS reason FROM p)
SELECT coalesce(reason, 'selected') AS reason, count(*) AS n, CAST(count(*) FILTER (reason IS NULL OR symbol IN (13, 26, 39)) AS BIGINT) AS n_selected FROM f GROUP BY ALL""")
def universe_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("price", F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice")))
    rules = [("missing", F.col("price").isNull()), ("price", F.col("price") < 950), ("size", F.col("p_size") < 5), ("blacklist", F.col("p_brand").isin("Brand#11", "Brand#22"))]
    out = universe.screen(rows, rules, whitelist=[13, 26, 39], key="p_partkey")
    return out.groupBy(F.coalesce("reason", F.lit("selected")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"))


START, END = dt.date(1996, 1, 1), dt.date(2000, 12, 31)


@query(f"""WITH {BARS}, w AS (SELECT i AS "window", CAST(DATE '1996-01-01' + INTERVAL (i * 6) MONTH AS DATE) AS train_start, CAST(DATE '1997-01-01' + INTERVAL (i * 6) MONTH AS DATE) AS test_start, CAST(least(DATE '1997-07-01' + INTERVAL (i * 6) MONTH, DATE '2001-01-01') AS DATE) AS test_end FROM range(8) t(i))
SELECT CAST("window" AS INT) AS "window", train_start, test_start, test_end, CASE WHEN ts >= test_start THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(avg(close), 6) AS mean_close FROM w JOIN bars ON ts >= train_start AND ts < test_end GROUP BY ALL""")
def walk_forward(spark, sf_dir):
    windows = validation.walk_forward(spark, START, END, 12, 6)
    out = validation.assign(bars(spark, sf_dir).select("symbol", "ts", "close"), windows)
    return rounded(out.groupBy("window", "train_start", "test_start", "test_end", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close")))


@query("SELECT 0 AS n_changed")
def future_perturbation(spark, sf_dir):
    """Rows up to the cut that the cleaning and scoring operators change when the future changes: none."""
    cut = dt.date(1999, 1, 1)

    def run(b: DataFrame) -> DataFrame:
        return clean.scrub_outliers(b).select("symbol", "ts", "close", R.past_zscore(F.col("close"), 20, 10).alias("z"))

    raw = raw_bars(spark, sf_dir)
    return validation.looks_ahead(run(raw), run(validation.perturb_future(raw, cut)), cut).agg(F.count(F.lit(1)).cast("int").alias("n_changed"))


@query()
def panel_fingerprint(spark, sf_dir):
    return validation.fingerprint(bars(spark, sf_dir))


@query(f"""WITH {RAW} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (high < low) AS BIGINT) AS high_below_low, CAST(count(*) FILTER (volume = 0) AS BIGINT) AS zero_volume, CAST(count(*) FILTER (close IS NULL) AS BIGINT) AS missing_close, CAST(count(*) FILTER (extract(isodow FROM ts) > 5) AS BIGINT) AS weekend, CAST(count(*) - count(DISTINCT (symbol, ts)) AS BIGINT) AS duplicates FROM raw""")
def data_quality(spark, sf_dir):
    b = raw_bars(spark, sf_dir)
    return b.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("high") < F.col("low")).alias("high_below_low"), F.count_if(F.col("volume") == 0).alias("zero_volume"), F.count_if(F.col("close").isNull()).alias("missing_close"),
        F.count_if(F.dayofweek("ts").isin(1, 7)).alias("weekend"), (F.count(F.lit(1)) - F.countDistinct("symbol", "ts")).alias("duplicates"),
    )
