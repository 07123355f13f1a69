"""Further queries over bars and universes: fills, events, sessions, filters, pair selection, curves; each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import align, clean, covariance, reports, significance, stats, universe
from tidepanel.operators.storage import Rounds
from tidepanel.plans.panel_queries import BOOTSTRAP, GRID, RAW, W, bars, raw_bars, rounded, window_correlations
from tidepanel.plans.trade_queries import EQUITY, NET, curve, netted
from tidepanel.sources.panel import BARS, TRADES, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {RAW}, p AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS x, row_number() OVER ({W}) AS pos FROM raw), l AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS lv, last_value(CASE WHEN x IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS lp FROM p WINDOW b AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, round(CASE WHEN pos - lp <= 6 THEN x - lv END, 9) + 0 AS ret FROM l""")
def log_causal_return(spark, sf_dir):
    return rounded(clean.log_causal_return(raw_bars(spark, sf_dir)).select("symbol", "ts", "ret"), 9)


@query(f"""WITH {RAW}, r AS (SELECT *, ln(close) - ln(lag(close) OVER ({W})) AS ret FROM raw), m AS (SELECT *, CASE WHEN count(ret) OVER c >= 10 THEN quantile_cont(ret, 0.5) OVER c END AS med FROM r WINDOW c AS ({W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
d AS (SELECT *, abs(ret - med) AS dev FROM m), s AS (SELECT *, 1.4826 * CASE WHEN count(dev) OVER c >= 10 THEN quantile_cont(dev, 0.5) OVER c END AS sc FROM d WINDOW c AS ({W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
o AS (SELECT *, coalesce(abs((ret - med) / nullif(sc, 0)) > 8, false) AS outlier FROM s) SELECT symbol, ts, outlier, round(CASE WHEN NOT outlier THEN close END, 6) AS close FROM o""")
def centered_outliers(spark, sf_dir):
    """The older, look-ahead scrub."""
    return rounded(clean.centered_outliers(raw_bars(spark, sf_dir)).select("symbol", "ts", "outlier", "close"))


@query(f"""WITH {BARS}, cal AS (SELECT DISTINCT ts FROM bars WHERE symbol = 'Brand#1') SELECT symbol, count(*) AS n, CAST(count(*) FILTER (isodow(ts) < 6) AS BIGINT) AS n_weekday, CAST(count(*) FILTER (ts IN (SELECT ts FROM cal)) AS BIGINT) AS n_session FROM bars GROUP BY symbol""")
def tradable_rows(spark, sf_dir):
    """Rows on weekdays, and on the days of one symbol taken as the calendar."""
    b = bars(spark, sf_dir)
    plain = clean.tradable(b).withColumnRenamed("tradable", "weekday")
    both = clean.tradable(plain, b.where("symbol = 'Brand#1'").select("ts"))
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if("weekday").alias("n_weekday"), F.count_if("tradable").alias("n_session"))


@query("SELECT event_type, count(*) AS n, CAST(count(*) FILTER (isodow(ts) < 6 AND strftime(ts, '%H:%M') BETWEEN '09:30' AND '16:00') AS BIGINT) AS n_tradable FROM events GROUP BY event_type")
def tradable_hours(spark, sf_dir):
    e = clean.tradable(table(spark, sf_dir, "events"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("tradable").alias("n_tradable"))


FILL = f"""{GRID}, t AS (SELECT symbol, ts, close, isodow(ts) < 6 AS tradable, row_number() OVER ({W}) AS pos FROM grid), h AS (SELECT *, close IS NULL AND tradable AS hole FROM t),
i AS (SELECT *, CASE WHEN hole THEN pos - sum(CASE WHEN hole THEN 1 ELSE 0 END) OVER ({W}) END AS gap, lag(close) OVER ({W}) AS b, lead(close) OVER ({W}) AS a FROM h),
j AS (SELECT *, count(*) OVER (PARTITION BY symbol, gap) AS len, min(pos) OVER (PARTITION BY symbol, gap) AS f FROM i),
k AS (SELECT *, max(CASE WHEN pos = f THEN b END) OVER (PARTITION BY symbol, gap) AS l, max(CASE WHEN pos = f + len - 1 THEN a END) OVER (PARTITION BY symbol, gap) AS r FROM j)"""


SHORT = f"""{FILL}, v AS (SELECT *, CASE WHEN hole AND len = 1 THEN CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (l + r) / 2 ELSE coalesce(l, r) END WHEN hole AND len = 2 AND l IS NOT NULL AND r IS NOT NULL THEN l + (r - l) * (pos - f + 1) / 3 END AS x FROM k)"""


def smoothed_sql(levels: int = 12) -> str:
    """CTEs up to filled (symbol, pos, v): smoothed gaps of three to five rows, those that depend on one other gap after it, and so on; each by a walk forward and a walk back."""
    out = [SHORT, "gaps AS (SELECT symbol, f, len, lag(f + len - 1) OVER (PARTITION BY symbol ORDER BY f) AS e FROM v WHERE hole AND pos = f AND len BETWEEN 3 AND 5 AND l IS NOT NULL AND r IS NOT NULL)",
           "chains AS (SELECT *, sum(CASE WHEN e IS NULL OR e < f - 5 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY f) AS chain FROM gaps)", "depths AS (SELECT *, row_number() OVER (PARTITION BY symbol, chain ORDER BY f) AS depth FROM chains)",
           "filled0 AS (SELECT symbol, pos, close AS v FROM v WHERE false)"]
    for d in range(1, levels + 1):
        out.append(f"""w{d} AS MATERIALIZED (SELECT g.symbol, g.f, g.len, v.pos, CASE WHEN v.pos < g.f THEN coalesce(close, x, p.v) WHEN v.pos >= g.f + g.len THEN close END AS y FROM depths g JOIN v ON v.symbol = g.symbol AND v.pos BETWEEN g.f - 5 AND g.f + g.len + 4 LEFT JOIN filled{d - 1} p ON p.symbol = v.symbol AND p.pos = v.pos WHERE depth = {d}),
s{d} AS MATERIALIZED (SELECT symbol, f, var_pop(y) AS noise, min(pos) FILTER (y IS NOT NULL) AS start, max(pos) AS stop FROM w{d} GROUP BY ALL),
u{d} AS MATERIALIZED (WITH RECURSIVE a AS (SELECT w.symbol, w.f, pos, y AS level, 1.0::DOUBLE AS var FROM w{d} w JOIN s{d} s ON s.symbol = w.symbol AND s.f = w.f AND pos = start
UNION ALL SELECT w.symbol, w.f, w.pos, CASE WHEN y IS NULL THEN level ELSE level + (var + 0.0001) / (var + 0.0001 + noise) * (y - level) END, CASE WHEN y IS NULL THEN var + 0.0001 ELSE (1 - (var + 0.0001) / (var + 0.0001 + noise)) * (var + 0.0001) END
FROM a JOIN w{d} w ON w.symbol = a.symbol AND w.f = a.f AND w.pos = a.pos + 1 JOIN s{d} s ON s.symbol = a.symbol AND s.f = a.f) SELECT * FROM a),
b{d} AS MATERIALIZED (WITH RECURSIVE a AS (SELECT u.symbol, u.f, pos, level FROM u{d} u JOIN s{d} s ON s.symbol = u.symbol AND s.f = u.f AND pos = stop
UNION ALL SELECT u.symbol, u.f, u.pos, u.level + u.var / (u.var + 0.0001) * (a.level - u.level) FROM a JOIN u{d} u ON u.symbol = a.symbol AND u.f = a.f AND u.pos = a.pos - 1) SELECT * FROM a),
filled{d} AS MATERIALIZED (SELECT * FROM filled{d - 1} UNION ALL SELECT b.symbol, b.pos, level FROM b{d} b JOIN w{d} w ON w.symbol = b.symbol AND w.f = b.f AND w.pos = b.pos WHERE b.pos BETWEEN b.f AND b.f + len - 1)""")
    return "WITH RECURSIVE " + ", ".join(out) + f", filled AS (SELECT * FROM filled{levels})"


@query(f"""WITH {SHORT} SELECT symbol, CAST(count(*) FILTER (x IS NOT NULL) AS BIGINT) AS n_filled, CAST(count(*) FILTER (x IS NOT NULL AND len = 2) AS BIGINT) AS n_line, CAST(count(coalesce(close, x)) AS BIGINT) AS n_close, round(avg(coalesce(close, x)), 6) AS mean_close FROM v GROUP BY symbol""")
def safe_fill(spark, sf_dir):
    """Gaps of one and two tradable rows."""
    out = clean.safe_fill(clean.tradable(align.on_grid(raw_bars(spark, sf_dir))), 2, hard_drop=False)
    return rounded(out.groupBy("symbol").agg(F.count_if("filled").alias("n_filled"), F.count_if(F.col("method") == "filled_linear").alias("n_line"), F.count("close").alias("n_close"), F.avg("close").alias("mean_close")))


@query(f"""WITH {FILL} SELECT symbol, CAST(count(*) FILTER (hole AND len <= 5 AND l IS NOT NULL) AS BIGINT) AS n_filled, round(avg(CASE WHEN hole AND len <= 5 THEN l ELSE close END), 6) AS mean_close FROM k GROUP BY symbol""")
def safe_fill_causal(spark, sf_dir):
    out = clean.safe_fill(clean.tradable(align.on_grid(raw_bars(spark, sf_dir))), 5, causal=True, hard_drop=False)
    return rounded(out.groupBy("symbol").agg(F.count_if("filled").alias("n_filled"), F.avg("close").alias("mean_close")))


@query(f"""{smoothed_sql()} SELECT v.symbol, v.ts, round(p.v, 6) AS close FROM filled p JOIN v ON v.symbol = p.symbol AND v.pos = p.pos""")
def safe_fill_smoothed(spark, sf_dir):
    """Rows that the local-level smoother fills, in order: a gap sees what was filled in front of it."""
    out = clean.safe_fill(clean.tradable(align.on_grid(raw_bars(spark, sf_dir))), 5, hard_drop=False)
    return rounded(out.where("filled AND method = 'filled_kalman'").select("symbol", "ts", "close"))


@query(f"""WITH {FILL}, m AS (SELECT *, close IS NULL AS gone, CASE WHEN close IS NULL THEN pos - sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER ({W}) END AS run, count(*) OVER (PARTITION BY symbol) AS n FROM k),
q AS (SELECT *, max(hole) OVER (PARTITION BY symbol, run) AS open FROM m),
tt AS (SELECT *, CASE WHEN hole THEN CASE WHEN len = 1 AND l IS NOT NULL AND r IS NOT NULL THEN 'filled_single_avg' WHEN len = 1 AND l IS NOT NULL THEN 'filled_ffill' WHEN len = 1 AND r IS NOT NULL THEN 'filled_bfill' WHEN len = 2 AND l IS NOT NULL AND r IS NOT NULL THEN 'filled_linear'
WHEN len BETWEEN 3 AND 5 AND l IS NOT NULL AND r IS NOT NULL THEN 'filled_kalman' WHEN f = 1 OR f + len - 1 = n THEN 'skip_edge_unfilled' ELSE 'drop' END WHEN gone AND NOT open THEN 'skip_nontradable' END AS how FROM q),
z AS (SELECT *, min(CASE WHEN how = 'drop' THEN f END) OVER (PARTITION BY symbol) AS stop FROM tt)
SELECT symbol, how AS method, stop IS NOT NULL AS removed, count(*) AS n FROM z WHERE how IS NOT NULL AND (stop IS NULL OR (hole AND f <= stop) OR (NOT hole AND pos < stop)) GROUP BY ALL""")
def safe_fill_methods(spark, sf_dir):
    """What was done with missing rows per symbol, up to the first gap that removes it."""
    out = clean.safe_fill(clean.tradable(align.on_grid(raw_bars(spark, sf_dir))), 5)
    return out.where("method IS NOT NULL").groupBy("symbol", "method", "removed").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RAW}, z AS (SELECT ts, symbol, 'volume' AS field, 'zero_volume' AS rule, open, high, low, close, volume FROM raw WHERE volume = 0 AND close > 0), c AS (SELECT ts, symbol, 'high' AS field, 'crossed' AS rule, open, high, low, close, volume FROM raw WHERE high < low), u AS (SELECT * FROM z UNION ALL SELECT * FROM c)
SELECT ts, symbol, 'clean' AS stage, field, rule, 'warn' AS severity, 'null' AS action, round(open, 6) AS value_open, round(high, 6) AS value_high, round(low, 6) AS value_low, round(close, 6) AS value_close, volume AS value_volume FROM u""")
def event_rows(spark, sf_dir):
    """One ordered log of what two rules found, each event once."""
    b = raw_bars(spark, sf_dir).withColumns({"zero": (F.col("volume") == 0) & (F.col("close") > 0), "crossed": F.col("high") < F.col("low")})
    zero = clean.events(b, "zero", "clean", "volume", "zero_volume", "warn", "null")
    return rounded(clean.event_log(zero, clean.events(b, "crossed", "clean", "high", "crossed", "warn", "null"), zero.limit(0)))


@query(f"""WITH {RAW}, e AS (SELECT symbol, coalesce(high < low OR high < greatest(open, close) OR low > least(open, close) OR least(open, high, low, close) <= 0, false) AS bad FROM raw)
SELECT symbol, count(*) AS n, CAST(count(*) FILTER (bad) AS BIGINT) AS n_bad, round(count(*) FILTER (bad) / count(*), 9) AS share, count(*) FILTER (bad) / count(*) > 0.1 AS dropped FROM e GROUP BY symbol""")
def hard_errors(spark, sf_dir):
    return rounded(clean.hard_errors(raw_bars(spark, sf_dir), 0.1), 9)


@query("""SELECT p_partkey AS id, upper(trim(p_name)) AS symbol FROM part WHERE NOT (starts_with(upper(p_name), 'SMALL') OR ends_with(upper(p_name), 'BOLT') OR contains(upper(p_name), 'RED') OR regexp_matches(upper(p_name), '^L.*G$'))""")
def symbol_prefilter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol"))
    return universe.keep_symbols(rows, ["small"], ["bolt"], ["^l.*g$"], ["red"])


@query("""WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'x' WHEN 1 THEN '-3' WHEN 2 THEN '0.5' WHEN 3 THEN 'nan' WHEN 4 THEN ' Yes ' ELSE CAST(p_size AS VARCHAR) END AS t FROM part)
SELECT id, greatest(1.0, CASE WHEN t IN ('nan') THEN 7.0 ELSE coalesce(TRY_CAST(t AS DOUBLE), 7.0) END) AS bounded, CASE WHEN t = 'nan' OR coalesce(TRY_CAST(t AS DOUBLE), 7.0) <= 0 THEN 7.0 ELSE coalesce(TRY_CAST(t AS DOUBLE), 7.0) END AS positive, lower(trim(t)) IN ('1', 'true', 'yes', 'on', 'force') AS yes FROM p""")
def bounded_values(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.when(k % 6 == 0, "x").when(k % 6 == 1, "-3").when(k % 6 == 2, "0.5").when(k % 6 == 3, "nan").when(k % 6 == 4, " Yes ").otherwise(F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), t.alias("t"))
    return rows.select("id", universe.bounded_number("t", 7.0, least=1.0).alias("bounded"), universe.bounded_number("t", 7.0, positive=True).alias("positive"), universe.truthy(F.col("t")).alias("yes"))


def fundamentals(spark, sf_dir):
    """Parts as listed companies with gaps in what is known of them."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    known = lambda n, x: F.when(k % n > 0, x)
    return table(spark, sf_dir, "part").select(
        k.alias("symbol"), known(11, F.col("p_retailprice")).alias("price"), known(17, F.col("p_retailprice") * size * 1000).alias("market_cap"), known(13, size * 100 - 100).alias("volume"),
        known(7, F.col("p_retailprice") * size * 100).alias("dollar_adv_hist"), known(3, size / 40).alias("float_shares"), F.lit(1.0).alias("shares_out"), known(2, size / 200).alias("shares_short"), F.when(k % 5 == 0, 0.1).alias("short_of_float"),
        F.when(k % 4 == 0, size / 60).alias("insiders"), F.when(k % 9 == 0, 0.4).alias("institutions"), F.when(k % 8 == 0, 1.7).alias("institutions_of_float"), (k % 2 == 0).alias("dividend"),
    )


FUND = """f0 AS (SELECT p_partkey AS symbol, p_partkey AS k, CAST(p_size AS DOUBLE) AS s, CASE WHEN p_partkey % 11 > 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 17 > 0 THEN p_retailprice * CAST(p_size AS DOUBLE) * 1000 END AS market_cap, CASE WHEN p_partkey % 13 > 0 THEN CAST(p_size AS DOUBLE) * 100 - 100 END AS volume,
CASE WHEN p_partkey % 7 > 0 THEN p_retailprice * CAST(p_size AS DOUBLE) * 100 END AS adv FROM part), f1 AS (SELECT *, CASE WHEN k % 3 > 0 AND s / 40 > 0 AND s / 40 <= 1.2 THEN s / 40 END AS nat, CASE WHEN k % 2 > 0 AND k % 5 = 0 AND s / 200 / 0.1::DOUBLE <= 1.5 THEN s / 200 / 0.1::DOUBLE END AS der,
least(CASE WHEN k % 4 = 0 THEN greatest(0.0, least(1.0, 1 - s / 60)) END, CASE WHEN k % 9 = 0 THEN 0.4 END, CASE WHEN k % 8 = 0 THEN 1.0 END) AS con FROM f0),
fund AS (SELECT *, CASE WHEN coalesce(nat, der, con) IS NOT NULL THEN least(1.0, coalesce(nat, der, con)) END AS float_pct, CASE WHEN nat IS NOT NULL THEN 'native' WHEN der IS NOT NULL THEN 'derived' WHEN con IS NOT NULL THEN 'conservative' ELSE 'low_confidence' END AS float_source FROM f1)"""


@query(f"WITH {FUND} SELECT symbol, round(float_pct, 9) AS float_pct, float_source FROM fund")
def float_shares(spark, sf_dir):
    return rounded(universe.float_share(fundamentals(spark, sf_dir)).select("symbol", "float_pct", "float_source"), 9)


CHAIN = {"min_price": 950, "max_price": 1800, "min_market_cap": 5e6, "min_avg_volume": 300, "min_dollar_adv": 9e5, "min_float_pct": 0.2, "min_free_float_dollar_cap": 2e6, "require_dividend": True}


@query(f"""WITH {FUND}, c AS (SELECT CASE WHEN price IS NULL OR market_cap IS NULL OR volume IS NULL THEN 'REASON_NA_CORE_FIELD' WHEN price <= 0 OR volume <= 0 THEN 'REASON_ZERO_CORE_FIELD' WHEN price < 950 THEN 'REASON_LOW_PRICE' WHEN price > 1800 THEN 'REASON_HIGH_PRICE' WHEN market_cap < 5e6 THEN 'REASON_LOW_MCAP'
WHEN volume < 300 THEN 'REASON_LOW_VOL' WHEN adv IS NULL THEN 'REASON_NO_HIST_ADV' WHEN adv < 9e5 THEN 'REASON_LOW_DADV' WHEN float_pct IS NULL OR float_pct < 0.2::DOUBLE THEN 'REASON_FLOAT_PCT' WHEN float_pct * market_cap < 2e6 THEN 'REASON_FF_DOLLAR_CAP' WHEN k % 2 > 0 THEN 'REASON_DIVIDEND_REQ' ELSE 'selected' END AS reason FROM fund)
SELECT reason, count(*) AS n FROM c GROUP BY reason""")
def universe_chain(spark, sf_dir):
    """The whole ordered filter chain with its reasons."""
    df = universe.effective(universe.float_share(fundamentals(spark, sf_dir)))
    out = universe.screen(df, universe.standard_rules(df, CHAIN))
    return out.groupBy(F.coalesce("reason", F.lit("selected")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FUND}, a AS (SELECT count(*) AS n, ((count(*) - count(price)) + (count(*) - count(market_cap)) + (count(*) - count(volume))) / (count(*) * 3) AS c, (count(*) - count(float_pct)) / count(*) AS f FROM fund)
SELECT n, round(c, 9) AS core_missing, round(f, 9) AS float_missing, n >= 100 AND greatest(c, f) <= 0.2 AS ok FROM a""")
def universe_canary(spark, sf_dir):
    return rounded(universe.canary(universe.float_share(fundamentals(spark, sf_dir)), 100, 0.2), 9)


@query("""WITH st AS (SELECT l_partkey AS symbol, arg_max(l_tax, l_shipdate) FILTER (l_tax > 0) AS tax FROM (SELECT l_partkey, l_shipdate, max(l_tax) AS l_tax FROM lineitem GROUP BY ALL) GROUP BY l_partkey)
SELECT p_partkey AS symbol, CASE WHEN p_partkey % 2 = 0 THEN coalesce(CAST(p_size AS DOUBLE), tax) ELSE tax END AS rate FROM part LEFT JOIN st ON st.symbol = p_partkey""")
def merged_fundamentals(spark, sf_dir):
    """Known values stay, others come from the last entry of a store."""
    k = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(k.alias("symbol"), F.when(k % 2 == 0, F.col("p_size").cast("double")).alias("rate"))
    store = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("symbol"), F.col("l_shipdate").alias("updated_at")).agg(F.max("l_tax").alias("rate"))
    return universe.merge_fundamentals(base, store.withColumn("rate", F.when(F.col("rate") > 0, F.col("rate"))), ["rate"])


@query("""SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) - 10 AS d10, CAST(o_orderdate AS DATE) - 14 AS w2, CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE) AS mo6, CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) AS y1 FROM orders""")
def period_starts(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *[universe.shift_period(day, p).alias(n) for p, n in (("10d", "d10"), ("2wk", "w2"), ("6mo", "mo6"), ("1y", "y1"))])


PAIRS = f"""{BARS}, lr AS (SELECT symbol, ts, ln(close) - lag(ln(close)) OVER ({W}) AS ret FROM bars), pr AS (SELECT a.symbol AS l, b.symbol AS r, count(*) AS n, corr(a.ret, b.ret) AS c FROM lr a JOIN lr b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)"""


def correlations(spark, sf_dir):
    return stats.pair_correlations(stats.returns(bars(spark, sf_dir)))


@query(f'WITH {PAIRS} SELECT l AS "left", r AS "right", round(c, 9) AS corr FROM pr WHERE c >= 0.02')
def high_pairs(spark, sf_dir):
    return rounded(stats.high_pairs(correlations(spark, sf_dir), 0.02), 9)


YEARLY = f"""{PAIRS}, yr AS (SELECT a.symbol AS l, b.symbol AS r, year(a.ts) AS y, corr(a.ret, b.ret) AS c FROM lr a JOIN lr b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 20),
su AS (SELECT l, r, avg(c) AS mean_corr, avg(CASE WHEN c >= 0 THEN 1.0 ELSE 0.0 END) AS pct1, avg(CASE WHEN c >= 0.05 THEN 1.0 ELSE 0.0 END) AS pct2, count(*) AS years FROM yr WHERE c IS NOT NULL GROUP BY ALL)"""


def yearly_summary(spark, sf_dir):
    rets = stats.returns(bars(spark, sf_dir))
    each = stats.pair_correlations(rets.withColumn("symbol", F.concat_ws("|", F.year("ts"), "symbol")))
    part = lambda c, i: F.split(c, "[|]")[i]
    yearly = each.where("corr is not null").select(part("left", 1).alias("left"), part("right", 1).alias("right"), "corr")
    return yearly.groupBy("left", "right").agg(F.avg("corr").alias("mean_corr"), F.avg((F.col("corr") >= 0).cast("double")).alias("pct1"), F.avg((F.col("corr") >= 0.05).cast("double")).alias("pct2"), F.count(F.lit(1)).alias("years"))


@query(f'WITH {YEARLY} SELECT l AS "left", r AS "right", round(pct2, 9) AS pct2 FROM su ORDER BY pct2 DESC, l, r LIMIT 50')
def candidate_pairs(spark, sf_dir):
    """Top-k report: the limit is the feature."""
    return rounded(stats.candidate_pairs(yearly_summary(spark, sf_dir).select("left", "right", F.round("pct2", 9).alias("pct2")), 50), 9)


@query(f"""WITH {BOOTSTRAP}, cd AS (SELECT * FROM pp ORDER BY round(pct2, 9) DESC, "left", "right" LIMIT 200), tp AS (SELECT cd.*, p FROM cd JOIN bs USING ("left", "right")), k AS (SELECT *, row_number() OVER (ORDER BY p, "left", "right") AS q, count(*) OVER () AS m FROM tp),
cut AS (SELECT max(p) AS c FROM k WHERE p <= q / m * 0.8::DOUBLE)
SELECT "left" || '-' || "right" AS pair, round(mean_corr, 4) AS mean_corr, round(pct1, 2) AS pct1, round(pct2, 2) AS pct2, round(p, 6) AS p FROM tp, cut WHERE p <= c AND pct1 >= 0.01 AND pct2 >= 0.0""")
def selected_pairs(spark, sf_dir):
    """The whole chain: window correlations, persistence, the most persistent pairs as candidates, bootstrap, false discovery, cuts."""
    corrs = Rounds(spark, "window-correlations").put(window_correlations(spark, sf_dir))
    persistent = stats.pair_persistence(corrs, 0.1, 0.2)
    chosen = stats.candidate_pairs(persistent.withColumn("_by", F.round("pct2", 9)), 200, "_by").drop("_by")
    tested = chosen.join(covariance.bootstrap_pairs(corrs.join(chosen.select("left", "right"), ["left", "right"], "left_semi"), 200).select("left", "right", "p"), ["left", "right"])
    tested = Rounds(spark, "tested-pairs").put(tested)
    return stats.select_pairs(stats.false_discovery(tested, "p", 0.8), 0.01, 0.0)


@query("""WITH b AS (SELECT l_quantity AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END)::DOUBLE AS q FROM lineitem GROUP BY s),
c AS (SELECT s, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS t FROM b WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), d AS (SELECT s, tp / t AS rec, tp / (tp + fp) AS prec FROM c),
e AS (SELECT *, lag(rec) OVER (ORDER BY s DESC) AS r0, lag(prec) OVER (ORDER BY s DESC) AS p0 FROM d) SELECT round(sum(CASE WHEN r0 IS NULL THEN 0 ELSE (rec - r0) * (prec + p0) / 2 END), 9) AS auc_pr, count(*) AS n_points FROM e""")
def precision_recall(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(reports.precision_recall(x, "s", "y"), 9)


@query(f"""WITH {EQUITY}, r AS (SELECT *, pnl / (equity - pnl) AS r FROM curve), a AS (SELECT pow(arg_max(equity, day) / 100000000, 365.25 / greatest(max(day) - min(day), 1)) - 1 AS cagr, stddev_samp(r) * sqrt(252) AS ann_vol, min(drawdown) AS md, max(r) AS best, min(r) AS worst FROM r)
SELECT round(cagr, 9) AS cagr, round(ann_vol, 9) AS ann_vol, round(md, 9) AS max_drawdown, round(best, 9) AS best, round(worst, 9) AS worst, round(cagr / abs(md), 6) AS calmar FROM a""")
def tear_sheet(spark, sf_dir):
    return rounded(reports.tear_sheet(curve(spark, sf_dir), 1e8), 9, calmar=6)


@query(f"""WITH {EQUITY}, a AS (SELECT *, max(CASE WHEN drawdown = 0 THEN day END) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS s, min(CASE WHEN drawdown = 0 THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM curve),
g AS (SELECT s, b, min(struct_pack(d := drawdown, t := day)).t AS trough, min(drawdown) AS depth FROM a WHERE drawdown < 0 GROUP BY s, b) SELECT s AS start, b AS recovered, trough, round(depth, 9) AS depth, CAST(trough - s AS INT) AS days_down, CAST(b - trough AS INT) AS days_back FROM g""")
def recoveries(spark, sf_dir):
    """Each spell below a peak, to its trough and back."""
    return rounded(reports.drawdown_spells(curve(spark, sf_dir)), 9)


def normal_sql(z: str) -> str:
    """The normal distribution function by Simpson's rule."""
    return f"(0.5 + ({z}) / 1200 / sqrt(2 * pi()) * list_sum([CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(({z}) * i / 400) * (({z}) * i / 400) / 2) FOR i IN range(401)]))"


def best_sql(n: int) -> float:
    return significance.expected_best(n)


#: Moments of the curve's returns, with the annual Sharpe ratio.
CURVE_STATS = f"""{EQUITY}, rets AS (SELECT day, equity / lag(equity) OVER (ORDER BY day) - 1 AS r FROM curve), mo AS (SELECT count(r) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sr, avg(r) AS m FROM rets),
cm AS (SELECT n, sr, avg(power(r - m, 3)) / power(avg(power(r - m, 2)), 1.5) AS skew, avg(power(r - m, 4)) / power(avg(power(r - m, 2)), 2) AS kurt FROM rets, mo WHERE r IS NOT NULL GROUP BY n, sr),
sg AS (SELECT *, sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)) AS sigma, sr * sqrt(n) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)) AS t FROM cm)"""


@query(f"WITH {CURVE_STATS} SELECT n, round(sr, 6) AS sr, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round({best_sql(50)} * sigma, 6) AS sr_max, round({normal_sql('least(9, sr / sigma)')}, 6) + 0.0 AS psr, round({normal_sql(f'sr / sigma - {best_sql(50)}')}, 6) + 0.0 AS dsr FROM sg")
def deflated_sharpe(spark, sf_dir):
    """The curve's Sharpe ratio against none, and against the best of 50 trials without skill."""
    days = curve(spark, sf_dir).select(F.unix_date("day").alias("day"), "equity")
    return rounded(significance.significance(significance.sharpe_moments(days, "day"), 50).drop("p_one_sided"))


def trials(spark, sf_dir):
    """A trial a symbol, half-year and share of the trades: two components, of which `all` has the more rows."""
    net = netted(spark, sf_dir)
    half = F.month("exit_date") <= 6
    of = lambda name, rows: rows.groupBy(F.col("symbol").alias("model"), F.year("exit_date").alias("fold")).agg(F.avg("net_pnl").alias("score"), F.avg(F.when(half, F.col("net_pnl"))).alias("is_score"), F.avg(F.when(~half, F.col("net_pnl"))).alias("oos_score")).withColumn("component", F.lit(name))
    return of("all", net).unionByName(of("short", net.where("side < 0 AND symbol < 'Brand#2'")))


@query(f"""WITH {CURVE_STATS}, {NET.replace(f'{BARS}, {TRADES}, ', '', 1)}, tr AS (SELECT symbol AS model, year(exit_date) AS fold, avg(net_pnl) AS score, avg(CASE WHEN month(exit_date) <= 6 THEN net_pnl END) AS a, avg(CASE WHEN month(exit_date) > 6 THEN net_pnl END) AS b FROM net GROUP BY ALL),
f AS (SELECT * FROM tr WHERE a IS NOT NULL AND b IS NOT NULL), k AS (SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY a DESC, model) AS k, row_number() OVER (PARTITION BY fold ORDER BY b DESC, model DESC) AS r FROM f),
p AS (SELECT count(*) AS n_folds, avg(CASE WHEN (r - 0.5) / (SELECT count(DISTINCT model) FROM f) < 0.5 THEN 1.0 ELSE 0.0 END) AS pbo FROM k WHERE k = 1)
SELECT 'all' AS component, (SELECT count(DISTINCT model) FROM tr) AS n_candidates, n AS n_test_obs, round(sr, 6) AS sr_hat, round(skew, 6) AS skew, round(kurt, 6) AS kurtosis, round({normal_sql('least(9, sr / sigma)')}, 6) + 0.0 AS psr, round({normal_sql('sr / sigma - ' + str(best_sql(25)))}, 6) + 0.0 AS dsr, n_folds, round(pbo, 6) AS pbo FROM sg, p""")
def trial_analysis(spark, sf_dir):
    """What a search's trials say of its winner: candidates, overfitting of folds, deflated Sharpe ratio of the curve."""
    days = curve(spark, sf_dir).select(F.unix_date("day").alias("day"), "equity")
    return rounded(significance.trial_summary(trials(spark, sf_dir), days, "day").drop("p_one_sided"))


@query(f"""WITH {EQUITY}, r AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, CASE WHEN row_number() OVER (ORDER BY day) = 1 THEN 0.0 ELSE pnl / (equity - pnl) END AS r FROM curve), n AS (SELECT count(*) AS n FROM r),
d AS (SELECT b, ('0x' || substr(md5('7:' || b || ':' || i), 1, 8))::BIGINT % n AS i FROM r, n, range(100) t(b)), s AS (SELECT b, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM d JOIN r USING (i) GROUP BY b)
SELECT round(avg(s), 6) AS mean, round(quantile_cont(s, 0.025), 6) AS lower, round(quantile_cont(s, 0.975), 6) AS upper FROM s""")
def sharpe_interval(spark, sf_dir):
    """Bootstrap interval of the curve's Sharpe ratio, by draws that SQL can repeat."""
    days = curve(spark, sf_dir).select(F.unix_date("day").alias("day"), "pnl")
    return rounded(significance.bootstrap_sharpe(days, "day", 1e8, 100))
