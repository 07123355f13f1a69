"""Further queries: liquidity and cost reports, fills, schedules, audits; each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import rolling as R
from tidepanel.functions import scalars as S
from tidepanel.functions.scalars import money
from tidepanel.operators import align, clean
from tidepanel.plans.panel_queries import ALL_PAIRS, NEIGHBOURS, RAW, SCORED, W, all_pairs, neighbour_pairs, raw_bars, rounded, scored
from tidepanel.plans.trade_queries import NET, netted
from tidepanel.sources.panel import BARS, TRADES, bars, table, trades

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


LIQUID = f"{BARS}, {TRADES}, a AS (SELECT symbol, avg(close * volume) AS adv FROM bars GROUP BY symbol), liquid AS (SELECT t.*, adv, qty * exec_px AS notional, qty * exec_px / adv AS share FROM trades t JOIN a ON a.symbol = t.symbol)"


def liquid(spark, sf_dir):
    adv = bars(spark, sf_dir).groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"))
    return trades(spark, sf_dir).join(adv, "symbol").withColumn("notional", F.col("qty") * F.col("exec_px")).withColumn("share", F.col("notional") / F.col("adv"))


@query(f"""WITH {BARS}, s AS (SELECT symbol, avg(close * volume) AS adv, avg(volume) AS v FROM bars GROUP BY symbol), b AS (SELECT *, CAST(greatest(1, ceil((row_number() OVER (ORDER BY adv, symbol) - 1) * 5 / (count(*) OVER () - 1))) AS INT) AS bucket FROM s)
SELECT bucket, count(*) AS n, round(quantile_cont(adv, 0.5), 2) AS median_adv, round(quantile_cont(adv, 0.9), 2) AS p90_adv, round(quantile_cont(v, 0.5), 4) AS median_volume FROM b GROUP BY bucket""")
def adv_bucket_report(spark, sf_dir):
    s = bars(spark, sf_dir).groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"), F.avg("volume").alias("v"))
    b = s.withColumn("bucket", R.rank_bucket(["adv", "symbol"], 5))
    return rounded(b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), R.median(F.col("adv")).alias("median_adv"), F.percentile("adv", F.lit(0.9)).alias("p90_adv"), R.median(F.col("v")).alias("median_volume")), 2, median_volume=4)


@query(f"""WITH {LIQUID}, b AS (SELECT *, CASE WHEN share >= 0 AND share <= 0.25 THEN 0 WHEN share > 0.25 AND share <= 0.75 THEN 1 WHEN share > 0.75 AND share <= 1.5 THEN 2 WHEN share > 1.5 AND share <= 100 THEN 3 END AS bin FROM liquid)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(quantile_cont(notional, 0.5), 2) AS median_notional, round(avg(share), 6) AS mean_share FROM b GROUP BY bin""")
def participation_bins(spark, sf_dir):
    b = liquid(spark, sf_dir).withColumn("bin", S.fixed_bin(F.col("share"), [0.0, 0.25, 0.75, 1.5, 100.0]))
    return rounded(b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), R.median(F.col("notional")).alias("median_notional"), F.avg("share").alias("mean_share")), mean_share=6, median_notional=2)


@query(f"""WITH {NET}, h AS (SELECT *, CASE WHEN exit_date - entry_date <= 5 THEN '00-05' WHEN exit_date - entry_date <= 15 THEN '06-15' ELSE '16+' END AS holding FROM net)
SELECT holding, count(*) AS n, round(sum(net_pnl), 2) AS net, round(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM h GROUP BY holding""")
def holding_buckets(spark, sf_dir):
    d = F.datediff("exit_date", "entry_date")
    h = netted(spark, sf_dir).withColumn("holding", F.when(d <= 5, "00-05").when(d <= 15, "06-15").otherwise("16+"))
    return rounded(h.groupBy("holding").agg(F.count(F.lit(1)).alias("n"), F.sum("net_pnl").alias("net"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate")), net=2)


@query(f"WITH {NET} SELECT exit_date AS day, CAST(sum(CAST(round(gross_pnl * 10000) AS BIGINT)) AS BIGINT) / 10000 AS gross, CAST(sum(CAST(round(fees * 10000) AS BIGINT)) AS BIGINT) / 10000 AS fees, count(*) AS n FROM net GROUP BY exit_date")
def cost_components_daily(spark, sf_dir):
    day = netted(spark, sf_dir).groupBy(F.col("exit_date").alias("day"))
    return day.agg((F.sum(money(F.col("gross_pnl"))) / 10000).alias("gross"), (F.sum(money(F.col("fees"))) / 10000).alias("fees"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BARS}, {TRADES}, m AS (SELECT t.trade_id, side, exec_px, b.close AS later FROM trades t ASOF LEFT JOIN bars b ON b.symbol = t.symbol AND b.ts <= t.entry_date + 5)
SELECT side, count(later) AS n, round(avg(1e4 * side * (later - exec_px) / exec_px), 4) AS markout_bps FROM m GROUP BY side""")
def markouts(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("at", F.date_add("entry_date", 5))
    m = align.asof(t, bars(spark, sf_dir).select("symbol", "ts", "close"), "close", "at", out="later")
    return rounded(m.groupBy("side").agg(F.count("later").alias("n"), F.avg(S.bps(F.col("side"), F.col("later"), F.col("exec_px"))).alias("markout_bps")), 4)


@query("""WITH f AS (SELECT user_id, value AS px, CAST(json_extract_string(props, '$.k') AS BIGINT) AS q, ts FROM events WHERE event_type = 'purchase') SELECT user_id, round(sum(px * q) / nullif(sum(q), 0), 6) AS vwap, CAST(sum(q) AS BIGINT) AS qty, min(ts) AS first_fill FROM f GROUP BY user_id""")
def fill_vwap(spark, sf_dir):
    f = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("value").alias("px"), F.get_json_object("props", "$.k").cast("long").alias("q"), "ts")
    return rounded(f.groupBy("user_id").agg(F.try_divide(F.sum(F.col("px") * F.col("q")), F.sum("q")).alias("vwap"), F.sum("q").alias("qty"), F.min("ts").alias("first_fill")))


@query(f"WITH {TRADES} SELECT venue, count(*) AS n, round(avg(CASE WHEN maker_share >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS maker FROM trades GROUP BY venue")
def maker_mix(spark, sf_dir):
    return rounded(trades(spark, sf_dir).groupBy("venue").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("maker_share") >= 0.05).cast("double")).alias("maker")))


@query(f"WITH {BARS}, r AS (SELECT symbol, ts, ln(close) - lag(ln(close)) OVER ({W}) AS ret FROM bars) SELECT ts, round(sum(ret) / (SELECT count(DISTINCT symbol) FROM bars), 6) AS ret FROM r GROUP BY ts")
def equal_weight_returns(spark, sf_dir):
    b = bars(spark, sf_dir)
    n = b.agg(F.countDistinct("symbol").alias("n"))
    r = b.select("symbol", "ts", R.log_return(F.col("close")).alias("ret")).groupBy("ts").agg(F.sum("ret").alias("s"))
    return rounded(r.join(F.broadcast(n)).select("ts", (F.col("s") / F.col("n")).alias("ret")))


@query(f"WITH {BARS}, q AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY close, ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, count(*) AS n, round(avg(close), 6) AS trimmed FROM q WHERE i > n // 10 AND i <= n - n // 10 GROUP BY symbol")
def trimmed_means(spark, sf_dir):
    w = Window.partitionBy("symbol")
    q = bars(spark, sf_dir).select("symbol", "close", F.row_number().over(w.orderBy("close", "ts")).alias("i"), F.count(F.lit(1)).over(w).alias("m"))
    cut = F.floor(F.col("m") / 10)
    return rounded(q.where((F.col("i") > cut) & (F.col("i") <= F.col("m") - cut)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("trimmed")))


@query(f"""WITH {BARS}, p AS (SELECT symbol, ts, close, max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak, row_number() OVER ({W}) AS i FROM bars), d AS (SELECT *, i - row_number() OVER ({W}) AS island FROM p WHERE close < peak),
g AS (SELECT symbol, island, count(*) AS len FROM d GROUP BY ALL) SELECT symbol, max(len) AS longest, count(*) AS spells FROM g GROUP BY symbol""")
def drawdown_spells(spark, sf_dir):
    w = R.by_time()
    p = bars(spark, sf_dir).select("symbol", "ts", "close", F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"), F.row_number().over(w).alias("i"))
    d = p.where("close < peak").withColumn("island", F.col("i") - F.row_number().over(w)).groupBy("symbol", "island").agg(F.count(F.lit(1)).alias("len"))
    return d.groupBy("symbol").agg(F.max("len").alias("longest"), F.count(F.lit(1)).alias("spells"))


@query(f"""WITH {RAW}, v AS (SELECT symbol, ts, ln(close) - lag(ln(close)) OVER ({W}) AS j FROM raw WHERE close > 0), k AS (SELECT symbol, ts, j, row_number() OVER (PARTITION BY symbol ORDER BY abs(j) DESC, ts) AS q FROM v WHERE j IS NOT NULL)
SELECT symbol, ts AS jump_ts, round(j, 6) AS jump, abs(j) >= ln(1.9) AS suspicious FROM k WHERE q = 1""")
def split_suspects(spark, sf_dir):
    v = raw_bars(spark, sf_dir).where("close > 0").select("symbol", "ts", R.log_return(F.col("close")).alias("j")).where("j is not null")
    top = v.groupBy("symbol").agg(F.max_by(F.struct("ts", "j"), F.struct(F.abs("j"), -F.unix_date("ts"))).alias("x"))
    return rounded(top.select("symbol", F.col("x.ts").alias("jump_ts"), F.col("x.j").alias("jump"), (F.abs("x.j") >= F.ln(F.lit(1.9))).alias("suspicious")))


@query(f"""WITH {BARS}, l AS (SELECT symbol, ts, close / lag(close) OVER ({W}) - 1 AS ret FROM bars), e AS (SELECT symbol, make_date(y, 6, 15) AS event FROM (SELECT DISTINCT symbol FROM bars), range(1996, 2001) t(y))
SELECT symbol, event, arg_min(ts, ts) AS ts, round(arg_min(ret, ts), 6) AS ret FROM (SELECT e.symbol, event, l.ts, l.ret FROM e JOIN l ON l.symbol = e.symbol AND l.ts >= event AND l.ts <= event + 30) GROUP BY ALL""")
def action_audit(spark, sf_dir):
    ret = F.col("close") / F.lag("close").over(R.by_time()) - 1
    b = bars(spark, sf_dir).select("symbol", "ts", ret.alias("ret"))
    e = b.select("symbol").distinct().withColumn("y", F.explode(F.sequence(F.lit(1996), F.lit(2000)))).select("symbol", F.make_date("y", F.lit(6), F.lit(15)).alias("event"))
    near = e.withColumn("ts", F.explode(F.sequence("event", F.date_add("event", 30)))).join(b, ["symbol", "ts"])
    return rounded(near.groupBy("symbol", "event").agg(F.min_by(F.struct("ts", "ret"), "ts").alias("x")).select("symbol", "event", "x.ts", "x.ret"))


@query(f"WITH {BARS} SELECT symbol, round(avg(CASE WHEN year(ts) = 1996 THEN close END), 6) AS y1996, round(avg(CASE WHEN year(ts) = 1997 THEN close END), 6) AS y1997, round(avg(CASE WHEN year(ts) = 1998 THEN close END), 6) AS y1998 FROM bars GROUP BY symbol")
def yearly_pivot(spark, sf_dir):
    p = bars(spark, sf_dir).withColumn("y", F.concat(F.lit("y"), F.year("ts").cast("string"))).groupBy("symbol").pivot("y", ["y1996", "y1997", "y1998"]).agg(F.avg("close"))
    return rounded(p)


@query(f"""WITH {TRADES}, d AS (SELECT trade_id, unnest(generate_series(CAST(entry_date AS TIMESTAMP), CAST(exit_date AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM trades) SELECT trade_id, count(*) AS busdays FROM d WHERE extract(isodow FROM day) <= 5 GROUP BY trade_id""")
def business_days(spark, sf_dir):
    return align.expand_days(trades(spark, sf_dir), weekdays_only=True).groupBy("trade_id").agg(F.count(F.lit(1)).alias("busdays"))


@query(f"WITH {LIQUID} SELECT symbol, round(avg(exp(-0.02::DOUBLE) / (1 + exp(4 * (0.5::DOUBLE - 1) + 8 * (share - 0.1::DOUBLE)))), 6) AS fill FROM liquid GROUP BY symbol")
def expected_fills(spark, sf_dir):
    return rounded(liquid(spark, sf_dir).groupBy("symbol").agg(F.avg(S.expected_fill(F.lit(0.5), F.col("share"), F.lit(0.02))).alias("fill")))


@query(f"""WITH {SCORED}, c AS (SELECT s.symbol, s.ts, CASE WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 ELSE 0 END AS pos, b.close FROM scored s JOIN bars b ON b.symbol = s.symbol AND b.ts = s.ts), e AS (SELECT *, lag(pos, 1, 0) OVER ({W}) AS p, lag(close) OVER ({W}) AS pc FROM c)
SELECT symbol, round(sum(p * (close - pc)), 2) AS gross, round(-sum(abs(pos - p) * close * 5 / 1e4), 2) AS cost, CAST(sum(abs(pos - p)) AS BIGINT) AS turns FROM e GROUP BY symbol""")
def signal_pnl(spark, sf_dir):
    w = R.by_time()
    pos = F.when(F.col("z") > 1, -1).when(F.col("z") < -1, 1).otherwise(0)
    c = scored(spark, sf_dir).join(bars(spark, sf_dir).select("symbol", "ts", "close"), ["symbol", "ts"]).withColumn("pos", pos)
    e = c.withColumns({"p": F.lag("pos", 1, 0).over(w), "pc": F.lag("close").over(w)})
    turn = F.abs(F.col("pos") - F.col("p"))
    return rounded(e.groupBy("symbol").agg(F.sum(F.col("p") * (F.col("close") - F.col("pc"))).alias("gross"), (-F.sum(turn * F.col("close") * 5 / 1e4)).alias("cost"), F.sum(turn).cast("long").alias("turns")), 2)


def pnl_of_pairs(pairs):
    w = R.by_time("pair")
    py, px = F.lag("y").over(w), F.lag("x").over(w)
    l = pairs.select("pair", (F.col("y") - py).alias("dy"), (F.col("x") - px).alias("dx"), F.when(py > px, -1).otherwise(1).alias("s"))  # noqa: E741
    return rounded(l.groupBy("pair").agg(F.count("dy").alias("n"), F.sum(F.col("s") * F.col("dy") - F.col("s") * F.col("dx")).alias("pnl")), 2)


@query(f"""WITH {NEIGHBOURS}, l AS (SELECT pair, ts, y - lag(y) OVER w AS dy, x - lag(x) OVER w AS dx, CASE WHEN lag(y) OVER w > lag(x) OVER w THEN -1 ELSE 1 END AS s FROM np WINDOW w AS (PARTITION BY pair ORDER BY ts)) SELECT pair, count(dy) AS n, round(sum(s * dy - s * dx), 2) AS pnl FROM l GROUP BY pair""")
def pair_pnl(spark, sf_dir):
    return pnl_of_pairs(neighbour_pairs(spark, sf_dir))


@query(ORACLE["pair_pnl"].replace(NEIGHBOURS, ALL_PAIRS))
def all_pair_pnl(spark, sf_dir):
    return pnl_of_pairs(all_pairs(spark, sf_dir))


@query(f"""WITH {BARS}, m AS (SELECT symbol, avg(close) AS mu, stddev_pop(close) AS sd FROM bars WHERE ts < DATE '1998-01-01' GROUP BY symbol) SELECT b.symbol, count(*) AS n, round(avg((close - mu) / sd), 6) AS mean_z, round(max(abs((close - mu) / sd)), 6) AS max_z FROM bars b JOIN m ON m.symbol = b.symbol WHERE ts >= DATE '1998-01-01' AND sd > 0 GROUP BY b.symbol""")
def frozen_zscore(spark, sf_dir):
    b, cut = bars(spark, sf_dir), F.lit(dt.date(1998, 1, 1))
    m = b.where(F.col("ts") < cut).groupBy("symbol").agg(F.avg("close").alias("mu"), F.stddev_pop("close").alias("sd"))
    z = (F.col("close") - F.col("mu")) / F.col("sd")
    return rounded(b.where(F.col("ts") >= cut).join(m, "symbol").where("sd > 0").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(z).alias("mean_z"), F.max(F.abs(z)).alias("max_z")))


@query(f"""WITH {BARS}, {TRADES}, cal AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)), p AS (SELECT trade_id, pos, n FROM trades t ASOF JOIN cal c ON c.ts <= t.exit_date)
SELECT trade_id, c.ts AS settles FROM p JOIN cal c ON c.pos = least(p.pos + 2, p.n)""")
def settlement_dates(spark, sf_dir):
    cal = bars(spark, sf_dir).select("ts").distinct()
    w = Window.orderBy("ts")  # one row per session
    lagged = cal.select("ts", F.coalesce(F.lead("ts", 2).over(w), F.last("ts").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("settles"))
    at = align.map_to_calendar(trades(spark, sf_dir).select("trade_id", "exit_date"), "exit_date", cal).where("session is not null")
    return at.join(lagged, at.session == lagged.ts).select("trade_id", "settles")


@query(f"""WITH {BARS}, d AS (SELECT symbol, ts, close, 0 AS seq FROM bars UNION ALL SELECT symbol, ts, close / 2, 1 FROM bars WHERE day(ts) = 1 UNION ALL SELECT symbol, ts, NULL, 2 FROM bars WHERE day(ts) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS q FROM d WHERE close IS NOT NULL) SELECT symbol, count(*) AS n, round(sum(close), 2) AS total FROM k WHERE q = 1 GROUP BY symbol""")
def duplicate_rows(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "ts", "close")
    again = b.where(F.dayofmonth("ts") == 1)
    d = b.withColumn("seq", F.lit(0)).union(again.withColumns({"close": F.col("close") / 2, "seq": F.lit(1)})).union(again.withColumns({"close": F.lit(None).cast("double"), "seq": F.lit(2)}))
    return rounded(clean.last_present(d, ["symbol", "ts"], "seq", ["close"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total")), 2)


@query(f"WITH {RAW} SELECT symbol, count(*) AS n FROM raw WHERE close IS NULL GROUP BY symbol ORDER BY n DESC, symbol LIMIT 10")
def most_missing(spark, sf_dir):
    """Top-k report: the limit is the feature."""
    return raw_bars(spark, sf_dir).where("close is null").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol").limit(10)


@query(f"""WITH {BARS}, u AS (SELECT DISTINCT p_brand AS symbol FROM part UNION ALL SELECT 'Brand#99'), s AS (SELECT DISTINCT symbol FROM bars) SELECT (SELECT count(*) FROM u WHERE symbol NOT IN (SELECT symbol FROM s)) AS missing, (SELECT count(*) FROM s WHERE symbol NOT IN (SELECT symbol FROM u)) AS extra""")
def symbol_contract(spark, sf_dir):
    have = bars(spark, sf_dir).select("symbol").distinct()
    want = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct().union(spark.createDataFrame([("Brand#99",)], "symbol string"))
    missing = want.join(have, "symbol", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return missing.join(have.join(want, "symbol", "left_anti").agg(F.count(F.lit(1)).alias("extra")))


@query(f"""WITH {BARS}, a AS (SELECT symbol, ts, close FROM bars WHERE extract(isodow FROM ts) <> 5), z AS (SELECT symbol, ts, CASE WHEN count(close) OVER p >= 10 AND stddev_pop(close) OVER p > 0 THEN (close - avg(close) OVER p) / stddev_pop(close) OVER p END AS z FROM a WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT b.symbol, count(*) AS n, count(z) AS n_z, round(avg(z), 6) AS mean_z FROM bars b LEFT JOIN z ON z.symbol = b.symbol AND z.ts = b.ts GROUP BY b.symbol""")
def allowed_dates_zscore(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "ts", "close")
    z = b.where(F.dayofweek("ts") != 6).select("symbol", "ts", R.past_zscore(F.col("close"), 20, 10).alias("z"))
    return rounded(b.join(z, ["symbol", "ts"], "left").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("n_z"), F.avg("z").alias("mean_z")))


@query(f"WITH {LIQUID} SELECT trade_id FROM liquid WHERE adv >= 40000")
def liquid_trades(spark, sf_dir):
    return liquid(spark, sf_dir).where("adv >= 40000").select("trade_id")


@query(f"WITH {TRADES} SELECT venue, round(sum(CASE WHEN side < 0 THEN qty * exec_px * 0.0002::DOUBLE ELSE 0 END), 4) AS short_fee, round(sum(ceil(qty / 100) * 100), 2) AS lot_qty FROM trades GROUP BY venue")
def lots_and_short_fees(spark, sf_dir):
    fee = F.when(F.col("side") < 0, F.col("qty") * F.col("exec_px") * 0.0002).otherwise(0.0)
    return rounded(trades(spark, sf_dir).groupBy("venue").agg(F.sum(fee).alias("short_fee"), F.sum(S.lot_ceil(F.col("qty"), 100.0).cast("double")).alias("lot_qty")), short_fee=4, lot_qty=2)
