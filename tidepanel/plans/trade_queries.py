"""Queries over trades: execution, costs, valuation, reports; each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import scalars as S
from tidepanel.functions.scalars import money
from tidepanel.operators import align, reports, signals, trades as T
from tidepanel.plans.panel_queries import POSITIONS, SCORED, rounded, scored
from tidepanel.sources.panel import BARS, TRADES, bars, table, trades
from tidepanel.streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {TRADES} SELECT trade_id, round(1e4 * side * (exec_px - decision_px) / decision_px, 6) + 0 AS decision_bps, round(1e4 * side * (exec_px - arrival_px) / arrival_px, 6) + 0 AS arrival_bps FROM trades")
def tca_shortfalls(spark, sf_dir):
    return rounded(T.shortfalls(trades(spark, sf_dir)).select("trade_id", "decision_bps", "arrival_bps"))


@query(f"""WITH {TRADES}, s AS (SELECT 1e4 * side * (exec_px - decision_px) / decision_px AS decision_bps, 1e4 * side * (exec_px - arrival_px) / arrival_px AS arrival_bps FROM trades), u AS (SELECT 'decision_bps' AS metric, decision_bps AS v FROM s UNION ALL SELECT 'arrival_bps', arrival_bps FROM s)
SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) + 0 AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95 FROM u GROUP BY metric""")
def tca_quantiles(spark, sf_dir):
    return rounded(reports.quantiles(T.shortfalls(trades(spark, sf_dir)), ["decision_bps", "arrival_bps"]))


FEE = "-least(greatest(1.0 + abs(qty * exec_px) * 1.0 / 1e4 + abs(qty) * 0.005, 1.0), greatest(1.0, abs(qty * exec_px) * 0.005))"


@query(f"WITH {TRADES} SELECT trade_id, round({FEE}, 6) AS fee FROM trades")
def light_fees(spark, sf_dir):
    return rounded(trades(spark, sf_dir).select("trade_id", T.light_fees(F.col("qty"), F.col("exec_px")).alias("fee")))


@query(f"""WITH {TRADES}, tiers(venue, threshold, rate_bps) AS (SELECT v, t, b FROM (SELECT DISTINCT o_orderpriority AS v FROM orders), (VALUES (100.0, 3.0), (10000.0, 2.0), (30000.0, 1.0)) x(t, b)),
m AS (SELECT trade_id, venue, qty * exec_px AS notional FROM trades), p AS (SELECT m.trade_id, notional, coalesce(arg_max(rate_bps, threshold) FILTER (threshold <= notional), arg_min(rate_bps, threshold)) AS rate_bps FROM m JOIN tiers t ON t.venue = m.venue GROUP BY m.trade_id, notional)
SELECT CAST(rate_bps AS DOUBLE) AS rate_bps, count(*) AS n, round(sum(notional * rate_bps / 1e4), 2) AS fees FROM p GROUP BY rate_bps""")
def venue_fee_tiers(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("notional", F.col("qty") * F.col("exec_px"))
    steps = F.array(*[F.struct(F.lit(a).alias("threshold"), F.lit(b).alias("rate_bps")) for a, b in ((100.0, 3.0), (10000.0, 2.0), (30000.0, 1.0))])
    tiers = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("venue")).distinct().select("venue", F.inline(steps))
    return T.tier_fees(t, tiers, "notional").groupBy("rate_bps").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("notional") * F.col("rate_bps") / 1e4), 2).alias("fees"))


@query(f"""WITH {BARS}, {TRADES}, a AS (SELECT symbol, avg(close * volume) AS adv FROM bars GROUP BY symbol), x AS (SELECT t.symbol, qty * exec_px AS n, adv FROM trades t JOIN a ON a.symbol = t.symbol)
SELECT symbol, round(avg(least(50.0, greatest(1.0, 0.5 + 10 * sqrt(n / adv)))), 6) AS impact_bps, round(avg(greatest(0.05, 1 / (1 + (0.5 * n / adv) * (0.5 * n / adv)))), 6) AS fill_prob FROM x GROUP BY symbol""")
def slippage_and_fill(spark, sf_dir):
    adv = bars(spark, sf_dir).groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"))
    x = trades(spark, sf_dir).join(adv, "symbol").withColumn("n", F.col("qty") * F.col("exec_px"))
    return rounded(x.groupBy("symbol").agg(F.avg(S.impact_bps(F.col("n"), F.col("adv"), 0.5, 10.0, 0.5, 1.0, 50.0)).alias("impact_bps"), F.avg(S.fill_probability(F.col("n"), F.col("adv"), 0.5, 0.05)).alias("fill_prob")))


@query(f"""WITH {BARS}, {TRADES}, a AS (SELECT symbol, avg(close * volume) AS adv, stddev_pop(close) / avg(close) AS sg FROM bars GROUP BY symbol)
SELECT trade_id, CAST(greatest(0, least(floor(1000000.0 * 0.01 / (exec_px * sg)), floor(50000.0 / exec_px), floor(0.1::DOUBLE * adv / exec_px))) AS BIGINT) AS units FROM trades t JOIN a ON a.symbol = t.symbol""")
def risk_sizing(spark, sf_dir):
    a = bars(spark, sf_dir).groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"), (F.stddev_pop("close") / F.avg("close")).alias("sg"))
    return trades(spark, sf_dir).join(a, "symbol").select("trade_id", T.size_by_risk(F.col("exec_px"), F.col("sg"), 1e6, 0.01, 50000.0, 0.1, F.col("adv")).cast("long").alias("units"))


PRICED = f"""{BARS}, {TRADES}, priced AS (SELECT t.*, b.close AS exit_px, side * qty * (b.close - exec_px) AS gross_pnl FROM trades t ASOF JOIN bars b ON b.symbol = t.symbol AND b.ts <= t.exit_date WHERE b.close > 0)"""


@query(f"WITH {PRICED} SELECT trade_id, round(exit_px, 6) AS exit_px, round(gross_pnl * 10000) / 10000 + 0.0 AS gross_pnl FROM priced")
def asof_exit(spark, sf_dir):
    out = T.priced_exit(trades(spark, sf_dir), bars(spark, sf_dir))
    return rounded(out.select("trade_id", "exit_px", (money(F.col("gross_pnl")) / 10000).alias("gross_pnl")))


NET = f"{PRICED}, net AS (SELECT *, {FEE} AS fees, gross_pnl + {FEE} AS net_pnl, CAST(date_trunc('quarter', exit_date) AS DATE) AS quarter FROM priced)"


def netted(spark, sf_dir):
    t = T.priced_exit(trades(spark, sf_dir), bars(spark, sf_dir)).withColumn("fees", T.light_fees(F.col("qty"), F.col("exec_px")))
    return t.withColumns({"net_pnl": F.col("gross_pnl") + F.col("fees"), "quarter": F.trunc("exit_date", "quarter")})


@query(f"WITH {NET} SELECT symbol, quarter, round(sum(gross_pnl), 2) AS gross, round(sum(fees), 2) AS fees, round(sum(net_pnl), 2) AS net, count(*) AS n, round(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(net_pnl), 2) AS mean_net, round(stddev_samp(net_pnl), 2) AS std_net FROM net GROUP BY symbol, quarter")
def pnl_explain(spark, sf_dir):
    return rounded(reports.explain(netted(spark, sf_dir), ["symbol", "quarter"]), 2, win_rate=6)


@query(f"""WITH {NET}, g AS (SELECT symbol, sum(net_pnl) AS net FROM net GROUP BY symbol), r AS (SELECT *, row_number() OVER (ORDER BY abs(net) DESC, symbol) AS q FROM g) SELECT CASE WHEN q <= 5 THEN symbol ELSE '__REST__' END AS symbol, round(sum(net), 2) AS net, count(*) AS groups FROM r GROUP BY ALL""")
def top_symbols(spark, sf_dir):
    g = netted(spark, sf_dir).groupBy("symbol").agg(F.sum("net_pnl").alias("net"))
    return rounded(reports.top_and_rest(g, "symbol", "net", 5), 2)


@query(f"""WITH {NET}, g AS (SELECT symbol, abs(sum(net_pnl)) AS v FROM net GROUP BY symbol), r AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS q, sum(v) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum FROM g)
SELECT count(*) AS n, round(sum(CASE WHEN q <= 5 THEN v END) / sum(v), 6) AS top_share, round((count(*) + 1) / count(*) - 2 * sum(cum) / (count(*) * sum(v)) + 0, 6) AS gini FROM r""")
def pnl_concentration(spark, sf_dir):
    g = netted(spark, sf_dir).groupBy("symbol").agg(F.sum("net_pnl").alias("net"))
    return rounded(reports.concentration(g, "net"))


PATHS = f"""{BARS}, {TRADES}, days AS (SELECT trade_id, symbol, entry_date, exit_date, side, qty, exec_px, CAST(unnest(generate_series(CAST(entry_date AS TIMESTAMP), CAST(exit_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM trades),
paths AS (SELECT d.*, coalesce(b.close, exec_px) AS px FROM days d ASOF LEFT JOIN bars b ON b.symbol = d.symbol AND b.ts <= d.day)"""


def paths(spark, sf_dir):
    return T.daily_values(trades(spark, sf_dir), bars(spark, sf_dir))


@query(f"WITH {PATHS} SELECT trade_id, round(-0.1::DOUBLE / 360 * sum(qty * px), 4) AS borrow, count(*) AS days FROM paths WHERE side < 0 AND day > entry_date GROUP BY trade_id")
def borrow_accrual(spark, sf_dir):
    return rounded(T.borrow_cost(paths(spark, sf_dir), 0.1), 4)


EQUITY = f"""{PATHS}, moves AS (SELECT day, side * qty * (px - coalesce(lag(px) OVER (PARTITION BY trade_id ORDER BY day), exec_px)) AS d FROM paths), cents AS (SELECT day, CAST(sum(CAST(round(d * 10000) AS BIGINT)) AS BIGINT) AS m FROM moves GROUP BY day), pnl AS (SELECT day, m, m / 10000 AS pnl FROM cents),
eq AS (SELECT day, pnl, (CAST(1000000000000 AS BIGINT) + CAST(sum(m) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT)) / 10000 AS equity FROM pnl), dd AS (SELECT *, max(equity) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM eq), curve AS (SELECT *, equity / peak - 1 AS drawdown FROM dd)"""


def curve(spark, sf_dir):
    return T.equity(T.daily_pnl(paths(spark, sf_dir)), 1e8)


@query(f"WITH {EQUITY} SELECT day, pnl, equity, peak, round(drawdown, 6) AS drawdown FROM curve")
def mtm_equity(spark, sf_dir):
    return rounded(curve(spark, sf_dir))


@query(f"""WITH {EQUITY}, r AS (SELECT *, pnl / (equity - pnl) AS r FROM curve) SELECT count(*) AS n, round(sum(pnl) / 1e8, 6) AS total_return, round(avg(r), 6) AS mean, round(stddev_samp(r) * sqrt(252), 6) AS vol, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe,
round(avg(r) / sqrt(avg(pow(least(r, 0), 2))) * sqrt(252), 6) AS sortino, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(min(drawdown), 6) AS max_drawdown FROM r""")
def performance_stats(spark, sf_dir):
    return rounded(reports.performance(curve(spark, sf_dir), 1e8))


@query(f"WITH {EQUITY} SELECT year(day) AS \"year\", month(day) AS \"month\", round(exp(sum(ln(1 + pnl / (equity - pnl)))) - 1, 6) AS ret FROM curve GROUP BY ALL")
def monthly_returns(spark, sf_dir):
    return rounded(reports.monthly(curve(spark, sf_dir)))


@query(f"""WITH {EQUITY}, r AS (SELECT pnl / (equity - pnl) AS r FROM curve), m AS (SELECT count(*) AS n, avg(r) AS mu, stddev_samp(r) AS sd, avg(r) / stddev_samp(r) AS sr FROM r),
c AS (SELECT avg(pow(r - mu, 2)) AS m2, avg(pow(r - mu, 3)) AS m3, avg(pow(r - mu, 4)) AS m4 FROM r, m), s AS (SELECT n, sr, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurt FROM m, c)
SELECT n, round(sr, 6) AS sr, round(skew, 4) AS skew, round(kurt, 4) AS kurt, round(sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr), 4) AS psr_z FROM s""")
def sharpe_significance(spark, sf_dir):
    r = curve(spark, sf_dir).select((F.col("pnl") / (F.col("equity") - F.col("pnl"))).alias("r"))
    return rounded(reports.probabilistic_sharpe(reports.moments(r, "r")), 4, sr=6)


@query(f"""WITH RECURSIVE {TRADES}, tn AS MATERIALIZED (SELECT trade_id, symbol, entry_date, exit_date, row_number() OVER (PARTITION BY symbol ORDER BY entry_date, exit_date, trade_id) AS k FROM trades), walk AS (
SELECT symbol, k, trade_id, entry_date, exit_date, exit_date AS last_exit, true AS kept FROM tn WHERE k = 1 UNION ALL
SELECT t.symbol, t.k, t.trade_id, t.entry_date, t.exit_date, CASE WHEN t.entry_date > w.last_exit THEN t.exit_date ELSE w.last_exit END, t.entry_date > w.last_exit FROM walk w JOIN tn t ON t.symbol = w.symbol AND t.k = w.k + 1)
SELECT trade_id, symbol, entry_date, exit_date FROM walk WHERE kept""")
def position_ledger(spark, sf_dir):
    return T.ledger(trades(spark, sf_dir))


@query(f"WITH {TRADES} SELECT leg, symbol, count(*) AS n, round(sum(q), 2) AS net_qty FROM (SELECT 'entry' AS leg, symbol, side * qty AS q FROM trades UNION ALL SELECT 'exit', symbol, -side * qty FROM trades) GROUP BY ALL")
def order_conversion(spark, sf_dir):
    return T.orders_of(trades(spark, sf_dir)).groupBy("leg", "symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("signed_qty"), 2).alias("net_qty"))


@query(f"""WITH {BARS}, {TRADES}, rc AS (SELECT DISTINCT symbol, ts AS day FROM bars WHERE volume > 60), d AS (SELECT trade_id, min(day) AS recall FROM trades t JOIN rc ON rc.symbol = t.symbol AND day >= entry_date AND day <= exit_date WHERE side < 0 GROUP BY trade_id)
SELECT t.trade_id, least(exit_date, coalesce(recall + 2, exit_date)) AS exit_date, recall FROM trades t LEFT JOIN d ON d.trade_id = t.trade_id""")
def borrow_recalls(spark, sf_dir):
    recalls = bars(spark, sf_dir).where("volume > 60").select("symbol", F.col("ts").alias("day"))
    return T.enforce_recalls(trades(spark, sf_dir), recalls, 2).select("trade_id", "exit_date", "recall")


@query(f"""WITH {BARS}, {TRADES}, cal AS (SELECT DISTINCT ts FROM bars WHERE extract(isodow FROM ts) IN (1, 4)),
p AS (SELECT trade_id, exit_date, c.ts AS prior FROM trades t ASOF LEFT JOIN cal c ON c.ts <= t.exit_date), j AS (SELECT p.*, c.ts AS later FROM p ASOF LEFT JOIN cal c ON c.ts >= p.exit_date)
SELECT trade_id, CASE WHEN prior IS NULL THEN later WHEN later IS NULL THEN prior WHEN exit_date - prior <= later - exit_date THEN prior ELSE later END AS session FROM j""")
def calendar_nearest(spark, sf_dir):
    cal = bars(spark, sf_dir).where(F.dayofweek("ts").isin(2, 5)).select("ts")
    return align.map_to_calendar(trades(spark, sf_dir).select("trade_id", "exit_date"), "exit_date", cal, "nearest").select("trade_id", "session")


@query("""WITH x AS (SELECT l_quantity AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), b AS (SELECT s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q FROM x GROUP BY s), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp FROM b)
SELECT round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS auc, sum(p) AS n_pos, sum(q) AS n_neg FROM c""")
def roc_auc(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(reports.roc(x, "s", "y"))


@query("""WITH x AS (SELECT l_extendedprice AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), b AS (SELECT s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q FROM x GROUP BY s),
c AS (SELECT abs(sum(p) OVER w / sum(p) OVER () - sum(q) OVER w / sum(q) OVER ()) AS d FROM b WINDOW w AS (ORDER BY s ROWS UNBOUNDED PRECEDING)) SELECT round(max(d), 6) AS ks FROM c""")
def ks_distance(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(reports.ks(x, "s", "y"))


@query(f"""WITH {NET}, s AS (SELECT symbol AS model, year(exit_date) AS fold, avg(CASE WHEN month(exit_date) <= 6 THEN net_pnl END) AS is_score, avg(CASE WHEN month(exit_date) > 6 THEN net_pnl END) AS oos_score FROM net GROUP BY ALL), f AS (SELECT * FROM s WHERE is_score IS NOT NULL AND oos_score IS NOT NULL),
r AS (SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY is_score DESC, model) AS b, row_number() OVER (PARTITION BY fold ORDER BY oos_score, model) / (count(*) OVER (PARTITION BY fold) + 1) AS w FROM f)
SELECT count(*) AS folds, round(avg(CASE WHEN w <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pbo, round(avg(ln(w / (1 - w))), 6) AS mean_logit FROM r WHERE b = 1""")
def backtest_overfitting(spark, sf_dir):
    half = F.month("exit_date") <= 6
    s = netted(spark, sf_dir).groupBy(F.col("symbol").alias("model"), F.year("exit_date").alias("fold")).agg(F.avg(F.when(half, F.col("net_pnl"))).alias("is_score"), F.avg(F.when(~half, F.col("net_pnl"))).alias("oos_score"))
    return rounded(reports.overfit_probability(s.where("is_score is not null and oos_score is not null")))


@query(f"""WITH RECURSIVE {POSITIONS}, l AS (SELECT symbol, ts, pos, coalesce(lag(pos) OVER w, 0) AS q, lead(pos) OVER w AS nx, lead(ts) OVER w AS nt FROM walk WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT *, sum(CASE WHEN pos <> 0 AND pos <> q THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS trade_no FROM l)
SELECT symbol, CAST(trade_no AS BIGINT) AS trade_no, arg_min(pos, ts) AS side, min(ts) AS entry_ts, count(*) AS rows, max(CASE WHEN nx <> pos THEN nt END) AS exit_ts FROM g WHERE pos <> 0 GROUP BY ALL""")
def signal_trades(spark, sf_dir):
    """Trades of the state machine's position edges."""
    return T.edges(signals.positions(scored(spark, sf_dir)))


@query(f"""WITH {SCORED}, p AS (SELECT symbol, ts, CASE WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 ELSE 0 END AS pos FROM scored), l AS (SELECT *, coalesce(lag(pos) OVER w, 0) AS q, lead(pos) OVER w AS nx, lead(ts) OVER w AS nt FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT *, sum(CASE WHEN pos <> 0 AND pos <> q THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS trade_no FROM l)
SELECT symbol, CAST(trade_no AS BIGINT) AS trade_no, arg_min(pos, ts) AS side, min(ts) AS entry_ts, count(*) AS rows, max(CASE WHEN nx <> pos THEN nt END) AS exit_ts FROM g WHERE pos <> 0 GROUP BY ALL""")
def position_edges(spark, sf_dir):
    pos = F.when(F.col("z") > 1, -1).when(F.col("z") < -1, 1).otherwise(0)
    return T.edges(scored(spark, sf_dir).select("symbol", "ts", pos.alias("pos")))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL""")
def streaming_day_windows(spark, sf_dir):
    """Event-time windows by a file stream run to its end, late rows within the watermark."""
    return live.run_to_end(spark, live.day_windows(live.event_stream(spark, sf_dir)), "append", flush=True)


@query("SELECT user_id, count(*) AS n, max(ts) AS last_ts, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases FROM events GROUP BY user_id")
def streaming_user_state(spark, sf_dir):
    """Running state per user, emitted in update mode; the last update per user is the state."""
    return live.latest(live.run_to_end(spark, live.user_totals(live.event_stream(spark, sf_dir)), "update"), "user_id", "n")
