"""Queries of fees by event and edge, listings, checks of inputs and outputs, calendars within the day. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import checks, clean, fees, fills, listings, sessions
from tidepanel.plans.panel_queries import NEIGHBOURS, RAW, W, neighbour_pairs, raw_bars, rounded
from tidepanel.plans.research_queries import query as _query
from tidepanel.plans.trade_queries import NET, netted
from tidepanel.sources.panel import BARS, bars, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    return _query(sql, QUERIES, ORACLE)


def _any(parts: tuple[str, ...], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


SCREENER = """s AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 12 WHEN 0 THEN ' ETF' WHEN 1 THEN ' Common Stock' WHEN 2 THEN ' Income Trust' WHEN 3 THEN ' Realty Trust' WHEN 4 THEN ' Trust Common Stock' WHEN 5 THEN ' Funding Corp' WHEN 6 THEN ' Fund' WHEN 7 THEN ' Strategic Holdings' WHEN 8 THEN ' Warrant' WHEN 9 THEN ' Trust' ELSE '' END AS name,
CASE WHEN p_partkey % 5 < 2 THEN 'Finance' ELSE 'Technology' END AS sector, CASE p_partkey % 7 WHEN 0 THEN 'Investment Managers' WHEN 1 THEN 'Major Banks' ELSE 'Software' END AS industry, CASE WHEN p_partkey % 31 = 0 THEN ' Yes ' END AS etf, CASE WHEN p_partkey % 37 = 0 THEN 'Preferred Stock' ELSE p_type END AS type FROM part)"""


@query(f"""WITH {SCREENER}, u AS (SELECT id, upper(name) AS n, upper(sector) AS s, upper(industry) AS i, lower(trim(etf)) AS e, upper(type) AS t FROM s)
SELECT id, coalesce(CASE WHEN e = 'yes' OR {_any(listings.BLOCKED_TYPES, 't')} OR {_any(listings.BLOCKED_NAMES, 'n')} OR regexp_matches(n, '\\bFUNDS?\\b') THEN false WHEN contains(n, 'TRUST') THEN CASE WHEN {_any(listings.TRUST_VEHICLES, 'n')} THEN false
WHEN i IN ('MAJOR BANKS') OR {_any(listings.TRUST_COMPANIES, 'n')} THEN true WHEN s = 'FINANCE' OR NOT {_any(listings.EQUITY_NAMES, 'n')} THEN false END END, NOT (s = 'FINANCE' AND i = 'INVESTMENT MANAGERS' AND {_any(listings.VEHICLE_STYLES, 'n')})) AS common FROM u""")
def common_equity(spark, sf_dir):
    """Which names of a screener, made of the parts, are common equity."""
    table(spark, sf_dir, "part").createOrReplaceTempView("_parts_of_screener")
    rows = spark.sql("WITH " + SCREENER.replace("FROM part)", "FROM _parts_of_screener)") + " SELECT * FROM s")
    return rows.select("id", listings.common_equity(rows).alias("common"))


LEGS = f"""{NET}, legs AS (SELECT trade_id, side * qty AS units_y, -side * qty / 2 AS units_x, CASE WHEN trade_id % 3 = 0 THEN exec_px END AS exec_entry_vwap_y, exec_px * 1.01::DOUBLE AS entry_price_y, decision_px AS entry_price_x, exit_px AS exit_price_y, arrival_px AS price_x,
CASE WHEN trade_id % 4 = 0 THEN ' Maker ' END AS liquidity_y, CASE WHEN trade_id % 5 = 0 THEN 'maker' WHEN trade_id % 5 = 1 THEN 'taker' END AS liquidity_exit_x FROM net)"""


def _leg(units: str, price: str, maker: str) -> str:
    return f"(-CASE WHEN {maker} THEN -0.2 ELSE 0.7 END::DOUBLE / 10000 * abs({units} * {price}) - CASE WHEN {maker} THEN 0.001 ELSE 0.003 END::DOUBLE * greatest({units}, 0))"


@query(f"""WITH {LEGS}, e AS (SELECT trade_id, {_leg('units_y', 'coalesce(exec_entry_vwap_y, entry_price_y)', "coalesce(lower(trim(liquidity_y)) = 'maker', false)")} + {_leg('units_x', 'coalesce(entry_price_x, price_x)', 'false')} - 0.5 AS a,
{_leg('units_y', 'coalesce(exit_price_y, exec_entry_vwap_y, entry_price_y)', "coalesce(lower(trim(liquidity_y)) = 'maker', false)")} + {_leg('units_x', 'price_x', "coalesce(liquidity_exit_x = 'maker', false)")} - 0.5 AS b FROM legs),
c AS (SELECT *, CASE WHEN a + b < 0 THEN greatest(least(a + b, -2), -6) ELSE a + b END AS f FROM e) SELECT trade_id, round(f, 6) AS fees, round(coalesce(a * f / nullif(a + b, 0), 0), 6) AS fees_entry, round(coalesce(b * f / nullif(a + b, 0), 0), 6) AS fees_exit FROM c""")
def event_fees(spark, sf_dir):
    """Fees of pair trades by execution event, with rebates and bounds."""
    t, k = netted(spark, sf_dir), F.col("trade_id")
    legs = t.select(
        "trade_id", (F.col("side") * F.col("qty")).alias("units_y"), (-F.col("side") * F.col("qty") / 2).alias("units_x"), F.when(k % 3 == 0, F.col("exec_px")).alias("exec_entry_vwap_y"), (F.col("exec_px") * 1.01).alias("entry_price_y"),
        F.col("decision_px").alias("entry_price_x"), F.col("exit_px").alias("exit_price_y"), F.col("arrival_px").alias("price_x"), F.when(k % 4 == 0, " Maker ").alias("liquidity_y"),
        F.when(k % 5 == 0, "maker").when(k % 5 == 1, "taker").alias("liquidity_exit_x"),
    )
    paid = fees.event_fees(legs, 0.25, -0.2, 0.7, 0.001, 0.003, 2.0, 6.0)
    return rounded(paid.select("trade_id", "fees", "fees_entry", "fees_exit"))


POS = "CASE WHEN day(ts) < 8 THEN 1 WHEN day(ts) BETWEEN 12 AND 18 THEN -1 WHEN day(ts) BETWEEN 19 AND 22 THEN 1 WHEN day(ts) = 25 THEN NULL ELSE 0 END"


@query(f"""WITH {NEIGHBOURS}, r AS (SELECT pair, ts, y, x, {POS} AS pos, CAST(day(ts) % 4 AS DOUBLE) AS size FROM np), f AS (SELECT *, coalesce(last_value(pos IGNORE NULLS) OVER (PARTITION BY pair ORDER BY ts), 0) AS p FROM r), g AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY pair ORDER BY ts), 0) AS q FROM f),
h AS (SELECT *, p <> 0 AND p <> q AS i, q <> 0 AND p <> q AS o, -(1.0 + 0.01::DOUBLE * greatest(size, 1) + greatest(size, 1) * (y + x) * 0.0002::DOUBLE) AS raw FROM g), n AS (SELECT *, CAST(sum(CASE WHEN i THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY ts) AS BIGINT) AS no FROM h),
e AS (SELECT pair, ts, no, raw, false AS out FROM n WHERE i UNION ALL SELECT pair, ts, no - CASE WHEN i THEN 1 ELSE 0 END, raw, true FROM n WHERE o), t AS (SELECT *, sum(raw) OVER (PARTITION BY pair, no) AS total, bool_or(out) OVER (PARTITION BY pair, no) AS done FROM e WHERE no > 0),
c AS (SELECT pair, ts, sum(CASE WHEN done THEN raw * greatest(least(total, -3), -4.5) / total ELSE raw END) AS cost FROM t GROUP BY ALL) SELECT r.pair, r.ts, round(coalesce(cost, 0), 6) AS cost FROM r LEFT JOIN c ON c.pair = r.pair AND c.ts = r.ts""")
def edge_fees(spark, sf_dir):
    """Fees on the edges of positions that turn, pause and stay open."""
    d = F.dayofmonth("ts")
    pos = F.when(d < 8, 1).when(d.between(12, 18), -1).when(d.between(19, 22), 1).when(d == 25, None).otherwise(0)
    rows = neighbour_pairs(spark, sf_dir).withColumns({"pos": pos, "size": (d % 4).cast("double")})
    return rounded(fees.edge_fees(rows, 0.5, 2.0, 0.005, 3.0, 4.5).select("pair", "ts", "cost"))


@query(f"""WITH {NEIGHBOURS}, r AS (SELECT pair, ts, y, x, CAST(day(ts) % 4 AS DOUBLE) AS size, CASE WHEN day(ts) % 5 > 0 THEN y * 50 END AS ay, CASE WHEN day(ts) % 5 > 1 THEN x * 40 ELSE 0 END AS ax, CASE WHEN day(ts) % 3 > 0 THEN day(ts) / 1000.0::DOUBLE END AS vy, CASE WHEN day(ts) % 2 > 0 THEN 0.02::DOUBLE END AS vx FROM np),
s AS (SELECT *, (y + x) * size AS nt, coalesce(CASE WHEN ay > 0 AND ax > 0 THEN ay + ax END, CASE WHEN ay > 0 THEN ay END, CASE WHEN ax > 0 THEN ax END) AS adv, coalesce(sqrt((vy * vy + vx * vx) / 2), vy, vx, 1.0) AS vol FROM r)
SELECT pair, ts, round(CASE WHEN nt <= 0 THEN 0 WHEN adv IS NULL THEN 0.0002 ELSE least(0.0002::DOUBLE + greatest(0.1::DOUBLE * vol * sqrt(nt / adv), 0.0003), 0.02) END, 9) AS by_root, round(CASE WHEN nt <= 0 THEN 0 WHEN adv IS NULL THEN 0.0002 ELSE least(0.0002::DOUBLE + 0.05::DOUBLE * nt / adv, 0.02) END, 9) AS by_line,
round(CASE WHEN nt <= 0 THEN 0 WHEN adv IS NULL THEN 0.0002 ELSE least(0.0002::DOUBLE + 0.1::DOUBLE * pow(nt / adv, 0.7::DOUBLE), 0.02) END, 9) AS by_power FROM s""")
def pair_slippage(spark, sf_dir):
    """Slippage of both legs by three models, with unknown volumes and volatilities."""
    d, y, x = F.dayofmonth("ts"), F.col("y"), F.col("x")
    legs = ((d % 4).cast("double"), y, x, F.when(d % 5 > 0, y * 50), F.when(d % 5 > 1, x * 40).otherwise(0), F.when(d % 3 > 0, d / 1000.0), F.when(d % 2 > 0, 0.02))
    line = {"by_root": fees.pair_slippage(*legs, floor_bps=3.0), "by_line": fees.pair_slippage(*legs, model="linear", coef=0.05), "by_power": fees.pair_slippage(*legs, model="power", power=0.7)}
    return rounded(neighbour_pairs(spark, sf_dir).select("pair", "ts", *[v.alias(k) for k, v in line.items()]), 9)


def _rule(code: str, severity: str, rows: str, bad: str, name: str) -> str:
    return f"SELECT '{code}' AS code, '{severity}' AS severity, count(*) AS n, CAST(count(*) FILTER ({bad}) AS BIGINT) AS n_bad, CAST(min({name}) FILTER ({bad}) AS VARCHAR) AS first_bad, CAST(max({name}) FILTER ({bad}) AS VARCHAR) AS last_bad FROM {rows}"


ROW = "(symbol || '/' || CAST(ts AS VARCHAR))"


@query(f"""WITH {BARS}, k AS (SELECT symbol, ts, CAST(month(ts) + CAST(substr(symbol, 7, 2) AS INT) AS INT) AS k, volume FROM bars), rates AS (SELECT symbol, ts, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 7 = 0 THEN 0.9 ELSE 0.03 END AS rate FROM k WHERE day(ts) = 1 AND symbol <> 'Brand#5'), symbols AS (SELECT DISTINCT symbol FROM bars WHERE symbol <> 'Brand#9'),
av AS (SELECT symbol, ts, volume - 20 AS available FROM k WHERE day(ts) = 2) {' UNION ALL '.join([
    _rule('RATE_MISSING', 'fail', 'rates', 'rate IS NULL', ROW), _rule('RATE_OUT_OF_BOUNDS', 'warn', 'rates', 'rate < 0.0001 OR rate > 0.5', ROW),
    _rule('SYMBOL_WITHOUT_RATE', 'warn', 'symbols', 'symbol NOT IN (SELECT symbol FROM rates)', 'symbol'), _rule('AVAILABILITY_OF_UNKNOWN_SYMBOL', 'warn', '(SELECT DISTINCT symbol FROM av)', 'symbol NOT IN (SELECT symbol FROM symbols)', 'symbol'),
    _rule('AVAILABILITY_NEGATIVE', 'fail', 'av', 'available < 0', ROW)])}""")
def borrow_checks(spark, sf_dir):
    b = bars(spark, sf_dir)
    k = F.month("ts") + F.substring("symbol", 7, 2).cast("int")
    rates = b.where((F.dayofmonth("ts") == 1) & (F.col("symbol") != "Brand#5")).select("symbol", "ts", F.when(k % 9 == 0, None).when(k % 7 == 0, 0.9).otherwise(0.03).alias("rate_annual"))
    symbols = b.select("symbol").distinct().where("symbol <> 'Brand#9'")
    return checks.check_borrow(rates, symbols, b.where(F.dayofmonth("ts") == 2).select("symbol", "ts", (F.col("volume") - 20).alias("available")))


@query(f"""WITH {RAW}, listed AS (SELECT DISTINCT symbol FROM raw WHERE symbol <> 'Brand#7' UNION ALL SELECT 'Brand#3' UNION ALL SELECT 'New#1'), prices AS (SELECT * FROM raw), volumes AS (SELECT symbol, ts, volume FROM raw WHERE day(ts) <> 13), funds AS (SELECT DISTINCT symbol FROM raw WHERE symbol <> 'Brand#2'), days AS (SELECT DISTINCT ts FROM prices) {' UNION ALL '.join([
    _rule('TICKERS_DUPLICATES', 'error', '(SELECT symbol, count(*) AS c FROM listed GROUP BY symbol)', 'c > 1', 'symbol'),
    _rule('TICKERS_WITHOUT_PRICES', 'error', '(SELECT DISTINCT symbol FROM listed)', 'symbol NOT IN (SELECT symbol FROM prices)', 'symbol'),
    _rule('PRICES_OF_UNLISTED', 'error', '(SELECT DISTINCT symbol FROM prices)', 'symbol NOT IN (SELECT symbol FROM listed)', 'symbol'),
    _rule('FUNDAMENTALS_MISSING', 'warn', '(SELECT DISTINCT symbol FROM listed)', 'symbol NOT IN (SELECT symbol FROM funds)', 'symbol'),
    _rule('PRICE_INDEX_ORDER', 'error', '(SELECT symbol, ts, count(*) AS c FROM prices GROUP BY ALL)', 'c > 1', ROW),
    _rule('INDEX_MISMATCH', 'error', '(SELECT p.symbol, p.ts, v.symbol IS NULL AS gone FROM (SELECT DISTINCT symbol, ts FROM prices) p LEFT JOIN (SELECT DISTINCT symbol, ts FROM volumes) v ON v.symbol = p.symbol AND v.ts = p.ts)', 'gone', ROW),
    _rule('MULTIPLE_TIMES_PER_DAY', 'error', '(SELECT ts, count(*) AS c FROM days GROUP BY ts)', 'c > 1', 'ts'), _rule('WEEKEND_ROWS', 'warn', 'days', 'isodow(ts) > 5', 'ts'),
    _rule('PRICE_NOT_POSITIVE', 'error', 'prices', 'least(open, high, low, close) <= 0', ROW), _rule('HIGH_BELOW_LOW', 'error', 'prices', 'high < low', ROW),
    _rule('OHLC_BROKEN', 'warn', 'prices', 'high < greatest(open, close) OR low > least(open, close)', ROW), _rule('CLOSE_MISSING', 'warn', 'prices', 'close IS NULL', ROW),
    _rule('VOLUME_NEGATIVE', 'error', 'volumes', 'volume < 0', ROW), _rule('VOLUME_ZERO', 'warn', 'volumes', 'volume = 0', ROW)])}""")
def universe_checks(spark, sf_dir):
    """Every rule on a universe's outputs, with planted faults."""
    raw = raw_bars(spark, sf_dir)
    symbols = raw.select("symbol").distinct()
    listed = symbols.where("symbol <> 'Brand#7'").union(spark.createDataFrame([("Brand#3",), ("New#1",)], "symbol string"))
    return checks.check_universe(listed, raw, raw.where(F.dayofmonth("ts") != 13), symbols.where("symbol <> 'Brand#2'"))


KINDS = ("day", "week", "month", "quarter", "year")


@query(f"""WITH {BARS}, d AS ({' UNION ALL '.join(f"SELECT DISTINCT '{k}' AS kind, CAST(date_trunc('{k}', ts) AS DATE) AS ts FROM bars" for k in KINDS)}), g AS (SELECT kind, ts - lag(ts) OVER (PARTITION BY kind ORDER BY ts) AS g FROM d), m AS (SELECT kind, min(g) AS lo, max(g) AS hi FROM g GROUP BY kind)
SELECT kind, CASE WHEN lo >= 1 AND hi <= 3 THEN 252 WHEN lo >= 7 AND hi <= 7 THEN 52 WHEN lo >= 28 AND hi <= 31 THEN 12 WHEN lo >= 89 AND hi <= 92 THEN 4 WHEN lo >= 365 AND hi <= 366 THEN 1 ELSE 252 END::INT AS periods FROM m""")
def annual_periods(spark, sf_dir):
    """Periods a year of daily, weekly, monthly, quarterly and yearly days."""
    out = None
    for kind in KINDS:
        one = fills.annual_factor(bars(spark, sf_dir).select(F.date_trunc(kind, "ts").cast("date").alias("ts"))).select(F.lit(kind).alias("kind"), "periods")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {BARS}, b AS (SELECT 'bars' AS panel, symbol, CAST(ts AS TIMESTAMP) AS ts FROM bars UNION ALL SELECT 'events', event_type, ts FROM events), d AS (SELECT panel, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY panel, symbol ORDER BY ts)) AS x FROM b)
SELECT panel, coalesce(avg(CASE WHEN x < 86400 THEN 1.0 ELSE 0.0 END) >= 0.5, false) AS intraday FROM d WHERE x IS NOT NULL GROUP BY panel""")
def intraday_panel(spark, sf_dir):
    """Daily bars are no intraday panel, events are one."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    both = [(n, clean.is_intraday(p)) for n, p in (("bars", bars(spark, sf_dir)), ("events", events))]
    return both[0][1].select(F.lit("bars").alias("panel"), "intraday").union(both[1][1].select(F.lit("events").alias("panel"), "intraday"))


#: Sessions of New York in UTC: five hours behind, four in daylight saving time.
SESSIONS = """days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE isodow(ts) < 6), md AS (SELECT day, CAST(day AS TIMESTAMP) + INTERVAL 1 HOUR * CASE WHEN (day >= DATE '2024-03-10' AND day < DATE '2024-11-03') OR (day >= DATE '2025-03-09' AND day < DATE '2025-11-02') THEN 4 ELSE 5 END AS midnight FROM days),
bar AS (SELECT day, midnight + INTERVAL 570 MINUTE + INTERVAL 1 MINUTE * m AS ts FROM md, range(0, 390, 30) t(m))"""


def event_sessions(spark, sf_dir) -> DataFrame:
    return sessions.session_bars(sessions.weekdays(table(spark, sf_dir, "events")), 30)


@query(f"WITH {SESSIONS} SELECT day, count(*) AS n, min(ts) AS first_bar, max(ts) AS last_bar FROM bar GROUP BY day")
def session_days(spark, sf_dir):
    """Half-hour bars of every weekday's New York session, in UTC."""
    return event_sessions(spark, sf_dir).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_bar"), F.max("ts").alias("last_bar"))


@query(f"""WITH {SESSIONS}, e AS (SELECT event_type AS symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, value FROM events), g AS (SELECT symbol, ts, arg_max(value, value) AS value, count(*) AS n FROM e GROUP BY ALL), u AS (SELECT ts FROM bar UNION SELECT ts FROM g), s AS (SELECT DISTINCT symbol FROM g)
SELECT s.symbol, count(*) AS n_grid, CAST(count(*) FILTER (b.ts IS NOT NULL) AS BIGINT) AS n_session, CAST(count(g.n) AS BIGINT) AS n_bars, CAST(count(*) FILTER (b.ts IS NOT NULL AND g.n IS NULL) AS BIGINT) AS n_missing FROM s, u LEFT JOIN bar b ON b.ts = u.ts LEFT JOIN g ON g.symbol = s.symbol AND g.ts = u.ts GROUP BY s.symbol""")
def session_grid(spark, sf_dir):
    """Half-hour bars of events on the union of their own times and the sessions: which are in a session, and which of those a symbol lacks."""
    half = F.window(F.col("ts").cast("timestamp"), "30 minutes")["start"]
    panel = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), half.alias("ts")).agg(F.max("value").alias("value"))
    out = sessions.on_union(panel, event_sessions(spark, sf_dir))
    told = [F.count(F.lit(1)).alias("n_grid"), F.count_if("tradable").alias("n_session"), F.count("value").alias("n_bars"), F.count_if(F.col("tradable") & F.col("value").isNull()).alias("n_missing")]
    return out.groupBy("symbol").agg(*told)
