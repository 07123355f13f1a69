"""Queries of pair research: cointegration tests, clusters, folds, bootstrap. Each has its SQL beside it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.rolling import trailing
from tidepanel.operators import cointegration as tests_of
from tidepanel.operators import clusters, folds, sampling, strategy
from tidepanel.plans.panel_queries import BARS, W, all_pairs, rounded
from tidepanel.sources.panel import bars, trades

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, queries: dict = QUERIES, oracle: dict = ORACLE):
    """Registers a query with its SQL."""

    def add(f):
        queries[f.__name__] = f
        if sql is not None:
            oracle[f.__name__] = sql
        return f

    return add


def smoothed_pairs(spark, sf_dir) -> DataFrame:
    """pair, ts, y, x: 20-row means of the closes of every two symbols on their common days."""
    means = bars(spark, sf_dir).select("symbol", "ts", F.avg("close").over(trailing(20)).alias("close"))
    symbols = means.select("symbol").distinct()
    pairs = symbols.select(F.col("symbol").alias("left")).join(symbols.select(F.col("symbol").alias("right")), F.col("left") < F.col("right"))
    return tests_of.pair_rows(means, pairs)


#: Residual lists, the regressions' inner products, and their sweeps: one pivot a step.
ENGLE_GRANGER = f"""{BARS}, means AS (SELECT symbol, ts, avg(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS close FROM bars),
np AS (SELECT a.symbol || '-' || b.symbol AS pair, a.ts, a.close AS y, b.close AS x FROM means a JOIN means b ON b.ts = a.ts AND a.symbol < b.symbol),
fit AS (SELECT pair, count(*) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM np GROUP BY pair HAVING count(*) >= 30),
res AS (SELECT pair, n, beta, alpha, least(n // 2 - 1, ceil(12 * pow(n / 100.0::DOUBLE, 0.25))::BIGINT) AS lim, list(y - alpha - beta * x ORDER BY ts) AS e FROM np JOIN fit USING (pair) GROUP BY ALL),
dif AS (SELECT *, [e[i + 1] - e[i] FOR i IN range(1, n)] AS d FROM res),
cols AS (SELECT *, list_concat([e[lim + 1:n - 1]], [d[lim + 1 - j:n - 1 - j] FOR j IN range(1, lim + 1)], [d[lim + 1:n - 1]]) AS v FROM dif),
sweep AS (WITH RECURSIVE s AS (SELECT pair, lim, 0::BIGINT AS k, [[list_dot_product(a, b) FOR b IN v] FOR a IN v] AS h FROM cols
UNION ALL SELECT pair, lim, k + 1, [[h[i][j] - h[i][k + 1] * h[k + 1][j] / h[k + 1][k + 1] FOR j IN range(1, lim + 3)] FOR i IN range(1, lim + 3)] FROM s WHERE k <= lim) SELECT pair, k, h[lim + 2][lim + 2] AS ssr FROM s WHERE k >= 1),
aic AS (SELECT pair, arg_min(k, (n - 1 - lim) * ln(ssr / (n - 1 - lim)) + 2 * k) - 1 AS b FROM sweep JOIN dif USING (pair) GROUP BY pair),
again AS (SELECT dif.*, b, list_concat([d[b + 1 - j:n - 1 - j] FOR j IN range(1, b + 1)], [e[b + 1:n - 1]], [d[b + 1:n - 1]]) AS v FROM dif JOIN aic USING (pair)),
final AS (WITH RECURSIVE s AS (SELECT pair, b, 0::BIGINT AS k, [[list_dot_product(a, c) FOR c IN v] FOR a IN v] AS h FROM again
UNION ALL SELECT pair, b, k + 1, [[h[i][j] - h[i][k + 1] * h[k + 1][j] / h[k + 1][k + 1] FOR j IN range(1, b + 3)] FOR i IN range(1, b + 3)] FROM s WHERE k < b) SELECT pair, h[b + 1][b + 1] AS ll, h[b + 1][b + 2] AS ly, h[b + 2][b + 2] AS yy FROM s WHERE k = b),
stat AS (SELECT again.pair, n, beta, alpha, e, ly / ll / sqrt((yy - ly * ly / ll) / (n - 2 - 2 * b) / ll) AS t FROM final JOIN again USING (pair)),
surface AS (SELECT *, CASE WHEN t <= -2.62 THEN 2.92 + 1.5012 * t + 0.039796 * t * t ELSE 2.1945 + 0.64695 * t - 0.29198 * t * t - 0.042377 * t * t * t END::DOUBLE AS arg FROM stat),
eg AS (SELECT *, CASE WHEN t > 0.92 THEN 1.0 WHEN t < -18.86 THEN 0.0 ELSE 0.5 + arg / 600 / sqrt(2 * pi()) * list_sum([CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(arg * i / 200) * (arg * i / 200) / 2) FOR i IN range(201)]) END AS p,
list_dot_product([s + alpha FOR s IN e[1:n - 1]], [s + alpha FOR s IN e[1:n - 1]]) AS level, list_dot_product([s + alpha FOR s IN e[1:n - 1]], [s + alpha FOR s IN e[2:n]]) AS ahead FROM surface)"""


@query(f"WITH {ENGLE_GRANGER} SELECT pair, n, round(beta, 6) AS beta, round(t, 6) AS statistic, round(p, 6) + 0.0 AS p, round((ahead - level) / level, 6) AS lam FROM eg")
def engle_granger(spark, sf_dir):
    """Statistic, p-value and mean reversion of every pair with 30 common days and more."""
    out = tests_of.engle_granger(smoothed_pairs(spark, sf_dir))
    return rounded(out.where("n >= 30").select("pair", "n", "beta", "statistic", "p", "lam"))


@query(f"""WITH {ENGLE_GRANGER}, every AS (SELECT pair, count(*) AS n FROM np GROUP BY pair), l AS (SELECT *, (ahead - level) / level AS lam FROM eg),
r AS (SELECT every.pair, every.n, p, beta, lam, CASE WHEN every.n < 30 THEN 'min_obs_not_met' WHEN p >= 0.05::DOUBLE THEN 'eg_failed' WHEN beta <= 0 THEN 'beta_non_positive' END AS early FROM every LEFT JOIN l USING (pair)),
m AS (SELECT *, CASE WHEN early IS NULL AND lam < 0 AND lam > -1 THEN -ln(2) / ln(1 + lam) END AS life FROM r),
q AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN lam >= 0 THEN 'lambda_non_negative' WHEN lam <= -1 THEN 'lambda_invalid_domain' WHEN life < 5 THEN 'half_life_too_fast' WHEN life > 60 THEN 'half_life_too_slow' END AS reason FROM m)
SELECT pair, n, round(p, 6) + 0.0 AS p, CASE WHEN early IS NULL THEN round(beta, 6) END AS beta, CASE WHEN early IS NULL THEN round(lam, 6) END AS lam, round(life, 6) AS half_life, CASE WHEN reason IS NULL THEN greatest(5, round_even(life, 0)::INT) END AS z_window,
CASE WHEN reason IS NULL THEN greatest(5, round_even(2 * life, 0)::INT) END AS max_hold, reason IS NULL AS passed, reason FROM q""")
def pair_prefilter(spark, sf_dir):
    return rounded(tests_of.prefilter(smoothed_pairs(spark, sf_dir)))


#: The same for the closes themselves.
ON_CLOSES = ENGLE_GRANGER.replace(f"avg(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS close", "close")


@query(f"""WITH {ON_CLOSES}, every AS (SELECT pair, count(*) AS n FROM np GROUP BY pair) SELECT every.pair, every.n, round(t, 6) AS statistic, CASE WHEN t < -3.89644 - 10.9519 / every.n - 22.527 / (every.n * every.n) THEN 0.01 WHEN t < -3.33613 - 6.1101 / every.n - 6.823 / (every.n * every.n) THEN 0.05
WHEN t < -3.04445 - 4.2412 / every.n - 2.72 / (every.n * every.n) THEN 0.1 ELSE 1.0 END::DOUBLE AS level FROM every LEFT JOIN eg ON eg.pair = every.pair""")
def cointegration(spark, sf_dir):
    """Statistic and level of every pair's closes."""
    return rounded(tests_of.levels(tests_of.engle_granger(all_pairs(spark, sf_dir))))


def symbol_correlations(spark, sf_dir) -> DataFrame:
    """left, right, corr of every two symbols' 20-row mean closes over their common days."""
    pairs = smoothed_pairs(spark, sf_dir)
    name = F.split("pair", "-")
    return pairs.groupBy("pair").agg(F.corr("y", "x").alias("corr")).select(name[0].alias("left"), name[1].alias("right"), "corr")


#: Clusters merged one by one: lab holds each symbol's cluster number, dist the distances between symbols.
LINKAGE = f"""{BARS}, means AS (SELECT symbol, ts, avg(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS close FROM bars), no AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS no FROM (SELECT DISTINCT symbol FROM means)),
dist AS MATERIALIZED (SELECT na.no AS i, nb.no AS j, sqrt(greatest(0, 2 * (1 - corr(a.close, b.close)))) AS d FROM means a JOIN means b ON b.ts = a.ts AND a.symbol < b.symbol JOIN no na ON na.symbol = a.symbol JOIN no nb ON nb.symbol = b.symbol GROUP BY ALL),
steps AS (SELECT 0::BIGINT AS step, (SELECT list(no - 1 ORDER BY no) FROM no) AS lab, NULL::STRUCT(d DOUBLE, a BIGINT, b BIGINT, n BIGINT) AS m
UNION ALL SELECT step + 1, [CASE WHEN l IN (x.a, x.b) THEN len(lab) + step ELSE l END FOR l IN lab], x FROM (SELECT s.step, s.lab, (SELECT min(q) FROM (SELECT struct_pack(d := avg(d), a := least(s.lab[i], s.lab[j]), b := greatest(s.lab[i], s.lab[j]), n := 0::BIGINT) AS q FROM dist WHERE s.lab[i] <> s.lab[j] GROUP BY least(s.lab[i], s.lab[j]), greatest(s.lab[i], s.lab[j]))) AS x FROM steps s WHERE step < len(lab) - 1))"""


@query(f"WITH RECURSIVE {LINKAGE} SELECT step - 1 AS step, m.a AS a, m.b AS b, round(m.d, 6) AS height, len([l FOR l IN lab IF l = len(lab) + step - 1]) AS size FROM steps WHERE step > 0")
def cluster_merges(spark, sf_dir):
    """The tree of symbols by average linkage."""
    return rounded(clusters.agglomerate(clusters.correlation_distances(symbol_correlations(spark, sf_dir)))[0])


@query(f"""WITH RECURSIVE {LINKAGE}, cut AS (SELECT lab FROM steps WHERE step = 0 OR m.d <= 1.2 QUALIFY row_number() OVER (ORDER BY step DESC) = 1), l AS (SELECT symbol, lab[no] AS c FROM no, cut)
SELECT symbol, min(symbol) OVER (PARTITION BY c) AS cluster FROM l""")
def cluster_labels(spark, sf_dir):
    """Clusters of the tree below a height."""
    return clusters.agglomerate(clusters.correlation_distances(symbol_correlations(spark, sf_dir)), 1.2)[1]


def bar_days(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).select("ts", F.unix_date("ts").alias("day")).distinct()


def told(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("sum_i"), F.min("ts").alias("first_ts"))


BLOCKS = f"""{BARS}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM bars)), n AS (SELECT count(*) AS n FROM d),
cut AS (SELECT b, b * (n // 7) + least(b, n % 7) AS lo, (b + 1) * (n // 7) + least(b + 1, n % 7) AS hi FROM n, range(7) t(b))"""
TOLD = "SELECT CAST(fold AS INT) AS fold, part, count(*) AS n, CAST(sum(i) AS BIGINT) AS sum_i, min(ts) AS first_ts FROM p GROUP BY ALL"
#: Blocks of every choice of two.
CHOSEN = f"""{BLOCKS}, f AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS fold, x, y FROM range(7) r(x), range(7) s(y) WHERE x < y),
c AS (SELECT fold, lo, hi, b IN (x, y) AS test, 3 + ceil(0.1::DOUBLE * (hi - lo)) AS gap, b - 1 IN (x, y) AS lt, b + 1 IN (x, y) AS rt FROM f, cut)"""
TRAINS = "i >= lo + CASE WHEN lt THEN gap ELSE 0 END AND i < hi - CASE WHEN rt THEN gap ELSE 0 END"


@query(f"WITH {CHOSEN}, p AS (SELECT fold, i, ts, CASE WHEN test THEN 'test' WHEN {TRAINS} THEN 'train' ELSE 'dropped' END AS part FROM c JOIN d ON i >= lo AND i < hi) {TOLD}")
def purged_folds(spark, sf_dir):
    """Combinatorial folds of the panel's days: whole test blocks, purged and embargoed training."""
    return told(folds.fold_rows(bar_days(spark, sf_dir), "day", 7, folds.combinations(7, 2), 3, 0.1, trim=False))


@query(f"WITH {CHOSEN}, p AS (SELECT fold, i, ts, CASE WHEN test AND i >= lo + 3 AND i < hi - gap THEN 'test' WHEN NOT test AND {TRAINS} THEN 'train' ELSE 'dropped' END AS part FROM c JOIN d ON i >= lo AND i < hi) {TOLD}")
def validation_folds(spark, sf_dir):
    """As purged_folds, each test block trimmed at both ends."""
    return told(folds.fold_rows(bar_days(spark, sf_dir), "day", 7, folds.combinations(7, 2), 3, 0.1))


@query(f"""WITH {BLOCKS}, c AS (SELECT f AS fold, cut.lo, cut.hi, x.lo AS l, y.hi AS h, cut.b BETWEEN f AND f + 1 AS test, 3 + ceil(0.1::DOUBLE * (cut.hi - cut.lo)) AS gap, cut.b - 1 = f + 1 AS lt, cut.b + 1 = f AS rt FROM range(6) t(f) JOIN cut x ON x.b = f JOIN cut y ON y.b = f + 1 JOIN cut ON true),
p AS (SELECT fold, i, ts, CASE WHEN test AND i >= l + 3 AND i < h - 3 - ceil(0.1::DOUBLE * (h - l)) THEN 'test' WHEN NOT test AND {TRAINS} THEN 'train' ELSE 'dropped' END AS part FROM c JOIN d ON i >= lo AND i < hi) {TOLD}""")
def blocked_folds(spark, sf_dir):
    """Two neighbouring blocks of days test, trimmed as one stretch."""
    return told(folds.fold_rows(bar_days(spark, sf_dir), "day", 7, folds.runs(7, 2), 3, 0.1, together=True))


SPAN = strategy.Span(dt.date(1995, 1, 1), dt.date(1998, 1, 15), dt.date(1998, 1, 1), dt.date(1998, 12, 31), dt.date(1999, 3, 31))
#: Common days of every two symbols' 20-row means, from the queries above.
COMMON = ENGLE_GRANGER[: ENGLE_GRANGER.index(",\nfit AS")]


@query(f"""WITH {COMMON}, f AS (SELECT pair, regr_slope(y, x) AS beta FROM np WHERE ts BETWEEN DATE '1995-01-01' AND DATE '1998-01-15' GROUP BY pair HAVING count(*) >= 15 AND stddev_pop(y) > 0 AND stddev_pop(x) > 0 AND regr_slope(y, x) > 0),
ev AS (SELECT pair, min(ts) AS first FROM np WHERE ts BETWEEN DATE '1998-01-01' AND DATE '1999-03-31' GROUP BY pair),
al AS (SELECT np.pair, ts, beta, y - beta * x AS s FROM np JOIN f USING (pair) JOIN ev USING (pair) WHERE (ts >= DATE '1995-01-01' AND ts <= DATE '1998-01-15' AND ts < first) OR ts BETWEEN DATE '1998-01-01' AND DATE '1999-03-31'),
zs AS (SELECT pair, ts, beta, CASE WHEN count(s) OVER p >= 15 AND stddev_pop(s) OVER p > 0 THEN (s - avg(s) OVER p) / stddev_pop(s) OVER p END AS z FROM al WINDOW p AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
w AS (SELECT *, lag(z) OVER (PARTITION BY pair ORDER BY ts) AS q FROM zs WHERE ts BETWEEN DATE '1998-01-01' AND DATE '1998-12-31')
SELECT pair, ts, CASE WHEN z < 0 THEN 1 ELSE -1 END AS side, round(z, 6) AS z, round(beta, 6) AS beta, DATE '1998-12-31' AS entry_end FROM w WHERE (z <= -2 AND z > -4 AND (q IS NULL OR q > -2)) OR (z >= 2 AND z < 4 AND (q IS NULL OR q < 2))""")
def baseline_intents(spark, sf_dir):
    """Entries of every pair with a positive hedge ratio in a test year, after three years of training."""
    return rounded(strategy.baseline(smoothed_pairs(spark, sf_dir), SPAN, window=30))


@query()
def sampled_fills(spark, sf_dir):
    """Fill fractions drawn for every trade, by its id; tested against the distribution's closed form."""
    share = F.col("qty") / 100
    orders = trades(spark, sf_dir).select("trade_id", share.alias("depth_share"), (share / 100).alias("participation"), (F.col("maker_share") / 10).alias("sigma"), (F.col("exec_px") * 10_000).alias("adv"))
    return rounded(sampling.sampled_fills(orders, "trade_id", 7, 1e7).select("trade_id", "expected", "kappa", "sampled"))
