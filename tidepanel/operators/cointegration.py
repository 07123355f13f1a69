"""Engle-Granger test and half-life of pairs from sums: residuals' lagged products are added up by Spark, and each pair's row of sums is solved once.

The augmented Dickey-Fuller regressions of a pair need inner products of its residuals at lags 0 .. L + 1 over several stretches of rows. All follow from the products summed over the whole
pair, C[k] = sum of e[t] * e[t - k], less those at the two ends; so a pair is C and L + 1 values from each end. No task holds a pair's rows, and only rows of sums reach Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.rolling import by_time

#: MacKinnon (1994, 2010), response surface of the p-value for two series with a constant: bounds, and coefficients for t up to and above `star`.
TAU_MIN, TAU_STAR, TAU_MAX = -18.86, -2.62, 0.92
TAU_SMALL = (2.92, 1.5012, 0.039796)
TAU_LARGE = (2.1945, 0.64695, -0.29198, -0.042377)
#: MacKinnon (2010), critical values for cointegration of two series with constant, at 1, 5 and 10 %.
CRITICAL = {0.01: (-3.89644, -10.9519, -22.527), 0.05: (-3.33613, -6.1101, -6.823), 0.10: (-3.04445, -4.2412, -2.720)}
#: Why a pair does not pass, in the order of the tests.
REASONS = ("min_obs_not_met", "eg_failed", "beta_estimation_failed", "beta_non_positive", "half_life_non_finite", "lambda_non_negative", "lambda_invalid_domain", "half_life_too_fast", "half_life_too_slow")


def pair_rows(bars: DataFrame, pairs: DataFrame, value: str = "close") -> DataFrame:
    """pair, ts, y, x: values of the two symbols of each asked pair (left, right) on the days that both have. Two joins on symbols; no other pair is formed."""
    side = lambda name, to: bars.select(F.col("symbol").alias(name), "ts", F.col(value).alias(to)).where(F.col(to).isNotNull())
    y = pairs.select("left", "right").distinct().join(side("left", "y"), "left")
    return y.join(side("right", "x"), ["right", "ts"]).select(F.concat_ws("-", "left", "right").alias("pair"), "ts", "y", "x")


def lag_limit(n: int) -> int:
    """Most lags tried for n rows (Schwert's rule)."""
    return max(0, min(n // 2 - 1, math.ceil(12 * (n / 100) ** 0.25)))


def p_value(t: float) -> float:
    if t > TAU_MAX:
        return 1.0
    if t < TAU_MIN:
        return 0.0
    at = sum(c * t**i for i, c in enumerate(TAU_SMALL if t <= TAU_STAR else TAU_LARGE))
    return 0.5 * math.erfc(-at / math.sqrt(2))


def residual_sums(pairs: DataFrame, max_lag: int | None = None) -> DataFrame:
    """pair, n, beta, alpha, r2, c (C[0], C[1], ...), head, tail, total of the residuals' rows. pairs: pair, ts, y, x. The most lags any pair may try decides how
    many columns are summed: of max_lag, or one count of the rows before."""
    present = pairs.where(F.col("y").isNotNull() & F.col("x").isNotNull())
    if max_lag is None:
        longest = present.groupBy("pair").count().agg(F.max("count")).first()[0] or 0
        max_lag = lag_limit(longest)
    fit = present.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2"))
    w = by_time("pair")
    e = present.join(fit, "pair").select("pair", "ts", "n", "beta", "alpha", "r2", (F.col("y") - F.col("alpha") - F.col("beta") * F.col("x")).alias("e"))
    at = e.select("*", F.row_number().over(w).alias("pos"), *[F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, max_lag + 2)])
    ends = max_lag + 2
    value = lambda keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("pos", "e")))), lambda s: s["e"])
    sums = [F.sum(F.col("e") * (F.col(f"e{k}") if k else F.col("e"))) for k in range(max_lag + 2)]
    return at.groupBy("pair", "n", "beta", "alpha", "r2").agg(
        F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums]).alias("c"), value(F.col("pos") <= ends).alias("head"), value(F.col("pos") > F.col("n") - ends).alias("tail"), F.sum("e").alias("total")
    )


def products(c: np.ndarray, head: np.ndarray, tail: np.ndarray, n: int, m: int) -> np.ndarray:
    """G[i, j] = sum of e[t - i] * e[t - j] over t = m .. n - 1, for i, j = 0 .. m."""
    last = lambda s: tail[len(tail) - (n - s)]  # noqa: E731  e[s] near the end
    g = np.empty((m + 1, m + 1))
    for k in range(m + 1):
        total = c[k]
        # of e[s] * e[s - k], s runs over m - i .. n - 1 - i: i = 0 drops s < m
        front = np.cumsum([0.0] + [head[s] * head[s - k] for s in range(k, m)])
        back = np.cumsum([0.0] + [last(n - 1 - i) * last(n - 1 - i - k) for i in range(m - k)])
        for i in range(m + 1 - k):
            g[i, i + k] = g[i + k, i] = total - front[m - i - k] - back[i]
    return g


def _regression(g: np.ndarray) -> np.ndarray:
    """Inner products of level, lagged differences and difference from those of the residuals."""
    m = len(g) - 1
    to = np.zeros((m + 1, m + 1))
    to[0, 1] = 1.0
    for j in range(1, m):
        to[j, j], to[j, j + 1] = 1.0, -1.0
    to[m, 0], to[m, 1] = 1.0, -1.0
    return to @ g @ to.T


def adf(c: np.ndarray, head: np.ndarray, tail: np.ndarray, n: int, limit: int) -> float:
    """t statistic of the level in the regression without constant, with as many lagged differences (up to limit) as give the least information criterion."""
    h = _regression(products(c, head, tail, n, limit + 1))
    rows, best = n - 1 - limit, (math.inf, 0)
    for k in range(1, limit + 2):
        rest = h[-1, -1] - h[-1, :k] @ np.linalg.lstsq(h[:k, :k], h[:k, -1], rcond=None)[0]
        best = min(best, (rows * math.log(max(rest, 1e-300) / rows) + 2 * k, k))
    k = best[1]
    h = _regression(products(c, head, tail, n, k))
    inverse = np.linalg.pinv(h[:k, :k])
    coef = inverse @ h[:k, -1]
    noise = max(h[-1, -1] - h[-1, :k] @ coef, 0.0) / max(1, n - 2 * k)
    return float(coef[0] / math.sqrt(noise * inverse[0, 0])) if noise * inverse[0, 0] > 0 else float("nan")


def engle_granger(pairs: DataFrame, max_lag: int | None = None) -> DataFrame:
    """pair, n, beta, alpha, statistic, p, lam of pairs (pair, ts, y, x). lam is the slope of the spread's differences y - beta x on its level, without constant.
    Pairs whose x explains y wholly have statistic -infinity and p 0; p is null where there are too few rows for a lag."""
    sums = residual_sums(pairs, max_lag)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for r in rows.itertuples(index=False):
                n, limit = int(r.n), min(lag_limit(int(r.n)), len(r.c) - 2)
                stat = p = lam = None
                beta = None if r.beta is None or r.beta != r.beta else float(r.beta)
                if beta is not None and n >= 4:
                    if r.r2 >= 1 - 100 * math.sqrt(np.finfo(float).eps):
                        stat = -math.inf
                    else:
                        stat = adf(r.c, r.head, r.tail, n, limit)
                    p = p_value(stat) if stat == stat else None
                    a, first, end = float(r.alpha), r.head[0], r.tail[-1]
                    # s = e + alpha: sums over s[t - 1] * (s[t] - s[t - 1]) and s[t - 1]^2
                    level = r.c[0] - end * end + 2 * a * (r.total - end) + (n - 1) * a * a
                    ahead = r.c[1] + a * (2 * r.total - first - end) + (n - 1) * a * a
                    lam = (ahead - level) / level if level > 0 else None
                found.append((r.pair, n, beta, None if beta is None else float(r.alpha), stat, p, lam))
            yield pd.DataFrame(found, columns=["pair", "n", "beta", "alpha", "statistic", "p", "lam"])

    return sums.mapInPandas(solve, "pair string, n long, beta double, alpha double, statistic double, p double, lam double")


def prefilter(pairs: DataFrame, alpha: float = 0.05, min_obs: int = 30, half_lives: tuple[float, float] | None = (5.0, 60.0), hold_multiple: float = 2.0, least_days: int = 5, max_lag: int | None = None) -> DataFrame:
    """pair, n, p, beta, lam, half_life, z_window, max_hold, passed, reason (one of REASONS, or null): tests in their order, what a failed test would have led to is null.
    half_lives: bounds in days; None: only the test of Engle and Granger and the hedge ratio."""
    t = engle_granger(pairs, max_lag)
    n, p, beta, lam = (F.col(c) for c in ("n", "p", "beta", "lam"))
    base = F.when(n < max(2, min_obs), "min_obs_not_met").when(p.isNull() | (p >= alpha), "eg_failed").when(beta.isNull(), "beta_estimation_failed").when(beta <= 0, "beta_non_positive")
    t = t.withColumn("early", base)
    life = -math.log(2.0) / F.log1p(lam)
    if half_lives is None:
        t = t.withColumns({"reason": F.col("early"), "half_life": F.lit(None).cast("double"), "lam": F.lit(None).cast("double")})
    else:
        low, high = half_lives
        moves = F.when(lam.isNull(), "half_life_non_finite").when(lam >= 0, "lambda_non_negative").when(lam <= -1, "lambda_invalid_domain")
        pace = F.when(life < low, "half_life_too_fast").when(life > high, "half_life_too_slow")
        t = t.withColumn("lam", F.when(F.col("early").isNull(), lam)).withColumn("moves", F.when(F.col("early").isNull(), moves))
        t = t.withColumn("half_life", F.when(F.col("early").isNull() & F.col("moves").isNull(), life))
        t = t.withColumn("reason", F.coalesce("early", "moves", F.when(F.col("early").isNull() & F.col("moves").isNull(), pace)))
    passed = F.col("reason").isNull()
    days = lambda v: F.when(passed & F.col("half_life").isNotNull(), F.greatest(F.lit(least_days), F.bround(v).cast("int")))
    seen = F.when(n >= max(2, min_obs), p)
    hedge = F.when(passed | ~F.col("reason").isin("min_obs_not_met", "eg_failed", "beta_estimation_failed", "beta_non_positive"), beta)
    return t.select("pair", "n", seen.alias("p"), hedge.alias("beta"), "lam", "half_life", days(F.col("half_life")).alias("z_window"), days(hold_multiple * F.col("half_life")).alias("max_hold"), passed.alias("passed"), "reason")


def levels(tests: DataFrame, min_obs: int = 30) -> DataFrame:
    """pair, n, statistic, level (0.01, 0.05, 0.1, or 1: none) of tested pairs, by the critical values for so many rows; pairs of under min_obs rows have no statistic."""
    n, stat = F.col("n"), F.when(F.col("n") >= min_obs, F.col("statistic"))
    level = F.lit(1.0)
    for size, (b0, b1, b2) in reversed(CRITICAL.items()):
        level = F.when(stat < b0 + b1 / n + b2 / (n * n), size).otherwise(level)
    return tests.select("pair", "n", stat.alias("statistic"), level.alias("level"))
