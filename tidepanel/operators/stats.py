"""Statistics of panels and pairs: correlations, shrinkage, bootstrap, false discovery, cointegration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.rolling import by_time, log_return
from tidepanel.operators.reports import prefix_sums


def returns(bars: DataFrame, min_positive: float = 0.99, max_missing: float = 0.5) -> DataFrame:
    """symbol, ts, ret (log) of symbols with enough positive prices and present returns."""
    ret = bars.withColumn("ret", log_return(F.col("close")))
    fit = ret.groupBy("symbol").agg(F.avg((F.col("close") > 0).cast("double")).alias("p"), F.avg(F.col("ret").isNull().cast("double")).alias("m")).where((F.col("p") >= min_positive) & (F.col("m") <= max_missing))
    return ret.join(fit, "symbol", "left_semi").select("symbol", "ts", "ret").where("ret is not null")


def pair_correlations(rets: DataFrame, min_days: int = 20) -> DataFrame:
    """left, right, n, corr of every pair of symbols over their common days.

    Rows of a day are gathered once and exploded to pairs in place: one shuffle by day, one by pair, both with partial aggregation behind.
    """
    day = rets.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("symbol", "ret"))).alias("m"))  # a day's symbols
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice(F.col("m"), i + 2, F.size("m")), lambda b: F.struct(a["symbol"].alias("left"), b["symbol"].alias("right"), a["ret"].alias("x"), b["ret"].alias("y")))))
    return day.select(F.inline(pairs)).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("corr")).where(F.col("n") >= min_days)


def every_day(rets: DataFrame) -> DataFrame:
    """symbol, ts, ret on every day of the panel from each symbol's first return on: a day without a bar carries the price forward, so its return is 0. Each symbol's own stretch of the panel's days (one list of days) is exploded."""
    days = rets.agg(F.array_sort(F.collect_set("ts")).alias("_days"))  # one row: the panel's days
    first = rets.groupBy("symbol").agg(F.min("ts").alias("_first"))
    grid = first.join(F.broadcast(days)).select("symbol", F.explode(F.filter("_days", lambda d: d >= F.col("_first"))).alias("ts"))
    return grid.join(rets, ["symbol", "ts"], "left").select("symbol", "ts", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def day_pairs(bars: DataFrame) -> DataFrame:
    """a, b, ts, y, x: closes of every two symbols (a < b) on their common days, exploded from a day's gathered rows."""
    day = bars.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("symbol", "close"))).alias("m"))  # a day's symbols
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice(F.col("m"), i + 2, F.size("m")), lambda b: F.struct(a["symbol"].alias("a"), b["symbol"].alias("b"), a["close"].alias("y"), b["close"].alias("x")))))
    return day.select("ts", F.inline(pairs)).select("a", "b", "ts", "y", "x")


def hopping(rows: DataFrame, window: int, step: int, key: str = "symbol") -> DataFrame:
    """Row-count windows [s, s + window) every `step` rows: one row per input row and window id; only whole windows."""
    at = rows.withColumns({"_i": F.row_number().over(by_time(key)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - window + 1) / step).cast("int"))
    last = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - window) / step)).cast("int")
    return at.where(F.col("_n") >= window).withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))).drop("_i", "_n")


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Covariance shrunk towards mu times the identity (Ledoit and Wolf, 2004)."""
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    if p == 1:
        return s
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, ((x**2).T @ (x**2) / n - s**2).sum() / (n * p))
    shrink = 0.0 if beta == 0 else beta / delta
    return (1 - shrink) * s + shrink * mu * np.eye(p)


def pair_persistence(corrs: DataFrame, low: float, high: float) -> DataFrame:
    """Per pair: windows, mean correlation, shares at or above two thresholds."""
    return corrs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"), F.avg("corr").alias("mean_corr"), F.avg((F.col("corr") >= low).cast("double")).alias("pct1"), F.avg((F.col("corr") >= high).cast("double")).alias("pct2"))


def harmonic_number(n: F.Column) -> F.Column:
    """1 + 1/2 + ... + 1/n: summed up to 32, by its asymptotic series (exact to 4e-12) beyond."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(32)).cast("int")), F.lit(0.0), lambda acc, k: acc + 1 / k)
    return F.when(n <= 32, few).otherwise(F.ln(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * n * n * n * n))


def false_discovery(tests: DataFrame, p: str, alpha: float, dependent: bool = False) -> DataFrame:
    """Adds rejected by Benjamini-Hochberg, or Benjamini-Yekutieli if dependent: all p up to the largest one that is at most its rank's share of alpha.

    A p's rank is the number of tests up to it, from counts by p and prefix sums over ranges of p, so no task ranks all tests. Missing p are not tests.
    """
    counts = tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).cast("double").alias("_k"))
    ranked = prefix_sums(counts, p, ["_k"])
    total = counts.agg(F.sum("_k").alias("_n"))
    level = F.lit(alpha) / harmonic_number(F.col("_n")) if dependent else F.lit(alpha)
    cut = ranked.join(F.broadcast(total)).where(F.col(p) <= F.col("cum__k") / F.col("_n") * level).agg(F.max(p).alias("_cut"))  # one row each
    return tests.join(F.broadcast(cut)).withColumn("rejected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def half_life(pairs: DataFrame) -> DataFrame:
    """pair, beta, lam, half_life of pairs (pair, ts, y, x): least squares spread, then its AR(1) on the level."""
    fit = pairs.groupBy("pair").agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("a"))
    spread = pairs.join(fit, "pair").withColumn("s", F.col("y") - F.col("a") - F.col("beta") * F.col("x"))
    lagged = spread.withColumn("l", F.lag("s").over(by_time("pair")))
    out = lagged.groupBy("pair").agg(F.first("beta").alias("beta"), F.try_divide(F.sum(F.col("l") * (F.col("s") - F.col("l"))), F.sum(F.col("l") * F.col("l"))).alias("lam"))
    return out.withColumn("half_life", F.when((F.col("lam") > -1) & (F.col("lam") < 0), -F.lit(float(np.log(2))) / F.log1p("lam")))


def high_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """left, right, corr of pairs at the threshold or above, names in order, highest first (then by name). Sorted by ranges."""
    out = pairs.where(F.col("corr") >= threshold).select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "corr")
    return out.orderBy(F.desc("corr"), "left", "right")


def candidate_pairs(summary: DataFrame, most: int, by: str = "pct2") -> DataFrame:
    """The first `most` pairs by a share, highest first: a top-k report, the limit is the feature."""
    return summary.orderBy(F.desc(by), "left", "right").limit(most)


def select_pairs(tested: DataFrame, share1: float, share2: float) -> DataFrame:
    """Accepted pairs whose shares of windows over the two thresholds reach their cuts: mean_corr to 4 places, shares to 2, p to 6, highest rounded mean first.
    tested: left, right, mean_corr, pct1, pct2, p, rejected."""
    kept = tested.where(F.col("rejected") & (F.col("pct1") >= share1) & (F.col("pct2") >= share2))
    out = kept.select(F.concat_ws("-", "left", "right").alias("pair"), F.round("mean_corr", 4).alias("mean_corr"), F.round("pct1", 2).alias("pct1"), F.round("pct2", 2).alias("pct2"), F.round("p", 6).alias("p"))
    return out.orderBy(F.desc("mean_corr"), "pair")


def nearest_positive(matrix: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """The nearest symmetric matrix whose eigenvalues are at the floor or above."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    raised = vectors @ np.diag(np.maximum(values, floor)) @ vectors.T
    return (raised + raised.T) / 2
