"""Significance of Sharpe ratios: deflation for trials, overfitting of trials, bootstrap intervals. Distribution functions are column expressions (Simpson's rule), so nothing leaves the engine."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.folds import numbered

#: Intervals of Simpson's rule; the error is under 1e-9 on the ranges used.
_STEPS = 400
_EULER = 0.5772156649015329


def _simpson(density, upper: Column, steps: int = _STEPS) -> Column:
    """Integral of a density from 0 to upper (of either sign)."""
    h = upper / steps
    weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    return h / 3 * F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + weight(i) * density(h * i))


def normal_cdf(z: Column) -> Column:
    inside = F.greatest(F.lit(-9.0), F.least(F.lit(9.0), z))
    return F.lit(0.5) + _simpson(lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi), inside)


def student_cdf(t: Column, df: Column) -> Column:
    """Student's t distribution; the gamma ratio of its density by its asymptotic series, exact to 1e-7 from ten degrees of freedom on."""
    ratio = F.sqrt(df / 2) * (1 - 1 / (4 * df) + 1 / (32 * df * df) + 5 / (128 * df * df * df))
    inside = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), t))
    return F.lit(0.5) + _simpson(lambda x: ratio / F.sqrt(math.pi * df) * F.pow(1 + x * x / df, -(df + 1) / 2), inside, 4 * _STEPS)


def expected_best(trials: int) -> float:
    """Expected largest of so many standard normal values (extreme value approximation)."""
    if trials <= 1:
        return 0.0
    z = NormalDist().inv_cdf
    return (1 - _EULER) * z(1 - 1 / trials) + _EULER * z(1 - 1 / (trials * math.e))


def sharpe_moments(equity: DataFrame, order: str, value: str = "equity", periods: int = 252) -> DataFrame:
    """One row: n, sr (annual), skew, kurt (normal: 3) of the returns of an equity curve. Days are numbered by ranges and met with the day before by an equi-join, so no task holds the curve."""
    at = numbered(equity.where(F.col(value).isNotNull()).select(F.col(order).alias("_o"), F.col(value).alias("_v")), "_o")
    before = at.select((F.col("i") + 1).alias("i"), F.col("_v").alias("_b"))
    r = at.join(before, "i").select((F.col("_v") / F.col("_b") - 1).alias("r"))
    sd = F.stddev_samp("r")
    out = r.agg(F.count("r").alias("n"), F.when(sd > 0, F.avg("r") / sd * math.sqrt(periods)).otherwise(0.0).alias("sr"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))
    usable = (F.col("n") >= 3) & ~F.isnan("skew")
    return out.select("n", "sr", F.when(usable, F.col("skew")).otherwise(0.0).alias("skew"), F.when(usable, F.col("kurt")).otherwise(3.0).alias("kurt"))


def significance(moments: DataFrame, trials: Column | int) -> DataFrame:
    """Adds psr (probability that the true Sharpe ratio is above 0), dsr (above the best of so many trials without skill) and p_one_sided (Memmel). trials: a number, or a column of the
    one-row frame's expected best (see expected_best)."""
    sr, n = F.col("sr"), F.col("n")
    spread = F.greatest(F.lit(1e-12), 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr)
    sigma = F.sqrt(spread / F.greatest(F.lit(1), n - 1))
    best = F.lit(expected_best(trials)) if isinstance(trials, int) else trials
    t = F.when(n > 1, sr * F.sqrt(n) / F.sqrt(spread)).otherwise(0.0)
    known = lambda v: F.when(n > 1, v).otherwise(0.0)
    return moments.withColumns({"sr_max": best * sigma, "psr": known(normal_cdf(sr / sigma)), "dsr": known(normal_cdf(sr / sigma - best)), "p_one_sided": 1 - student_cdf(t, F.greatest(F.lit(1), n - 1))})


def overfit_share(trials: DataFrame) -> DataFrame:
    """One row: n_folds, pbo. trials: fold, model, is_score, oos_score. Several scores of a fold and model are averaged, rows without one of the four are left out; a model that a fold lacks is its worst.

    Per fold the best model in sample is ranked out of sample, 1 for the best of all models; pbo is the share of folds where (rank - 0.5) / models is under a half: the published logit with ranks from the best on.
    """
    each = trials.dropna(subset=["fold", "model", "is_score", "oos_score"]).groupBy("fold", "model").agg(F.avg("is_score").alias("a"), F.avg("oos_score").alias("b"))
    models = each.agg(F.count_distinct("model").alias("_m"))  # one row
    fold = Window.partitionBy("fold")
    rank = F.row_number().over(fold.orderBy(F.desc("b"), F.desc("model")))
    best = F.row_number().over(fold.orderBy(F.desc("a"), "model"))
    at = each.select(rank.alias("r"), best.alias("k")).where("k = 1").join(F.broadcast(models))
    share = F.avg(((F.col("r") - 0.5) / F.col("_m") < 0.5).cast("double"))
    return at.agg(F.count(F.lit(1)).alias("n_folds"), F.when(F.max("_m") > 1, share).otherwise(0.0).alias("pbo"))


def trial_summary(trials: DataFrame, equity: DataFrame, order: str, how: str = "median", component: str | None = None) -> DataFrame:
    """One row on a search: component, n_candidates, n_test_obs, sr_hat, skew, kurtosis, psr, dsr, p_one_sided, n_folds, pbo.

    trials: component, model, score, fold, is_score, oos_score. Of several components the named one is used, or the one with the most rows (ties: the first by name). A candidate is a model with a score, by `how`
    (median, mean or max) over its rows; their number deflates the Sharpe ratio of the equity curve.
    """
    counts = trials.where("component IS NOT NULL").groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    one = trials.sparkSession.createDataFrame([(component,)], "component string") if component else counts
    used = trials.join(F.broadcast(one), "component", "left_semi") if component or not counts.isEmpty() else trials
    value = {"median": F.percentile("score", F.lit(0.5)), "mean": F.avg("score"), "max": F.max("score")}[how]
    models = used.where("score IS NOT NULL").groupBy("model").agg(value.alias("score")).agg(F.count(F.lit(1)).alias("n_candidates"))
    n = models.first()[0]  # one number
    row = significance(sharpe_moments(equity, order), max(1, n))
    out = row.join(F.broadcast(overfit_share(used))).withColumn("n_candidates", F.lit(n).cast("long")).join(F.broadcast(one), how="left")
    return out.select("component", "n_candidates", F.col("n").alias("n_test_obs"), F.col("sr").alias("sr_hat"), "skew", F.col("kurt").alias("kurtosis"), "psr", "dsr", "p_one_sided", "n_folds", "pbo")


def draw(seed: int, *keys: Column) -> Column:
    """A whole number below 2^32 that depends on the seed and the keys only: the first digits of their MD5. The same in every partitioning, and in SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


def bootstrap_sharpe(pnl: DataFrame, order: str, capital: float, replicates: int = 2000, alpha: float = 0.05, seed: int = 7, value: str = "pnl", periods: int = 252) -> DataFrame:
    """One row: mean, lower and upper (alpha / 2 quantiles) of the Sharpe ratio over resamples of the returns, null where the returns do not vary.

    Every replicate draws as many rows as there are, with replacement: draw (replicate, k) is a row number, replicates are aggregations over an equi-join on it. Returns are on the equity before (capital and earlier pnl); the
    first is 0. Draws are 32-bit numbers modulo the number of rows.
    """
    from tidepanel.operators.reports import prefix_sums

    days = pnl.groupBy(order).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_p")).withColumn("_one", F.lit(1.0))
    at = prefix_sums(days, order, ["_p", "_one"])
    equity = F.lit(capital) + F.col("cum__p")
    r = at.select((F.col("cum__one") - 1).cast("long").alias("i"), F.when(F.col("cum__one") == 1, 0.0).otherwise(F.col("_p") / (equity - F.col("_p"))).alias("r"))
    size = r.agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("r").alias("_sd"))  # one row
    each = r.join(F.broadcast(size)).where((F.col("_n") > 1) & (F.col("_sd") > 0))
    drawn = each.select("_n", F.col("i").alias("k")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select("b", (draw(seed, F.col("b"), F.col("k")) % F.col("_n")).alias("i"))
    sd = F.stddev_samp("r")
    ratios = drawn.join(r, "i").groupBy("b").agg(F.when(sd > 0, F.avg("r") / sd * math.sqrt(periods)).otherwise(0.0).alias("s"))
    return ratios.agg(F.avg("s").alias("mean"), F.percentile("s", F.lit(alpha / 2)).alias("lower"), F.percentile("s", F.lit(1 - alpha / 2)).alias("upper"))
