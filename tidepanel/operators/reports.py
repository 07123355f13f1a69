"""Reports over trades, days and trials."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explain(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Gross, cost and net sums, trades, win rate, mean and deviation per group; null groups stay."""
    net = F.col("net_pnl")
    return trades.groupBy(*by).agg(
        F.sum("gross_pnl").alias("gross"), F.sum("fees").alias("fees"), F.sum(net).alias("net"), F.count(F.lit(1)).alias("n"),
        F.avg((net > 0).cast("double")).alias("win_rate"), F.avg(net).alias("mean_net"), F.stddev_samp(net).alias("std_net"),
    )


def top_and_rest(groups: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n groups with the largest |value|, and the others as __REST__."""
    ranked = groups.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(F.abs(value)), key)))  # one row per group
    name = F.when(F.col("_r") <= n, F.col(key)).otherwise(F.lit("__REST__"))
    return ranked.groupBy(name.alias(key)).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("groups"))


def quantiles(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, n, mean, p50, p90, p95 over present values."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])))
    return long.where("v is not null").groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), *[F.percentile("v", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95)])


def concentration(groups: DataFrame, value: str, top: int = 5) -> DataFrame:
    """n, top_share (of |value|), gini of |value|."""
    w = Window.orderBy(F.abs(value))  # one row per group
    at = groups.select(F.abs(value).alias("v"), F.row_number().over(Window.orderBy(F.desc(F.abs(value)))).alias("r"), F.sum(F.abs(value)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    n, total = F.count(F.lit(1)), F.sum("v")
    return at.agg(n.alias("n"), F.try_divide(F.sum(F.when(F.col("r") <= top, F.col("v"))), total).alias("top_share"), ((n + 1) / n - 2 * F.try_divide(F.sum("cum"), n * total)).alias("g0")).select("n", "top_share", (F.col("g0")).alias("gini"))


def performance(days: DataFrame, capital: float, periods: int = 252) -> DataFrame:
    """n, total_return, mean, vol, sharpe, sortino, hit_rate, max_drawdown of equity rows (day, pnl, equity, drawdown)."""
    ret = days.withColumn("r", F.col("pnl") / (F.col("equity") - F.col("pnl")))
    root = math.sqrt(periods)
    down = F.sqrt(F.avg(F.pow(F.least(F.col("r"), F.lit(0.0)), 2)))
    return ret.agg(
        F.count(F.lit(1)).alias("n"), (F.sum("pnl") / capital).alias("total_return"), F.avg("r").alias("mean"), (F.stddev_samp("r") * root).alias("vol"),
        (F.try_divide(F.avg("r"), F.stddev_samp("r")) * root).alias("sharpe"), (F.try_divide(F.avg("r"), down) * root).alias("sortino"),
        F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.min("drawdown").alias("max_drawdown"),
    )


def monthly(days: DataFrame) -> DataFrame:
    """year, month, ret: compounded daily returns. A month with a day that loses more than the whole equity has no compounded return (NaN), as the logarithm of its growth has none; one that loses
    exactly the whole gives -1, and a day that starts from zero follows floating-point division."""
    before = F.col("equity") - F.col("pnl")
    r = F.when(before == 0, F.col("pnl") * F.lit(math.inf)).otherwise(F.try_divide(F.col("pnl"), before))
    growth = F.col("_g")
    log = F.when(growth < 0, F.lit(math.nan)).when(growth == 0, F.lit(-math.inf)).otherwise(F.ln(growth))
    return days.withColumn("_g", 1 + r).groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg((F.exp(F.sum(log)) - 1).alias("ret"))


def prefix_sums(rows: DataFrame, order: str, values: Sequence[str], descending: bool = False, buckets: int = 64) -> DataFrame:
    """Adds cum_<value>: sums over rows up to and with this one by order. Rows are dealt to ranges of the order (by approximate quantiles), summed in each,
    and every range starts from the total of those before it, so no task holds all rows."""
    edges = rows.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000).alias("_e"))  # one row
    below = F.size(F.filter(F.coalesce("_e", F.array().cast("array<double>")), lambda e: e < F.col(order)))
    dealt = rows.join(F.broadcast(edges)).withColumn("_b", -below if descending else below).drop("_e")
    totals = dealt.groupBy("_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("_b", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0.0)).alias(f"_o_{v}") for v in values])
    w = Window.partitionBy("_b").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "_b")
    return out.withColumns({f"cum_{v}": F.col(f"_o_{v}") + F.sum(v).over(w) for v in values}).drop("_b", *[f"_o_{v}" for v in values])


def roc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """auc, n_pos, n_neg; ties share a step. Scores are counted first, so the running sums are over distinct scores."""
    by = rows.groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("q"))
    run = prefix_sums(by, score, ["p"], descending=True)
    area = F.col("q") * (F.col("cum_p") - F.col("p") / 2)
    return run.agg(F.try_divide(F.sum(area), F.sum("p") * F.sum("q")).alias("auc"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))


def ks(rows: DataFrame, value: str, label: str) -> DataFrame:
    """Largest distance of the two labels' distributions; equal values step together."""
    by = rows.groupBy(value).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("q"))
    total = by.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    run = prefix_sums(by, value, ["p", "q"]).join(F.broadcast(total))
    return run.agg(F.max(F.abs(F.try_divide("cum_p", "tp") - F.try_divide("cum_q", "tq"))).alias("ks"))


def overfit_probability(scores: DataFrame) -> DataFrame:
    """Share of folds whose best model in sample ranks in the lower half out of sample (Bailey et al.). scores: fold, model, is_score, oos_score."""
    n = F.count(F.lit(1)).over(Window.partitionBy("fold"))
    best = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("is_score"), "model"))
    rank = F.row_number().over(Window.partitionBy("fold").orderBy("oos_score", "model"))
    at = scores.select("fold", best.alias("b"), (rank / (n + 1)).alias("w")).where("b = 1")
    return at.agg(F.count(F.lit(1)).alias("folds"), F.avg((F.col("w") <= 0.5).cast("double")).alias("pbo"), F.avg(F.ln(F.col("w") / (1 - F.col("w")))).alias("mean_logit"))


def moments(days: DataFrame, value: str) -> DataFrame:
    """n, sharpe per period, skew, kurtosis (normal: 3)."""
    return days.agg(F.count(value).alias("n"), F.try_divide(F.avg(value), F.stddev_samp(value)).alias("sr"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))


def probabilistic_sharpe(stats: DataFrame, benchmark: float = 0.0) -> DataFrame:
    """Adds psr_z: the statistic of Sharpe > benchmark under skew and kurtosis (Bailey and Lopez de Prado)."""
    sr = F.col("sr")
    return stats.withColumn("psr_z", (sr - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr))


def first_reason(cases: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds; null if none does."""
    out = None
    for name, cond in cases:
        out = F.when(F.coalesce(cond, F.lit(False)), name) if out is None else out.when(F.coalesce(cond, F.lit(False)), name)
    return out


def precision_recall(rows: DataFrame, score: str, label: str) -> DataFrame:
    """auc_pr: area under precision over recall by trapezoids between distinct scores, from the highest on; n_points of the curve."""
    by = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("q"))
    run = prefix_sums(by, score, ["p", "q"], descending=True)
    total = by.agg(F.greatest(F.sum("p"), F.lit(1.0)).alias("all"))
    at = run.join(F.broadcast(total)).select(score, F.col("cum_p"), F.col("p"), "q", (F.col("cum_p") / F.col("all")).alias("rec"), (F.col("cum_p") / (F.col("cum_p") + F.col("cum_q"))).alias("prec"), (F.col("p") / F.col("all")).alias("step"), F.col("cum_q").alias("cq"), "all")
    # the point before: its sums are this point's less its own counts
    before = (F.col("cum_p") - F.col("p")) / F.nullif(F.col("cum_p") - F.col("p") + F.col("cq") - F.col("q"), F.lit(0.0))
    return at.agg(F.sum(F.when(before.isNotNull(), F.col("step") * (F.col("prec") + before) / 2).otherwise(0.0)).alias("auc_pr"), F.count(F.lit(1)).alias("n_points"))


def tear_sheet(days: DataFrame, capital: float, periods: int = 252) -> DataFrame:
    """cagr (over calendar years of 365.25 days), ann_vol, max_drawdown, calmar, best and worst day of equity rows (day, pnl, equity, drawdown)."""
    ret = days.withColumn("r", F.col("pnl") / (F.col("equity") - F.col("pnl")))
    years = F.greatest(F.datediff(F.max("day"), F.min("day")), F.lit(1)) / 365.25
    cagr = F.pow(F.max_by("equity", "day") / capital, 1 / years) - 1
    out = ret.agg(cagr.alias("cagr"), (F.stddev_samp("r") * math.sqrt(periods)).alias("ann_vol"), F.min("drawdown").alias("max_drawdown"), F.max("r").alias("best"), F.min("r").alias("worst"))
    return out.withColumn("calmar", F.try_divide("cagr", F.abs("max_drawdown")))


def drawdown_spells(days: DataFrame) -> DataFrame:
    """start (day of the peak before), trough, recovered (first day back at the peak, null if none), depth, days_down, days_back: each spell below a peak. One row per day in order."""
    w = Window.orderBy("day")
    at = days.withColumn("_peak_day", F.last(F.when(F.col("drawdown") == 0, F.col("day")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("_back", F.first(F.when(F.col("drawdown") == 0, F.col("day")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    out = at.where("drawdown < 0").groupBy(F.col("_peak_day").alias("start"), F.col("_back").alias("recovered")).agg(F.min(F.struct("drawdown", "day"))["day"].alias("trough"), F.min("drawdown").alias("depth"))
    return out.withColumns({"days_down": F.datediff("trough", "start"), "days_back": F.datediff("recovered", "trough")})
