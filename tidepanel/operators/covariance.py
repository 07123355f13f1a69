"""Shrunk correlations of row-count windows by blocks of symbols, and bootstrap tests of pairs over them.

A window's matrix is never whole in one task: symbols are cut into blocks, a task holds the rows of two blocks of one window and gives the sums of products of its pairs. The shrinkage needs three numbers of the whole
matrix (trace, squared sum, squared sum of fourth moments), which are sums over the blocks. The shrunk matrix is positive wherever the shrinkage is: its least eigenvalue is at least shrinkage times the mean
variance. Only a window for which that is under a tolerance is brought together and clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.significance import draw
from tidepanel.operators.stats import nearest_positive
from tidepanel.operators.storage import Rounds


def complete_days(rets: DataFrame) -> DataFrame:
    """symbol, ts, ret of the days on which every symbol has a return."""
    n = rets.agg(F.count_distinct("symbol").alias("_n"))  # one row
    whole = rets.groupBy("ts").agg(F.count(F.lit(1)).alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select("ts")
    return rets.join(whole, "ts", "left_semi")


def window_days(rets: DataFrame, window: int, step: int) -> DataFrame:
    """ts, window_id, t (place in the window): windows of `window` days every `step` days; only whole ones. Numbered over the panel's days."""
    from tidepanel.operators.folds import numbered

    days = numbered(rets.select("ts", F.unix_date("ts").alias("_d")).distinct(), "_d").select("ts", "i")
    size = days.agg(F.count(F.lit(1)).alias("_n"))  # one row
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - window + 1) / step).cast("int"))
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("_n") - window) / step)).cast("int")
    at = days.join(F.broadcast(size)).where(F.col("_n") >= window)
    ids = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    return at.withColumn("window_id", ids).select("ts", "window_id", (F.col("i") - F.col("window_id") * step).cast("int").alias("t"))


def _products(key: tuple, group: pa.Table) -> pa.Table:
    """Sums over a window's days for the pairs of two blocks (of one with itself: each once)."""
    which, names, t, ret = (group.column(c).to_numpy() for c in ("block", "symbol", "t", "ret"))
    sides = []
    for b in sorted(set(which)):
        symbols, at = np.unique(names[which == b], return_inverse=True)
        x = np.zeros((int(t.max()) + 1, len(symbols)))
        x[t[which == b], at] = ret[which == b]
        sides.append((symbols, x - x.mean(axis=0)))
    alone = key[1].as_py() == key[2].as_py()
    if not alone and len(sides) == 1:  # the other block has no symbols
        sides.append((np.zeros(0, object), np.zeros((len(sides[0][1]), 0))))
    (left, x), (right, y) = sides[0], sides[-1]
    s, q = x.T @ y / len(x), (x**2).T @ (y**2) / len(x)
    i, j = np.triu_indices(len(left)) if alone else (np.repeat(np.arange(len(left)), len(right)), np.tile(np.arange(len(right)), len(left)))
    return pa.table({"window_id": pa.array(np.full(len(i), key[0].as_py(), np.int32)), "left": pa.array(left[i], pa.string()), "right": pa.array(right[j], pa.string()), "s": s[i, j], "q": q[i, j], "n": np.full(len(i), len(x), np.int64)})


def covariances(rets: DataFrame, window: int, step: int, block: int = 256) -> DataFrame:
    """window_id, left, right (left <= right), s (covariance, ddof 0), q (mean of squared products), n of every two symbols over the panel's complete days. A task holds about 2 * block * window returns
    (symbols are dealt to blocks by hash)."""
    rounds = Rounds(rets.sparkSession, "returns")
    whole = rounds.put(complete_days(rets).select("symbol", "ts", "ret"))
    names = whole.select("symbol").distinct()
    blocks = max(1, -(-names.count() // block))
    dealt = whole.join(window_days(whole, window, step), "ts").withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"))
    # a block goes to its pairs with every block, its own included
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each = dealt.withColumn("_o", other).withColumns({"lo": F.least("block", "_o"), "hi": F.greatest("block", "_o")}).drop("_o")
    found = each.groupBy("window_id", "lo", "hi").applyInArrow(_products, "window_id int, left string, right string, s double, q double, n long")
    swap = F.col("left") > F.col("right")
    return found.select("window_id", F.when(swap, F.col("right")).otherwise(F.col("left")).alias("left"), F.when(swap, F.col("left")).otherwise(F.col("right")).alias("right"), "s", "q", "n")


def shrinkage(cov: DataFrame) -> DataFrame:
    """window_id, p, mu (mean variance), shrink: towards mu times the identity (Ledoit and Wolf, 2004), from sums over the pairs."""
    own = F.col("left") == F.col("right")
    twice = F.when(own, 1).otherwise(2)
    sums = cov.groupBy("window_id").agg(
        F.count_if(own).alias("p"), F.sum(F.when(own, F.col("s"))).alias("trace"), F.sum(twice * F.col("s") * F.col("s")).alias("ss"), F.sum(twice * (F.col("q") - F.col("s") * F.col("s"))).alias("noise"), F.max("n").alias("n")
    )
    mu = F.col("trace") / F.col("p")
    delta = (F.col("ss") - F.col("p") * mu * mu) / F.col("p")
    beta = F.least(delta, F.col("noise") / (F.col("n") * F.col("p")))
    return sums.select("window_id", "p", mu.alias("mu"), F.when((F.col("p") == 1) | (beta <= 0), 0.0).otherwise(beta / delta).alias("shrink"))


def shrunk_correlations(rets: DataFrame, window: int = 84, step: int = 21, block: int = 256, tolerance: float = 1e-12, floor: float = 1e-8) -> DataFrame:
    """window_id, left, right (left < right), corr over windows of the panel's complete days. rets: symbol, ts, ret. A symbol that stands still has correlation 0."""
    rounds = Rounds(rets.sparkSession, "covariances")
    cov = rounds.put(covariances(rets, window, step, block))
    by = rounds.put(shrinkage(cov))
    own = F.col("left") == F.col("right")
    shrunk = cov.join(F.broadcast(by), "window_id").withColumn("s", (1 - F.col("shrink")) * F.col("s") + F.when(own, F.col("shrink") * F.col("mu")).otherwise(0.0))  # by: one row per window
    sure = F.col("shrink") * F.col("mu") >= tolerance

    def clipped(group: pa.Table) -> pa.Table:
        names, at = np.unique(np.concatenate([group.column("left").to_numpy(), group.column("right").to_numpy()]), return_inverse=True)
        i, j = at[: group.num_rows], at[group.num_rows :]
        m = np.zeros((len(names), len(names)))
        m[i, j] = m[j, i] = group.column("s").to_numpy()
        if len(m) and np.linalg.eigvalsh(m).min() < tolerance:
            m = nearest_positive(m, floor)
        return group.set_column(group.column_names.index("s"), "s", pa.array(m[i, j]))

    shape = "window_id int, left string, right string, s double"
    good, bad = shrunk.where(sure).select("window_id", "left", "right", "s"), shrunk.where(~sure).select("window_id", "left", "right", "s")
    final = good if bad.isEmpty() else good.union(bad.groupBy("window_id").applyInArrow(clipped, shape))
    scale = final.where(own).select("window_id", F.col("left").alias("name"), F.sqrt(F.greatest("s", F.lit(0.0))).alias("d"))
    side = lambda c: scale.select("window_id", F.col("name").alias(c), F.col("d").alias(f"d_{c}"))
    out = final.where(~own).join(side("left"), ["window_id", "left"]).join(side("right"), ["window_id", "right"])
    corr = F.coalesce(F.try_divide("s", F.col("d_left") * F.col("d_right")), F.lit(0.0))
    return out.select("window_id", "left", "right", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr)).alias("corr"))


def resample_weights(windows: int, resamples: int, block: float, spark, seed: int = 42) -> np.ndarray:
    """How often each of so many windows is drawn in each resample of the stationary bootstrap (Politis and Romano, 1994): a window starts anew with chance 1 / block, at a drawn place, else the next one follows.
    Draws are keyed by (resample, place), the same in SQL. resamples x windows numbers."""
    rows = spark.range(resamples).select(F.col("id").alias("b")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    fresh = (F.col("t") == 0) | (draw(seed, F.lit("f"), F.col("b"), F.col("t")) * block < 2**32)
    found = rows.select("b", "t", fresh.alias("fresh"), (draw(seed, F.lit("s"), F.col("b"), F.col("t")) % windows).alias("start")).orderBy("b", "t").toArrow()
    fresh, start = (found.column(c).to_numpy().reshape(resamples, windows) for c in ("fresh", "start"))
    t = np.arange(windows)
    head = np.maximum.accumulate(np.where(fresh, t, 0), axis=1)
    index = (np.take_along_axis(start, head, axis=1) + t - head) % windows
    out = np.zeros((resamples, windows))
    np.add.at(out, (np.arange(resamples)[:, None], index), 1.0)
    return out


def bootstrap_pairs(corrs: DataFrame, resamples: int = 2000, block: float = 5.0, null_mean: float = 0.0, seed: int = 42) -> DataFrame:
    """left, right, n, mean, ci_low, ci_high, p of each pair's window correlations: 95 % interval of the resampled mean, and the share of resamples that, moved to null_mean, reach the mean (plus one).

    The resamples are one set of draws for all pairs, so a batch of pairs is one product with their weights: resamples x windows numbers, which go to every task. Pairs that lack a window are left out.
    """
    spark = corrs.sparkSession
    windows = sorted(r[0] for r in corrs.select("window_id").distinct().collect())  # the panel's windows
    if not windows:
        return spark.createDataFrame([], "left string, right string, n long, mean double, ci_low double, ci_high double, p double")
    weights = spark.sparkContext.broadcast(resample_weights(len(windows), resamples, block, spark, seed) / len(windows))
    rows = corrs.groupBy("left", "right").agg(F.transform(F.array_sort(F.collect_list(F.struct("window_id", "corr"))), lambda x: x["corr"]).alias("x")).where(F.size("x") == len(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.array(part.column("x").to_pylist(), float).reshape(-1, w.shape[1])
                mean, means = x.mean(axis=1), x @ w.T
                low, high = np.quantile(means, [0.025, 0.975], axis=1)
                p = (np.count_nonzero(means - mean[:, None] + null_mean >= mean[:, None], axis=1) + 1) / (len(w) + 1)
                cols = [part.column("left"), part.column("right"), pa.array(np.full(len(x), w.shape[1], np.int64)), *map(pa.array, (mean, low, high, p))]
                yield pa.RecordBatch.from_arrays(cols, names=["left", "right", "n", "mean", "ci_low", "ci_high", "p"])

    return rows.mapInArrow(run, "left string, right string, n long, mean double, ci_low double, ci_high double, p double")
