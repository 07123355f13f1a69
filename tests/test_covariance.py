"""Blocked covariances and pair bootstrap against whole matrices."""

from __future__ import annotations

import numpy as np

from tidepanel.operators import covariance as V
from tidepanel.operators import stats


def returns(spark, x, first="2020-01-01"):
    days = np.datetime64(first) + np.arange(len(x))
    rows = [(f"s{j:02}", days[i].item(), float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v == v]
    return spark.createDataFrame(rows, "symbol string, ts date, ret double").repartition(5)


def want(x, window, step):
    out = {}
    for w, at in enumerate(range(0, len(x) - window + 1, step)):
        cov = stats.ledoit_wolf(x[at : at + window])
        d = np.sqrt(np.diag(cov))
        for i in range(len(d)):
            for j in range(i + 1, len(d)):
                out[w, f"s{i:02}", f"s{j:02}"] = cov[i, j] / (d[i] * d[j]) if d[i] * d[j] else 0.0
    return out


def test_blocks_give_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 9)) @ rng.normal(size=(9, 9))
    full = x.copy()
    x[7, 3] = np.nan  # a day that one symbol lacks is no day
    expected = want(np.delete(full, 7, axis=0), 20, 7)
    for block in (2, 100):
        got = {(r.window_id, r.left, r.right): r["corr"] for r in V.shrunk_correlations(returns(spark, x), 20, 7, block).collect()}
        assert set(got) == set(expected) and max(abs(got[k] - v) for k, v in expected.items()) < 1e-9
    assert V.shrunk_correlations(returns(spark, x).limit(0), 20, 7).count() == 0


def test_a_still_symbol_and_a_matrix_that_is_not_positive(spark):
    x = np.zeros((12, 3))
    x[:, 1] = np.arange(12) % 2
    got = {(r.left, r.right): r["corr"] for r in V.shrunk_correlations(returns(spark, x), 12, 12).collect()}
    assert len(got) == 3 and all(np.isfinite(v) for v in got.values()) and got["s00", "s02"] == 0.0
    # under a tolerance that no window meets, every matrix is brought together and clipped at the floor
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    got = {(r.left, r.right): r["corr"] for r in V.shrunk_correlations(returns(spark, x), 30, 30, tolerance=1e6, floor=0.9).collect()}
    m = stats.nearest_positive(stats.ledoit_wolf(x), 0.9)
    d = np.sqrt(np.diag(m))
    assert np.linalg.eigvalsh(m).min() > 0.9 - 1e-9 and all(abs(got[f"s{i:02}", f"s{j:02}"] - m[i, j] / d[i] / d[j]) < 1e-9 for i in range(4) for j in range(i + 1, 4))


def test_bootstrap_by_weights_is_the_bootstrap_by_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.2, 1, size=(6, 25))
    rows = [(w, "a", f"b{k}", float(v)) for k, row in enumerate(x) for w, v in enumerate(row)] + [(0, "a", "short", 1.0)]
    df = spark.createDataFrame(rows, "window_id int, left string, right string, corr double").repartition(4)
    got = {r.right: r for r in V.bootstrap_pairs(df, 60).collect()}
    w = V.resample_weights(25, 60, 5.0, spark)
    assert w.sum(axis=1).tolist() == [25.0] * 60 and "short" not in got
    for k, row in enumerate(x):
        means = (w * row).sum(axis=1) / 25
        r = got[f"b{k}"]
        assert abs(r["mean"] - row.mean()) < 1e-12 and np.allclose([r.ci_low, r.ci_high], np.quantile(means, [0.025, 0.975])) and abs(r.p - ((means - row.mean() >= row.mean()).sum() + 1) / 61) < 1e-12
    # a block of one place draws anew each time; long blocks go on to the next window
    assert len(np.unique(V.resample_weights(25, 60, 1.0, spark).max(axis=1))) > 1 and V.bootstrap_pairs(df.limit(0)).count() == 0
