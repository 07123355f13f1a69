"""Pair research against brute force and SQL."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests.oracle import assert_same, connect
from tidepanel.operators import clusters as K
from tidepanel.operators import cointegration as C
from tidepanel.operators import folds as V
from tidepanel.plans import research_queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(research_queries.ORACLE))
def test_matches_sql(spark, con, name):
    """At the size that has enough days for these queries."""
    assert_same(research_queries.QUERIES[name](spark, SF), con, research_queries.ORACLE[name])


def plain_adf(e):
    """The regressions on rows, as a textbook runs them."""
    d, n = np.diff(e), len(e)
    top = max(0, min(n // 2 - 1, math.ceil(12 * (n / 100) ** 0.25)))

    def fit(lags, skip):
        t = np.arange(skip, n - 1)
        a = np.column_stack([e[t]] + [d[t - j] for j in range(1, lags + 1)])
        coef = np.linalg.lstsq(a, d[t], rcond=None)[0]
        rest = d[t] - a @ coef
        return coef, rest @ rest, a

    aic = [((n - 1 - top) * math.log(fit(k, top)[1] / (n - 1 - top)) + 2 * (k + 1), k) for k in range(top + 1)]
    lags = min(aic)[1]
    coef, ssr, a = fit(lags, lags)
    return coef[0] / math.sqrt(ssr / (len(a) - lags - 1) * np.linalg.inv(a.T @ a)[0, 0])


def test_statistics_from_sums_are_those_of_the_rows(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k, n in enumerate((31, 45, 60, 150, 400)):
        x = np.cumsum(rng.normal(size=n)) + 50
        noise = rng.normal(size=n)
        for i in range(1, n):
            noise[i] += 0.6 * noise[i - 1]
        y = 3 + 0.7 * x + noise
        rows += [(f"p{k}", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))]
        beta, alpha = np.polyfit(x, y, 1)
        s = y - beta * x
        want[f"p{k}"] = (n, beta, plain_adf(y - alpha - beta * x), s[:-1] @ np.diff(s) / (s[:-1] @ s[:-1]))
    rows += [("flat", i, float(i % 5), 1.0) for i in range(40)] + [("same", i, 2.0 * i * i + 1, float(i * i)) for i in range(40)] + [("few", 1, 1.0, 2.0), ("few", 2, None, 2.0), ("one", 1, None, None)]
    df = spark.createDataFrame(rows, "pair string, ts int, y double, x double").repartition(5)
    got = {r.pair: r for r in C.engle_granger(df).collect()}
    for pair, (n, beta, stat, lam) in want.items():
        r = got[pair]
        assert r.n == n and r.beta == pytest.approx(beta) and r.statistic == pytest.approx(stat, rel=1e-6) and r.lam == pytest.approx(lam, rel=1e-6) and r.p == pytest.approx(C.p_value(stat), abs=1e-6)
    assert got["flat"].beta is None and got["flat"].p is None and got["same"].p == 0.0 and got["few"].p is None and "one" not in got
    assert C.engle_granger(df.limit(0)).count() == 0


def test_p_values_meet_the_published_critical_values():
    assert C.p_value(-3.9001) == pytest.approx(0.01, abs=0.001) and C.p_value(-3.3377) == pytest.approx(0.05, abs=0.002) and C.p_value(-3.0462) == pytest.approx(0.10, abs=0.003)
    assert C.p_value(-20) == 0 and C.p_value(1.0) == 1.0 and abs(C.p_value(-2.62) - C.p_value(-2.6200001)) < 0.002


def test_prefilter_says_why(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=500)) + 100
    ar = np.zeros(500)
    for i in range(1, 500):
        ar[i] = 0.93 * ar[i - 1] + rng.normal()
    quick = rng.normal(size=500)
    series = {"good": 2 * x + ar, "fast": 2 * x + quick, "negative": -2 * x + ar, "walk": np.cumsum(rng.normal(size=500)) + 100}
    rows = [(k, i, float(a), float(b)) for k, y in series.items() for i, (a, b) in enumerate(zip(y, x, strict=True))] + [("short", i, float(i), float(i * i)) for i in range(10)]
    df = spark.createDataFrame(rows, "pair string, ts int, y double, x double")
    got = {r.pair: r for r in C.prefilter(df, half_lives=(2.0, 200.0)).collect()}
    assert got["negative"].reason == "beta_non_positive" and got["walk"].reason == "eg_failed" and got["short"].reason == "min_obs_not_met" and got["short"].p is None
    assert got["fast"].reason in ("half_life_too_fast", "lambda_invalid_domain") and got["fast"].z_window is None
    only = {r.pair: r.passed for r in C.prefilter(df, half_lives=None).collect()}
    assert only == {"good": True, "fast": True, "negative": False, "walk": False, "short": False}
    assert {r.reason for r in got.values() if r.reason} <= set(C.REASONS)
    slow = {r.pair: r for r in C.prefilter(df, half_lives=(0.01, 0.02)).collect()}
    assert slow["good"].reason == "half_life_too_slow" and slow["good"].half_life == pytest.approx(-math.log(2) / math.log(1 + slow["good"].lam))


def test_pairs_asked_for_only(spark):
    bars = spark.createDataFrame([(s, d, float(d)) for s in "ABC" for d in range(3)] + [("A", 9, None)], "symbol string, ts int, close double")
    pairs = spark.createDataFrame([("A", "C"), ("A", "C"), ("A", "Z")], "left string, right string")
    assert sorted((r.pair, r.ts, r.y, r.x) for r in C.pair_rows(bars, pairs).collect()) == [("A-C", d, float(d), float(d)) for d in range(3)]


def plain_linkage(d):
    """Average linkage, one merge at a time."""
    n, out = len(d), []
    groups = {i: [i] for i in range(n)}
    while len(groups) > 1:
        h, a, b = min((np.mean([d[i][j] for i in groups[a] for j in groups[b]]), a, b) for a in groups for b in groups if a < b)
        groups[n + len(out)] = groups.pop(a) + groups.pop(b)
        out.append((len(out), a, b, h, len(groups[n + len(out)])))
    return out


def test_average_linkage_in_rounds(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    rows = [(f"s{j:02}", f"s{i:02}", float(d[i, j])) if (i + j) % 2 else (f"s{i:02}", f"s{j:02}", float(d[i, j])) for i in range(30) for j in range(i + 1, 30)]
    df = spark.createDataFrame(rows, "left string, right string, d double")
    want = plain_linkage(d)
    merges, labels = K.agglomerate(df, want[20][3])
    got = [tuple(r) for r in merges.orderBy("step").collect()]
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert len({r.cluster for r in labels.collect()}) == 30 - 21
    cut = {i: {i} for i in range(30)}
    for s, a, b, _, _ in want[:21]:
        cut[30 + s] = cut.pop(a) | cut.pop(b)
    assert {frozenset(int(r.symbol[1:]) for r in labels.collect() if r.cluster == c) for c in {r.cluster for r in labels.collect()}} == {frozenset(g) for g in cut.values()}


def test_clusters_of_equal_distances_and_of_few_symbols(spark):
    names = "ABCD"
    even = spark.createDataFrame([(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1 :]], "left string, right string, d double")
    merges, labels = K.agglomerate(even, 0.5)
    assert [r.height for r in merges.collect()] == [1.0] * 3 and {r.cluster for r in labels.collect()} == set(names)
    merges, labels = K.agglomerate(even.where("left = 'A' AND right = 'B'"))
    assert [tuple(r) for r in merges.collect()] == [(0, 0, 1, 1.0, 2)] and {r.cluster for r in labels.collect()} == {"A"}
    merges, labels = K.agglomerate(even.limit(0))
    assert merges.count() == 0 and labels.count() == 0


def test_blocks_give_the_remainder_to_the_first():
    assert V.boundaries(240, 7) == [0, 35, 70, 104, 138, 172, 206, 240] and V.boundaries(6, 3) == [0, 2, 4, 6]
    assert [V.embargo_rows(e, 15) for e in (0, 2.0, 0.1, 3)] == [0, 2, 2, 3] and V.combinations(4, 2, 3) == [(0, 1), (0, 2), (0, 3)] and V.runs(4, 2) == [(0, 1), (1, 2), (2, 3)]


def test_fold_rows_against_a_walk(spark):
    n, blocks, purge, embargo = 47, 5, 2, 0.15
    df = spark.createDataFrame([(i * 3, f"r{i}") for i in range(n)], "at int, name string").repartition(6)
    cuts = V.boundaries(n, blocks)
    for tests, together in ((V.combinations(blocks, 2), False), (V.runs(blocks, 2), True)):
        got = {(r.fold, r.i): r.part for r in V.fold_rows(df, "at", blocks, tests, purge, embargo, together).collect()}
        assert len(got) == n * len(tests)
        for f, chosen in enumerate(tests):
            for i in range(n):
                b = max(k for k in range(blocks) if cuts[k] <= i)
                lo, hi = (cuts[chosen[0]], cuts[chosen[-1] + 1]) if together else (cuts[b], cuts[b + 1])
                if b in chosen:
                    part = "test" if lo + purge <= i < hi - purge - math.ceil(embargo * (hi - lo)) else "dropped"
                else:
                    gap = purge + math.ceil(embargo * (cuts[b + 1] - cuts[b]))
                    part = "train" if (b - 1 not in chosen or i >= cuts[b] + gap) and (b + 1 not in chosen or i < cuts[b + 1] - gap) else "dropped"
                assert got[f, i] == part, (f, i)
    assert V.fold_rows(df.limit(3), "at", 5, V.runs(5, 2)).count() == 0
