"""Significance of Sharpe ratios against closed forms and plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tidepanel.operators import significance as S
from tidepanel.plans import market_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["deflated_sharpe", "trial_analysis", "sharpe_interval"])
def test_matches_sql(spark, name):
    assert_same(market_queries.QUERIES[name](spark, SF), connect(SF), market_queries.ORACLE[name])


def test_distribution_functions(spark):
    z = [-12.0, -3.0, -0.5, 0.0, 1.0, 1.96, 8.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(S.normal_cdf(F.col("z"))).collect()
    assert all(abs(g[0] - statistics.NormalDist().cdf(v)) < 1e-8 for g, v in zip(got, z, strict=True))
    # published values of Student's t
    known = [(2.228, 10.0, 0.975), (1.812, 10.0, 0.95), (2.042, 30.0, 0.975), (-1.697, 30.0, 0.05), (0.0, 25.0, 0.5), (1.962, 1000.0, 0.975)]
    rows = spark.createDataFrame(known, "t double, df double, p double").select(S.student_cdf(F.col("t"), F.col("df")), "p").collect()
    assert all(abs(a - b) < 2e-4 for a, b in rows)


def test_deflation_grows_with_trials(spark):
    row = spark.createDataFrame([(500, 0.9, -0.2, 4.0)], "n long, sr double, skew double, kurt double")
    one, few, many = (S.significance(row, n).first() for n in (1, 10, 1000))
    sigma = math.sqrt((1 + 0.2 * 0.9 + 0.75 * 0.81) / 499)
    assert one.sr_max == 0 and one.dsr == one.psr and few.sr_max == pytest.approx(S.expected_best(10) * sigma) and one.dsr >= few.dsr >= many.dsr
    assert 1.5 < S.expected_best(10) < 1.65 and S.expected_best(1) == 0


def test_overfit_share(spark):
    rows = [(1, "a", 3.0, 9.0), (1, "b", 2.0, 1.0), (1, "c", 1.0, 5.0), (2, "a", 1.0, 1.0), (2, "b", 5.0, 1.0), (2, "c", 2.0, 3.0), (3, "a", 9.0, 0.0), (3, "b", None, 1.0), (3, "a", 7.0, 4.0)]
    df = spark.createDataFrame(rows, "fold int, model string, is_score double, oos_score double")
    # fold 1: a is the best of three; fold 2: b is second of three (a ties, and is behind it by name); fold 3: a is there alone, so it is the best
    assert tuple(S.overfit_share(df).first()) == (3, pytest.approx(2 / 3))
    assert S.overfit_share(df.where("model = 'a'")).first().pbo == 0.0


def test_summary_uses_the_largest_component(spark):
    rows = [("x", "a", 1.0, 1, 1.0, 2.0), ("x", "b", 2.0, 1, 2.0, 1.0), ("y", "c", 9.0, 1, 1.0, 1.0), ("x", "a", None, 2, None, None)]
    trials = spark.createDataFrame(rows, "component string, model string, score double, fold int, is_score double, oos_score double")
    curve = spark.createDataFrame([(i, 100.0 + i + (i % 3)) for i in range(40)], "day int, equity double")
    got = S.trial_summary(trials, curve, "day").first()
    assert (got.component, got.n_candidates, got.n_test_obs, got.n_folds, got.pbo) == ("x", 2, 39, 1, 0.0)
    assert S.trial_summary(trials, curve, "day", component="y").first().n_candidates == 1


def test_bootstrap_repeats_whatever_the_partitions(spark):
    rng = random.Random(3)
    pnl = [rng.gauss(5, 100) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(pnl)), "day int, pnl double")
    got = [tuple(S.bootstrap_sharpe(df.repartition(n), "day", 10_000.0, 40).first()) for n in (1, 7)]
    equity, r = 10_000.0, []
    for k, p in enumerate(pnl):
        r.append(p / equity if k else 0.0)
        equity += p
    key = lambda b, k: int(hashlib.md5(f"7:{b}:{k}".encode()).hexdigest()[:8], 16) % 120
    ratios = []
    for b in range(40):
        sample = [r[key(b, k)] for k in range(120)]
        ratios.append(statistics.mean(sample) / statistics.stdev(sample) * math.sqrt(252))
    assert got[0] == pytest.approx(got[1]) and got[0][0] == pytest.approx(statistics.mean(ratios)) and min(ratios) <= got[0][1] < got[0][2] <= max(ratios)
    assert S.bootstrap_sharpe(df.withColumn("pnl", F.lit(0.0)), "day", 1.0, 5).first().mean is None
