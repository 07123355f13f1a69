"""Baseline strategy and sampled fills."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import sampling, signals, strategy

SPAN = strategy.Span(dt.date(2020, 1, 1), dt.date(2020, 4, 9), dt.date(2020, 4, 1), dt.date(2020, 6, 30), dt.date(2020, 7, 20))


def plain(rows, window, least, entry, stop):
    """One pair, row by row."""
    train = [r for r in rows if SPAN.train_start <= r[0] <= SPAN.train_end]
    beta = np.polyfit([r[2] for r in train], [r[1] for r in train], 1)[0]
    spread, out, prev = [], [], math.nan
    for ts, y, x in rows:
        inside = SPAN.test_start <= ts <= SPAN.exit_end
        if not (inside or (SPAN.train_start <= ts <= SPAN.train_end and ts < SPAN.test_start)):
            continue
        past = spread[-window:]
        sd = np.std(past) if len(past) >= least else 0
        z = (y - beta * x - np.mean(past)) / sd if sd > 0 else math.nan
        spread.append(y - beta * x)
        if SPAN.test_start <= ts <= SPAN.entry_end:
            if z == z and -stop < z <= -entry and not prev <= -entry:
                out.append((ts, 1))
            elif z == z and entry <= z < stop and not prev >= entry:
                out.append((ts, -1))
            prev = z
    return out


def test_intents_against_a_walk(spark):
    rng = random.Random(2)
    rows = {}
    for name, slope in (("A-B", 1.5), ("A-C", 0.4), ("A-D", -1.0)):
        x, e, rows[name] = 50.0, 0.0, []
        for d in range(220):
            x, e = x + rng.gauss(0, 1), 0.8 * e + rng.gauss(0, 1)
            if rng.random() < 0.9:
                rows[name].append((dt.date(2020, 1, 1) + dt.timedelta(days=d), 10 + slope * x + e, x))
    df = spark.createDataFrame([(n, *r) for n, v in rows.items() for r in v] + [("F-L", dt.date(2020, 1, 1) + dt.timedelta(days=d), 1.0, float(d)) for d in range(200)], "pair string, ts date, y double, x double")
    out = strategy.baseline(df, SPAN, 1.5, 4.0, 20, 8)
    for name in ("A-B", "A-C"):
        assert sorted((r.ts, r.side) for r in out.where(F.col("pair") == name).collect()) == plain(rows[name], 20, 8, 1.5, 4.0)
    assert {r.pair for r in out.collect()} <= {"A-B", "A-C"} and out.count() > 5
    # a gate that no state of training passes bars all, one that all pass none
    options = {"horizon": 1, "min_train": 1, "min_state": 1}
    assert strategy.baseline(df, SPAN, 1.5, 4.0, 20, 8, gate={**options, "least": 0.0}).count() == out.count()
    assert strategy.baseline(df, SPAN, 1.5, 4.0, 20, 8, gate={**options, "least": 1.1}).count() < out.count()
    assert signals.STRATEGIES["baseline"] is strategy.baseline


def test_beta_quantiles():
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0.05, 300, 300), rng.uniform(0.05, 300, 300)
    u = rng.uniform(0.001, 0.999, 300)
    x = sampling.beta_quantile(u, a, b)
    assert np.abs(sampling.beta_cdf(x, a, b) - u)[(x > 1e-12) & (x < 1 - 1e-12)].max() < 1e-9
    grid = (np.arange(200_000) + 0.5) / 200_000
    for p, q in ((2.0, 5.0), (30.0, 4.0), (75.0, 75.0)):  # against the integral of the density
        density = np.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + (p - 1) * np.log(grid) + (q - 1) * np.log1p(-grid)) / 200_000
        for at in (0.1, 0.5, 0.8):
            assert sampling.beta_cdf(np.array([at]), np.array([p]), np.array([q]))[0] == pytest.approx(density[grid <= at].sum(), abs=1e-5)


def test_sampled_fills_have_the_mean_and_variance(spark):
    orders = spark.range(6000).select("id", F.lit(0.3).alias("depth_share"), F.lit(0.002).alias("participation"), F.lit(0.02).alias("sigma"), F.lit(2e7).alias("adv"))
    got = sampling.sampled_fills(orders.repartition(9), "id", 5, 1e7)
    rows = got.select("id", "expected", "kappa", "sampled").collect()
    mu, kappa = rows[0].expected, rows[0].kappa
    assert mu == pytest.approx(1 / (1 + (0.15 / 0.35) ** 1.5) / (1 + (0.001 / 0.005) ** 1.2) * math.exp(-0.03)) and kappa == pytest.approx(75 * 2**0.2)
    values = np.array([r.sampled for r in rows])
    assert values.mean() == pytest.approx(mu, abs=4 * math.sqrt(mu * (1 - mu) / (kappa + 1) / 6000)) and values.var() == pytest.approx(mu * (1 - mu) / (kappa + 1), rel=0.08)
    again = {r.id: r.sampled for r in sampling.sampled_fills(orders.coalesce(1), "id", 5, 1e7).collect()}
    assert all(again[r.id] == r.sampled for r in rows) and len(set(values)) > 5900
    thin = sampling.sampled_fills(orders.limit(200).withColumn("depth_share", F.lit(50.0)), "id", 5, 1e7).collect()
    assert {r.sampled == 0.0 or r.sampled >= 0.02 for r in thin} == {True} and any(r.sampled == 0.0 for r in thin)
