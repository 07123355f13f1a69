"""Fill fractions of orders: their expectation, and draws from a Beta distribution around it that depend on the order's key only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.significance import draw


def expected_share(depth_share: Column, participation: Column, sigma: Column, base: float = 1.0, safe_depth: float = 0.15, depth_50: float = 0.35, depth_shape: float = 1.5, safe_part: float = 0.001, part_50: float = 0.005, part_shape: float = 1.2, sigma_mult: float = 1.5) -> Column:
    """Expected fill: a half at depth_50 and part_50 beyond the safe shares, less in volatility; 0 to 1."""
    over = lambda v, safe, half, shape: 1 / (1 + F.pow(F.greatest(F.lit(0.0), v - safe) / half, F.lit(shape)))
    mu = base * over(depth_share, safe_depth, depth_50, depth_shape) * over(participation, safe_part, part_50, part_shape) * F.exp(-sigma_mult * F.greatest(F.lit(0.0), sigma))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mu))


def concentration(adv: Column, reference: float, base: float = 75.0, power: float = 0.2, low: float = 10.0, high: float = 500.0) -> Column:
    """How closely draws keep to the expectation: more for liquid pairs."""
    return F.greatest(F.lit(low), F.least(F.lit(high), base * F.pow(F.greatest(F.lit(1e-12), adv / reference), F.lit(power))))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete Beta function, by its continued fraction (Lentz) on the side where that converges fast."""
    from math import lgamma

    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    gamma = np.frompyfunc(lgamma, 1, 1)
    scale = (gamma(p + q) - gamma(p) - gamma(q)).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(scale + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    found = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - found, found)


def beta_quantile(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By bisection, all at once."""
    low, high = np.zeros_like(u), np.ones_like(u)
    for _ in range(54):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < u
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _drawn(u: Column, mu: Column, kappa: Column) -> Column:
    @F.pandas_udf("double")
    def run(u: pd.Series, mu: pd.Series, kappa: pd.Series) -> pd.Series:
        centre, k = np.clip(mu.to_numpy(float), 1e-6, 1 - 1e-6), kappa.to_numpy(float)
        return pd.Series(beta_quantile(u.to_numpy(float), centre * k, (1 - centre) * k))

    return run(u, mu, kappa)


def sampled_fills(orders: DataFrame, key: str, seed: int, adv_reference: float, reject_below: float = 0.01, least: float = 0.02, reject: bool = True) -> DataFrame:
    """Adds expected, kappa and sampled (0 to 1) to orders: key, depth_share, participation, sigma, adv; all present. A draw is the Beta quantile of a uniform number made of the seed and the key, so it is the same in
    every run and partitioning. Draws under reject_below are no fill (reject), other ones are `least` at least."""
    at = orders.withColumns({"expected": expected_share(F.col("depth_share"), F.col("participation"), F.col("sigma")), "kappa": concentration(F.col("adv"), adv_reference)})
    u = (draw(seed, F.col(key)) + 0.5) / 2**32
    raw = F.col("_raw")
    sampled = F.when((raw < reject_below) & F.lit(reject), 0.0).when((raw > 0) & (raw < least), least).otherwise(raw)
    return at.withColumn("_raw", _drawn(u, F.col("expected"), F.col("kappa"))).withColumn("sampled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sampled))).drop("_raw")
