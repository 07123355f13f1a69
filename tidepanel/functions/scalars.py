"""Scalar column functions of the panel operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def safe_div(a: Column, b: Column) -> Column:
    """Null where the divisor is 0 or missing."""
    return F.try_divide(a, b)


def bps(side: Column, price: Column, reference: Column) -> Column:
    """Signed shortfall against a reference, in basis points."""
    return 1e4 * F.signum(side) * safe_div(price - reference, reference)


def canonical_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def pair_leg(pair: Column, leg: int) -> Column:
    return F.trim(F.get(F.split(pair, "[-/,:]", 2), leg))


def normalize_symbol(symbol: Column, keep_suffixes: tuple[str, ...] = ("TO", "L", "DE")) -> Column:
    """Upper case; / and . become -, but for a kept exchange suffix."""
    plain = F.replace(F.upper(F.trim(symbol)), F.lit("/"), F.lit("-"))
    kept = plain.rlike(rf"\.({'|'.join(keep_suffixes)})$")
    return F.when(kept, plain).otherwise(F.replace(plain, F.lit("."), F.lit("-")))


def impact_bps(notional: Column, adv: Column, base: float, coef: float, power: float = 0.5, floor: float = 0.0, cap: float = 1e9) -> Column:
    """Base plus a power of participation, between floor and cap; the base alone where the volume is unknown, nothing without a notional."""
    share = safe_div(notional, F.when(adv > 0, adv))
    sized = F.least(F.lit(cap), F.greatest(F.lit(floor), base + coef * F.pow(share, F.lit(power))))
    return F.when(~F.coalesce(notional > 0, F.lit(False)), 0.0).when(share.isNull(), min(base, cap)).otherwise(sized)


def fill_probability(notional: Column, adv: Column, k: float, least: float) -> Column:
    share = safe_div(k * notional, F.when(adv > 0, adv))
    return F.greatest(F.lit(least), F.coalesce(1 / (1 + share * share), F.lit(0.0)))


def expected_fill(depth_share: Column, participation: Column, sigma: Column) -> Column:
    """Logistic in the share of visible depth and in participation, damped by volatility."""
    return F.exp(-F.coalesce(sigma, F.lit(0.0))) / (1 + F.exp(4 * (depth_share - 1) + 8 * (participation - 0.1)))


def stress_score(gap: Column, day_range: Column, sigma_ratio: Column, volume_ratio: Column) -> Column:
    """Weighted and clipped to 0..3; missing parts count 0."""
    part = lambda w, x, unit: w * F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)) / unit))
    return F.least(F.lit(3.0), part(0.35, gap, 0.02) + part(0.35, day_range, 0.03) + part(0.20, sigma_ratio, 2.0) + part(0.10, volume_ratio, 3.0))


def stress_regime(score: Column) -> Column:
    return F.when(score >= 2.5, "panic").when(score >= 1.75, "stress").when(score >= 1.0, "elevated").otherwise("normal")


def markov_state(z: Column, inner: float = 0.5, outer: float = 1.5) -> Column:
    """Five bins of a z-score, -2 to 2; null without one. Each outer level belongs to the outer bin, each inner one to the middle."""
    return F.when(z <= -outer, -2).when(z < -inner, -1).when(z <= inner, 0).when(z < outer, 1).when(z >= outer, 2)


def fixed_bin(x: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin, the lowest edge included; null outside."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), 0)
    for i in range(1, len(edges) - 1):
        out = out.when((x > edges[i]) & (x <= edges[i + 1]), i)
    return out


def money(value: Column) -> Column:
    """Whole ten-thousandths: sums of them are exact in any order."""
    return F.round(value * 10000).cast("long")


def lot_ceil(x: Column, lot: float) -> Column:
    return F.ceil(x / lot) * lot
