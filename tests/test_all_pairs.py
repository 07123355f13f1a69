"""Pair statistics hold every pair of symbols, against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tests.oracle import connect
from tests.test_research import plain_adf
from tidepanel.plans import panel_queries, report_queries, research_queries
from tidepanel.sources.panel import BARS

SF = "/root/testdata/sf0.001"


def closes():
    return connect(SF).execute(f"WITH {BARS} SELECT symbol, ts, close FROM bars").df().pivot(index="ts", columns="symbol", values="close").sort_index()


def plain_correlations(wide, window=42, step=21):
    """Window correlations by pair, of a panel with prices carried forward, by loops over the published estimator."""
    own = {s: np.log(wide[s].dropna()).diff().dropna() for s in wide}
    days = sorted({t for r in own.values() for t in r.index})
    start = max(r.index[0] for r in own.values())
    days = [t for t in days if t >= start]
    x = pd.DataFrame({s: own[s].reindex(days).fillna(0.0) for s in sorted(own)})
    out = {}
    for at in range(0, len(days) - window + 1, step):
        part = x.iloc[at : at + window].to_numpy()
        part = part - part.mean(axis=0)
        n, p = part.shape
        s = sum(np.outer(r, r) for r in part) / n
        mu = np.trace(s) / p
        delta = ((s - mu * np.eye(p)) ** 2).sum()
        beta = min(delta, sum(((np.outer(r, r) - s) ** 2).sum() for r in part) / n**2)
        cov = s + beta / delta * (mu * np.eye(p) - s)
        for i in range(p):
            for j in range(i + 1, p):
                out.setdefault((x.columns[i], x.columns[j]), []).append(cov[i, j] / np.sqrt(cov[i, i] * cov[j, j]))
    return out


def test_shrunk_pairs_of_all_symbols(spark):
    wide = closes()
    want = plain_correlations(wide)
    got = {(r.left, r.right): r for r in panel_queries.shrunk_pair_persistence(spark, SF).collect()}
    assert len(want) == wide.shape[1] * (wide.shape[1] - 1) // 2 and set(got) == set(want)
    for k, c in want.items():
        assert got[k].n == len(c) and abs(got[k].mean_corr - np.mean(c)) < 2e-6 and abs(got[k].pct1 - np.mean(np.array(c) >= 0.1)) < 2e-6
    boot = {(r.left, r.right): r for r in panel_queries.bootstrap_pairs(spark, SF).collect()}
    assert set(boot) == set(want) and all(abs(boot[k].mean - np.mean(c)) < 2e-6 and boot[k].ci_low <= boot[k].mean <= boot[k].ci_high for k, c in want.items())


def test_cointegration_half_life_and_pnl_of_all_pairs(spark):
    wide = closes()
    names = [f"{a}-{b}" for i, a in enumerate(wide) for b in wide.columns[i + 1 :]]
    common = {f"{a}-{b}": wide[[a, b]].dropna() for i, a in enumerate(wide) for b in wide.columns[i + 1 :]}
    got = {r.pair: r for r in research_queries.cointegration(spark, SF).collect()}
    assert set(got) == {n for n in names if len(common[n])} and len(got) == 300
    for n, r in got.items():
        assert r.n == len(common[n]) and (r.n >= 30) == (r.statistic is not None)
        if r.n >= 30:
            y, x = common[n].to_numpy().T
            slope, cut = np.polyfit(x, y, 1)
            assert abs(r.statistic - plain_adf(y - cut - slope * x)) < 1e-4
    assert panel_queries.QUERIES["all_pair_half_life"](spark, SF).count() == 300
    assert report_queries.QUERIES["all_pair_pnl"](spark, SF).count() == 300
