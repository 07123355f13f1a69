from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import mixing as M


def docs(spark, counts, words=5):
    rows = [(s * 10_000 + i, f"s{s}" if s else None, " ".join(["w"] * (1 + (i * 7) % words)), 1) for s, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")


def totals(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += len(r.text.split())
    return out


def alpha_by_bisection(tokens, measure, target):
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if measure(mid) <= target else (mid, high)
    return high


@pytest.mark.parametrize("limit", [1.2, 2.0, 5.0])
def test_repetition_limit(spark, limit):
    df = docs(spark, [900, 300, 100, 50])
    before, out = totals(df.collect()), M.mix_sources(df, max_repeat=limit, block_docs=20).collect()
    after = totals(out)
    times = {s: after[s] / before[s] for s in before}
    assert min(times.values()) == pytest.approx(1, abs=0.01) and max(times.values()) == pytest.approx(limit, rel=0.02)
    assert len({r.doc_id for r in out}) == 1350  # without a budget every document is read
    p = {s: t / sum(before.values()) for s, t in before.items()}
    a = alpha_by_bisection(before, lambda x: max(q**x / before[s] for s, q in p.items()) / min(q**x / before[s] for s, q in p.items()), limit)
    want = {s: q**a / sum(v**a for v in p.values()) for s, q in p.items()}
    total = sum(after.values())
    assert all(after[s] / total == pytest.approx(w, abs=0.01) for s, w in want.items())


def test_entropy_target(spark):
    df = docs(spark, [900, 300, 100])
    sources = df.groupBy(M.source_key(F.col("source")).alias("key")).agg(F.sum(M.token_count(F.col("text"))).alias("tokens"))
    a = M.fit_alpha(sources, entropy=1.0)
    t = [r.tokens for r in sources.collect()]
    w = [(x / sum(t)) ** a for x in t]
    assert -sum(x / sum(w) * math.log(x / sum(w)) for x in w) == pytest.approx(1.0, abs=1e-5)
    assert M.fit_alpha(sources, entropy=9.0) == 0.0


def test_budget_takes_whole_passes_and_a_part(spark):
    df = docs(spark, [400, 100])
    out = M.mix_sources(df, max_repeat=2.0, budget_ratio=1.0, block_docs=16).collect()
    before, after = totals(df.collect()), totals(out)
    assert sum(after.values()) == pytest.approx(sum(before.values()), abs=10)
    assert max(after[s] / before[s] for s in before) <= 2.0 + 0.02
    reads = Counter(r.doc_id for r in out)
    assert {r.epoch for r in out} <= {0, 1} and max(reads.values()) <= 2
    again = M.mix_sources(df.repartition(3), max_repeat=2.0, budget_ratio=1.0, block_docs=16).collect()
    assert sorted((r.doc_id, r.epoch) for r in again) == sorted((r.doc_id, r.epoch) for r in out)


def test_edges(spark):
    schema = "doc_id long, source string, text string, epoch2 int"
    assert M.mix_sources(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a", None, 0), (2, "a", "", 0), (3, None, "x y", 0), (None, "b", "x y", 0), (3, None, "x y", 0), (4, "b", "z " * 100_000, 0)]
    out = M.mix_sources(spark.createDataFrame(rows, schema), max_repeat=1.0)
    assert out.columns == ["doc_id", "source", "text", "epoch2", "epoch"]
    assert Counter(r.doc_id for r in out.collect()) == Counter({1: 1, 2: 1, 3: 2, None: 1, 4: 1})


def test_query(spark):
    out = M.op6_mixing(spark, "/root/testdata/sf0.001")
    docs_ = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = docs_.agg(F.sum(M.token_count(F.col("text")))).first()[0]
    assert out.agg(F.sum("n_tokens")).first()[0] == pytest.approx(tokens, rel=0.2)
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
