from __future__ import annotations

import math
import random

import numpy as np

from tests.oracle import assert_same, connect
from tidepanel.llm import hard_negatives as H

SF = "/root/testdata/sf0.01"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100, k=5, low=80, high=100):
    """rows: (id, label, whole components); repeated ids are rows each."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        others = sorted((-dot(v, w), j, lab) for j, lab, w in rows if j != i)
        for s, p, _ in [o for o in others if o[2] == label][:k]:
            inside = [o for o in others if o[2] != label and low * -s <= 100 * -o[0] <= high * -s]
            out += [(i, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside[:k], 1)]
    return sorted(out)


def vectors(seed, n, width, size, labels=3):
    rng = random.Random(seed)
    return [(i, rng.choice([0] * labels + list(range(labels))), [rng.randint(-size, size) for _ in range(width)]) for i in range(n)]


def test_intervals_drop_nothing_that_qualifies():
    rng = np.random.default_rng(1)
    for width, size in ((1, 3), (8, 300), (64, 300), (5, 2**20), (3, 2**27)):
        a, r = rng.integers(-size, size + 1, (40, width)), rng.integers(-size, size + 1, (500, width))
        exact, wanted = a @ r.T, rng.random((40, 500)) < 0.9
        low, high = np.full((40, 1), -np.inf), np.full((40, 1), np.inf)
        at, row, score = H.surviving(a, r, wanted, low, high, 5)
        assert (score == exact[at, row]).all()
        for i in range(40):
            best = np.sort(exact[i][wanted[i]])[-5]
            assert set(np.flatnonzero(wanted[i] & (exact[i] >= best))) <= set(row[at == i])
        low = np.quantile(exact, [0.9, 0.5], axis=1).T.round()
        high = low + np.abs(low) * 0.1
        at, row, score = H.surviving(a, r, wanted, low, high, 5)
        inside = wanted & ((exact[:, :, None] >= low[:, None]) & (exact[:, :, None] <= high[:, None])).any(axis=2)
        assert sorted(zip(at.tolist(), row.tolist(), strict=True)) == [tuple(x) for x in np.argwhere(inside)] and (score == exact[at, row]).all()


def test_most_pairs_are_dropped_before_the_last_plane():
    rng = np.random.default_rng(2)
    a, r = rng.normal(0, 25, (200, 64)).astype(np.int64), rng.normal(0, 25, (2000, 64)).astype(np.int64)
    at, _, _ = H.surviving(a, r, np.ones((200, 2000), bool), np.full((200, 1), -np.inf), np.full((200, 1), np.inf), 5)
    assert len(at) < 0.01 * 200 * 2000


def test_sums_beyond_64_bits_raise():
    a = np.full((1, 4), 2**40)
    try:
        H.exact_type(a, a)
    except ValueError:
        return
    raise AssertionError


def test_against_brute_force(spark):
    rows = vectors(1, 900, 6, 300) + [(100, 1, [5, 5, 5, 5, 5, 5]), (401, 0, [300] * 6), (401, 0, [300] * 6), (402, 1, [300] * 6)] + [(901 + i, 1, [100] * 6) for i in range(40)] + [(1000, 0, []), (1100, 2, [9] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(7)
    out = H.mine(df, df.where("vec_id % 100 = 0"), chunk=4)
    assert out.columns == COLUMNS
    # an id of two anchors: results of both
    assert sorted(map(tuple, out.collect())) == brute(rows)
    wide = H.mine(df, df.where("vec_id % 100 = 0"), k=3, low=50, high=90)
    assert sorted(map(tuple, wide.collect())) == brute(rows, k=3, low=50, high=90)


def test_cases(spark):
    rows = [(0, 1, [0.5, -0.25]), (1, 1, [0.5, 0.1]), (2, 2, [0.49, -0.25]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [math.nan, 1.0]), (8, 2, [math.inf, 1.0]), (None, 2, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, anchor string")
    whole = H.integer_vectors(df)
    assert {(r.vec_id, tuple(r.v)) for r in whole.collect()} == {(0, (128, -64)), (1, (128, 25)), (2, (125, -64))}
    assert [tuple(r) for r in H.mine(whole, whole.where("vec_id = 1")).collect()] == [(1, 0, 1, 2, 128 * 128 - 64 * 25, 125 * 128 - 64 * 25)]
    assert H.mine(whole.limit(0), whole.limit(0)).count() == 0 and H.mine(whole, whole.where("vec_id = 2")).count() == 0


def test_query_matches_sql(spark):
    assert_same(H.op11_hard_negatives(spark, SF), connect(SF), H.ORACLE)
