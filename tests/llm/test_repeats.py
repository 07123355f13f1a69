from __future__ import annotations

import hashlib
import random

import pytest

from tidepanel.llm import repeats as R


def brute(texts, width=200):
    parts = [(t or "").encode() for t in texts]
    seen, again = set(), set()
    for p in parts:
        for i in range(len(p) - width + 1):
            (again if p[i : i + width] in seen else seen).add(p[i : i + width])
    out = []
    for p in parts:
        cover = bytearray(len(p))
        for i in range(len(p) - width + 1):
            if p[i : i + width] in again:
                cover[i : i + width] = b"\1" * width
        runs = sum(1 for i in range(len(p)) if cover[i] and (not i or not cover[i - 1]))
        out.append((len(p), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(p, cover) if not c)).hexdigest()))
    return out


def text(rng, n, alphabet="abcdefghij klmnop"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    shared = [text(rng, n) for n in (150, 199, 200, 201, 350, 900)]
    out = [None, "", "x" * 199, "x" * 200, "y" * 700, "ab" * 300, "é" * 150]
    for k in range(60):
        t = text(rng, rng.randint(0, 500)) + rng.choice(shared) + text(rng, rng.randint(0, 500))
        out.append(t + (rng.choice(shared) if k % 3 == 0 else ""))
    base = text(rng, 1500)
    for _ in range(8):  # near copies
        t = list(base)
        for _ in range(4):
            t[rng.randrange(len(t))] = "Z"
        out.append("".join(t))
    return [*out, out[20], out[20], "z" + out[21]]


@pytest.mark.parametrize("seed,crowd", [(1, 20_000), (2, 1), (3, 20_000)])
def test_against_brute_force(spark, seed, crowd):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, gh string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in R.remove_repeats(df, crowd=crowd).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_rows_that_share_an_id_and_null_ids(spark):
    rng = random.Random(9)
    a, b = text(rng, 400), text(rng, 400)
    df = spark.createDataFrame([(1, a), (1, b), (None, a), (2, b[:300]), (5, "short")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans) for r in R.remove_repeats(df).collect())
    assert got == [(0, 400, 400, 1), (1, 400, 300, 1), (1, 400, 400, 1), (2, 300, 300, 1), (5, 5, 0, 0)]


def test_empty_table(spark):
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.op7_repeats(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])
