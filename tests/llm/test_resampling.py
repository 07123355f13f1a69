from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidepanel.llm import resampling as R

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=2, buckets=10_000, seed=7, share=25, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in runs(t, n))
    t = Counter(bucket(f) for x in target for f in runs(x, n))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, text in docs:
        f = runs(text, n)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def key(r):
    return tuple(math.inf if v is None else v for v in r)


def test_shifts_compose_checksums():
    rng = random.Random(1)
    for size in (0, 1, 2, 7, 8, 63, 200, 5000, 70_001):
        a, b = rng.randbytes(rng.randint(0, 50)), rng.randbytes(size)
        got = R.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([size]))[0] ^ np.uint32(zlib.crc32(b))
        assert int(got) == zlib.crc32(a + b)


def test_features_are_checksums_of_the_joined_words():
    rng = random.Random(2)
    parts = ["a", "Bc", "é", "中文", "É", "x" * 63, "y" * 64, "z" * 65, "w" * 3000, "0", " ", "\n", ".", "_", "\x7f", "\x00", "{", "😀"]
    texts = [None, "", "one"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["tail", None]
    for n in (1, 2, 4):
        for column, want in ((pa.array(texts), texts), (pa.array(texts).slice(2, 5), texts[2:7]), (pa.array([None, ""]), [None, ""]), (pa.array([], pa.string()), [])):
            n_words, bucket, doc = R.features(column, n, 997)
            assert n_words.tolist() == [len(words(t)) for t in want]
            assert Counter(zip(doc.tolist(), bucket.tolist(), strict=True)) == Counter((i, zlib.crc32(f.encode()) % 997) for i, t in enumerate(want) for f in runs(t, n))


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, "a " * 30), (None, None), (900, None), (901, ""), (902, "q" * 100_000), (903, "A a " * 20_000)]
    target = ["w1 w2 w3 w1 w2", None, "W3 w4", ""]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, bucket string").repartition(5)
    want = sorted(brute(docs, target, n=3, buckets=500, share=40, min_words=5), key=key)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    out = R.resample(df, wanted, n=3, buckets=500, share=40, min_words=5)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=key) == want
    assert R.resample(df.limit(0), wanted).count() == 0
    assert sorted((r.weight for r in R.resample(df, wanted.limit(0)).collect())) == sorted(r[2] for r in brute(docs, []))


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).select(F_id(), (F_col("id") % 7).alias("score"), (F_col("id") % 3).alias("n")).repartition(40)
    got = sorted((r["rank"], r.score, r.doc_id) for r in R.ranked(rows, 30, "n > 0").collect() if r["rank"])
    able = sorted((-(i % 7), i) for i in range(5000) if i % 3)
    assert got == [(k, -s, i) for k, (s, i) in enumerate(able[: 30 * len(able) // 100], 1)]


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def F_id():
    return F_col("id").alias("doc_id")


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    out = R.op13_importance_resampling(spark, SF).collect()
    assert sorted(map(tuple, out), key=key) == sorted(brute(docs, target), key=key)
