from __future__ import annotations

import collections
import math

import numpy as np
import pytest

from tidepanel.llm import pieces as P

TEXTS = [None, "", " ", "a", "  a▁b\n\n x  ", "日本語 Ⅷ\t\x00", "a" * 30_000, "x " * 20_000, "The cat sat.\r\nOn it", "日" * 2000, "😀é"]


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary(P.default_model())


def sample(v, texts, keys=None, **kw):
    return P.sample_ids(v, texts, np.array(keys if keys is not None else range(len(texts)), np.int64), 1, **kw)


def test_decoding_is_lossless(vocabulary):
    ids = sample(vocabulary, TEXTS)
    assert vocabulary.decode_all(ids).to_pylist() == TEXTS
    assert [None if x is None else vocabulary.decode(x) for x in ids.to_pylist()] == TEXTS


def test_same_row_same_pieces_in_any_batch(vocabulary):
    whole = sample(vocabulary, TEXTS).to_pylist()
    for i, t in enumerate(TEXTS):
        assert sample(vocabulary, [t], [i]).to_pylist() == [whole[i]]
    assert sample(vocabulary, TEXTS, step=10).to_pylist() == whole
    assert len(set(map(tuple, sample(vocabulary, ["the segmentation of interesting words"] * 200).to_pylist()))) > 1


def all_paths(v, text):
    """Every segmentation with its weight, by brute force."""
    if not text:
        return {(): 1.0}
    out = collections.defaultdict(float)
    for n in range(1, min(len(text), v.longest) + 1):
        if text[:n] in v.ids:
            i = v.ids[text[:n]]
            for rest, w in all_paths(v, text[n:]).items():
                out[(i, *rest)] += v.weight[i] * w
    return out


def test_draws_follow_the_weights(vocabulary):
    paths = all_paths(vocabulary, " stone")
    total = sum(paths.values())
    n = 20_000
    got = collections.Counter(map(tuple, sample(vocabulary, ["stone"] * n, range(n)).to_pylist()))
    assert set(got) <= set(paths)
    for path, w in paths.items():
        p = w / total
        assert abs(got[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_operators_on_tables(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(3, "a", "again")], "doc_id long, text string, piece_ids string").withColumnRenamed("piece_ids", "ids")
    enc = P.encode_sampled(docs)
    assert enc.columns == ["doc_id", "text", "ids", "piece_ids"]
    out = P.decode(enc).collect()
    assert all(r.decoded == r.text for r in out) and len(out) == len(TEXTS) + 1
    same = [r.piece_ids for r in out if r.doc_id == 3]
    assert same[0] == same[1]
    best = P.decode(P.encode_best(docs.where("doc_id = 8"))).first()
    assert best.decoded == best.text
    assert P.encode_sampled(docs.limit(0)).count() == 0


def test_query(spark):
    out = P.op5_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 200 and all(r.lossless and r.n_pieces == len(r.piece_ids) for r in out)
