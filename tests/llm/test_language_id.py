from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidepanel.llm import language_id as L


def test_held_out_accuracy_and_fold(spark):
    rows = L.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01 and all(0 <= r.score <= 1 for r in rows)


def model():
    en, de = ["the cat and the dog are in the house with them"] * 30, ["der hund und die katze sind in dem haus mit ihnen"] * 30
    return L.train(en + de, ["en"] * 30 + ["de"] * 30, steps=2000)


def test_edge_texts():
    labels, scores, rejected = model().predict([None, "", "123 !?", "the dog", "der Hund", "的", "the " * 700_000])
    assert labels[:3] == ["und"] * 3 and scores[:3].tolist() == [0, 0, 0] and rejected[:3].all()
    assert labels[3:5] == ["en", "de"] and labels[6] == "en"


def test_letters_are_unicode_letters():
    assert [L.has_letter(t) for t in (None, "", "½ ² ① Ⅷ 12_", "½a", "的", "ª", "é")] == [False, False, False, True, True, True, True]
    labels, scores, rejected = model().predict(["½ ①", "Ⅷ 4"])
    assert labels == ["und", "und"] and scores.tolist() == [0, 0] and rejected.all()


def test_texts_that_share_an_id_train_repeatably(spark):
    docs = spark.createDataFrame([(1, f"the number {i}", "en") for i in range(60)] + [(2, "der hund", "de")], "doc_id long, text string, lang string")
    a, b = L.fit(docs, F.lit(True), steps=50), L.fit(docs.repartition(5), F.lit(True), steps=50)
    assert np.array_equal(a.weights, b.weights)


def test_score_does_not_depend_on_the_batch():
    m = model()
    texts = ["the dog", "der hund", "cat and house " * 1000, "x"]
    together = m.logits(texts)
    alone = np.concatenate([m.logits([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    long = "the cat " * 200_000
    assert np.allclose(m.logits([long], step=1000), m.logits([long], step=1 << 30), atol=1e-4)


def test_prediction_uses_the_text_only_and_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the dog", "zz", "s", 7), (1, "the dog", None, "t", 8), (2, None, "en", None, 9)], "doc_id long, text string, lang string, source string, n int")
    out = L.predict(docs, model(), keep=["doc_id", "text", "lang", "n"]).collect()
    assert [(r.n, r.lang_pred) for r in sorted(out, key=lambda r: r.n)] == [(7, "en"), (8, "en"), (9, "und")]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    m = L.fit(docs, F.lit(True))
    assert [r.lang_pred for r in L.predict(docs, m).collect()] == ["und"]
    assert L.predict(docs.limit(0), m).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(i, f"the number {i}", "en") for i in range(300)], "doc_id long, text string, lang string")
    a, b = L.fit(docs, F.lit(True), sample=20, steps=50), L.fit(docs.repartition(7), F.lit(True), sample=20, steps=50)
    assert np.array_equal(a.weights, b.weights)


def test_long_text_of_wide_characters_behind_a_short_one():
    m = model()
    texts = ["the dog", "的是在有 " * 200_000, "der hund"]
    got = m.logits(texts)
    assert len(got) == 3 and np.allclose(got, np.concatenate([m.logits([t]) for t in texts]), atol=1e-4)
    assert m.predict(texts)[0][::2] == ["en", "de"]
    small = ["the dog", "的" * 36]
    assert np.allclose(m.logits(small, step=50), np.concatenate([m.logits([t]) for t in small]), atol=1e-5)
