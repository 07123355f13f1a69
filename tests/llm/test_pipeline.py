from __future__ import annotations

import corpus_pipeline as C
from tests.llm.test_jaccard_join import brute as components
from tidepanel.llm import language_id, pieces
from tidepanel.llm.common import materialise

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_each_others_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        assert docs.columns == (COLUMNS if name != "sentencepiece" else ["doc_id", "lang", "source", "piece_ids", "n_pieces"])
    first = {r.doc_id: r.text for r in kept["language_id"]}
    assert all(language_id.has_letter(t) for t in first.values()) and len(first) >= 195
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    stay: dict = {}
    for i, t in first.items():
        stay[low(t)] = max(i, stay.get(low(t), -1))
    assert {r.doc_id for r in kept["exact_dedup"]} == set(stay.values())
    near = components([(r.doc_id, r.text) for r in kept["exact_dedup"]])
    assert {r.doc_id for r in kept["near_dedup"]} == {i for i, _, c in near if i == c}
    reads = [r.doc_id for r in kept["mixing"]]
    assert set(reads) == {r.doc_id for r in kept["near_dedup"]} and max(map(reads.count, reads)) <= 2
    v = pieces.Vocabulary(pieces.default_model())
    assert sorted(r.doc_id for r in kept["sentencepiece"]) == sorted(reads)
    assert all(v.decode(r.piece_ids) == first[r.doc_id] and r.n_pieces == len(r.piece_ids) for r in kept["sentencepiece"])


def test_extra_and_clashing_columns_and_nulls(spark):
    rows = [(1, "the cat is here", "en", "a", 3, "x", "y"), (2, None, "en", None, None, None, None), (2, "der hund ist da", "de", None, 4, "x", "y"), (3, "the cat is here", None, "b", 3, "q", None), (4, "123", "en", "a", 3, "", ""), (5, "", "de", "a", 0, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, epoch string")
    for name, stage in C.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.columns == [*COLUMNS, "score", "epoch"]
    assert {r.doc_id for r in docs.collect()} == {2, 3}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
    assert docs.count() == 0
