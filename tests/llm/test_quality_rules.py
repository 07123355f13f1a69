from __future__ import annotations

import re

import pytest

from tests.oracle import assert_same, connect
from tidepanel.llm import quality_rules as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")


def brute(t):
    t = t or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", "  \n ", "one", "a b c d e a b c d e", "a b c d e f a b c d e g a b c d e", "x " * 30, "é ü " * 12, "l1\nl1\n\n \nl2\nl1", "# * $ | a\tb\x0bc\r\nd",
    "    nbsp", "😀 😀 😀 😀 😀 😀 😀", "a b c d e f g h i j k l m n o p " * 3, "w" * 100_000, " ".join(f"w{i % 700}" for i in range(1500)),
]


def test_measurements(spark):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.measurements(docs(spark, TEXTS)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_policy_and_ablations(spark):
    rules = Q.standard_rules()
    rows = Q.ledger(Q.measurements(docs(spark, [*TEXTS, " ".join(f"word{i}" for i in range(50))])), rules)
    kept = {r.doc_id for r in Q.apply_policy(rows, rules, "v1").where("kept").collect()}
    assert len(TEXTS) in kept and 0 not in kept
    by_rule = {r.rule: r for r in Q.ablations(rows, rules, "v1").collect()}
    assert set(by_rule) == set(Q.POLICIES["v1"])
    for name, r in by_rule.items():
        bit = Q.mask(rules, (name,))
        masks = [x.failed_bits for x in rows.collect()]
        assert r.n_failed == sum(bool(m & bit) for m in masks) and r.n_failed_alone == sum(m == bit for m in masks) and r.n_kept_without == sum(m in (0, bit) for m in masks)


def test_empty_table_and_no_python(spark):
    assert Q.measurements(docs(spark, ["a"]).limit(0)).count() == 0
    rules = Q.standard_rules()
    for df in (Q.op2_quality_rules(spark, "/root/testdata/sf0.001"), Q.ledger(Q.measurements(docs(spark, ["a"])), rules)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_matches_sql(spark, sf):
    assert_same(Q.quality_ablations(spark, f"/root/testdata/{sf}"), connect(f"/root/testdata/{sf}"), Q.ABLATIONS_ORACLE)
    assert_same(Q.op2_quality_rules(spark, f"/root/testdata/{sf}"), connect(f"/root/testdata/{sf}"), Q.ORACLE)
