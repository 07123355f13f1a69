from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.oracle import assert_same, connect
from tidepanel.llm import jaccard_join as J

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def corpus(seed, n_near=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    sent = lambda n: [word() for _ in range(n)]
    passage = sent(40)
    out = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "a B c d e"]
    for size in (6, 9, 20, 80, 300, 1200):
        base = sent(size)
        for k in range(8):
            t = list(base)
            for _ in range(k * max(1, size // 40)):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    base = sent(120)
    for _ in range(n_near):  # one large group, links of every strength
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = word()
        out.append(" ".join(t))
    out += [" ".join(sent(rng.randint(0, 60)) + passage + sent(rng.randint(0, 60))) for _ in range(30)]
    out += [out[20]] * 5 + [out[30].upper()]
    return list(enumerate(out))


@pytest.mark.parametrize("seed,crowd,block", [(1, 64, 256), (3, 1, 4)])
def test_against_brute_force(spark, seed, crowd, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int").repartition(4)
    got = J.jaccard_components(df, crowd=crowd, block_sets=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def random_pair(rng, size):
    a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
    drop = int(rng.integers(0, size // 4 + 1))
    cut = rng.permutation(a)[drop:]
    b = np.unique(np.concatenate([cut, rng.integers(0, 1 << 63, int(rng.integers(0, size // 3 + 1))).astype(np.uint64)]))
    return a, b, 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 9, 12, 17, 24, 40, 64, 100, 300, 1000, 5000])
def test_similar_sets_agree_in_more_partitions_than_either_spares(size):
    rng = np.random.default_rng(size)
    seen = 0
    for _ in range(60):
        a, b, similar = random_pair(rng, size)
        t, ends, left = J.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        shared = np.intersect1d(t[: ends[1]], t[ends[1] :])
        if similar:
            seen += 1
            part = shared & np.uint64(J.PART)
            enough = [len(np.unique(part[(part != J.PART) & (part >> np.uint64(J.PART_BITS - 1) == k)])) > max(left[0, k], left[1, k]) >= 0 for k in (0, 1)]
            assert any(enough) or (part == J.PART).any()
    assert seen


@pytest.mark.parametrize("size", [1, 3, 10, 100, 3000])
def test_histograms_leave_room_for_every_similar_pair(size):
    rng = np.random.default_rng(size)
    for _ in range(40):
        a, b, similar = random_pair(rng, size)
        assert J.may_be_similar(J.histogram(a), J.histogram(b), len(a) + len(b)) or not similar
    a, b = (rng.integers(0, 1 << 63, 2000).astype(np.uint64) for _ in range(2))
    assert not J.may_be_similar(J.histogram(a), J.histogram(b), 4000)
    full = bytes([255]) + bytes(15)
    assert J.may_be_similar(full, J.histogram(a), 4000)


def test_signatures_are_subsets_of_parts_and_differ_by_band():
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2))
    t, ends, left = J.signatures(np.zeros(100, np.int64), a, 1)
    k, k2, n2, spare, n1 = J.PARAMETERS[np.searchsorted(J.BANDS, 100)]
    assert all(p[4] == p[0] // (p[1] + 1) + 1 + p[3] for p in J.PARAMETERS) and tuple(J.PARAMETERS[np.searchsorted(J.BANDS, 1000)][1:3]) == (0, 1)
    assert (k2, n2) == (1, 3) and (left >= 0).all() and len(t) == ends[1] and len(np.unique(t)) == len(t)
    both = [len(np.unique(t[(t >> np.uint64(J.PART_BITS - 1)) & np.uint64(1) == p])) for p in (0, 1)]
    assert all(0 < n <= 3 * n1 for n in both)


def test_common_counts_are_exact_beyond_single_precision():
    n = 700_000
    h = np.arange(n, dtype=np.uint64)
    both = np.concatenate([h, h[: n * 3 // 4]])
    owner = np.repeat([0, 1], [n, n * 3 // 4])
    assert J._block_links(owner, both, np.array([n, n * 3 // 4])) == [(0, 1)]
    assert J._block_links(owner[:-1], both[:-1], np.array([n, n * 3 // 4 - 1])) == []


@pytest.mark.parametrize("parts,options", [(60, {}), (3, {"crowd": 5, "block_sets": 16, "pivots": 2})])
def test_a_signature_that_all_documents_hold(spark, parts, options):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} a{i} b{i} c{i % 7}") for i in range(90)] + [(100 + i, f"x{i} y{i} {passage} " + " ".join(f"z{i}q{j}" for j in range(40))) for i in range(90)]
    rows += [(500, " ".join(f"z3q{j}" for j in range(40)) + " tail"), (501, " ".join(f"z3q{j}" for j in range(40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted(tuple(r) for r in J.jaccard_components(df, **options).collect()) == brute(rows)


def test_hot_signatures_stay_in_one_row_a_set(spark, monkeypatch):
    """A set meets its own hot signatures once, as one row; what crowded sets keep grows with their number, not with its square."""
    kept, write = {}, J.materialise

    def keep(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(J, "materialise", keep)
    per_set = []
    for copies in (20, 60):
        kept.clear()
        rows = [(i, " ".join(f"w{j}" for j in range(120)) + f" end{i}") for i in range(copies)]
        got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), crowd=5)
        assert {r.component_id for r in got.collect()} == {0}
        assert kept["spare"].count() == 3 * copies and kept["spare"].where("used is not null").count() >= copies
        per_set.append(kept["crowded"].count() / copies)
    assert per_set[0] > 0 and per_set[1] == pytest.approx(per_set[0], rel=0.05)


def test_rows_that_share_an_id_are_one_document(spark):
    w = " ".join(f"w{i}" for i in range(30))
    v = " ".join(f"v{i}" for i in range(30))
    rows = [(1, w), (2, w + " x"), (2, v), (3, v + " y"), (4, v), (None, w), (None, "a b")]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 26, 1), (2, 27, 1), (2, 26, 1), (3, 27, 1), (4, 26, 1), (0, 26, 1), (0, 1, None)], key=str)


def test_empty_table_keep_one_and_long_text(spark):
    schema = "doc_id long, text string, lang string"
    assert J.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "a"), (2, long + " x", "b"), (3, None, "c"), (4, None, "d"), (None, "q r s", "e")], schema)
    kept = J.keep_one(df)
    assert kept.columns == ["doc_id", "text", "lang"] and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4]


def test_query_matches_sql(spark):
    assert_same(J.op9_jaccard_join(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), J.ORACLE)
