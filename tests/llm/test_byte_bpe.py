from __future__ import annotations

import base64
import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidepanel.llm import byte_bpe as B

SF = "/root/testdata/sf0.01"
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return B.ranks_of(B.default_ranks())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(ranks.whole), special_tokens={})


def random_text(rng, size):
    pieces = ["a", "aa", "the", " ", "  ", "\t", "\n", "'s", "'", "ll", "'ll", "é", "中", "😀", "1", "23", "...", "<|endoftext|>", " über", " ", " ", "x" * 30, "0" * 20, "ab" * 9]
    return "".join(rng.choice(pieces) for _ in range(size))


def test_as_the_library_encodes(ranks, library):
    rng = random.Random(1)
    for _ in range(4000):
        t = random_text(rng, rng.randint(0, 30))
        assert [i for m in B.splitter(PATTERN)(t) for i in ranks.encode(m.encode())] == library.encode_ordinary(t), t
    for alphabet in ("ab", "aeinrst", "01", " a", "éà中"):
        for _ in range(300):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80)))
            assert [i for m in B.splitter(PATTERN)(t) for i in ranks.encode(m.encode())] == library.encode_ordinary(t), t


def test_every_code_point_is_split_as_the_library_splits(ranks):
    """A pair of bytes merges only within a match, so the library's classes of characters show in what it merges."""
    merges = {bytes([i]): i for i in range(256)}
    for pair in (bytes([a, b]) for a in range(256) for b in b"a1!"):
        merges.setdefault(pair, len(merges))
    own = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    odd = B.unsettled()[1]
    split, characters = B.splitter(PATTERN), [chr(p) for p in (*range(0xD800), *range(0xE000, sys.maxunicode + 1)) if p < 0x3400 or p % 11 == 0 or p in odd]
    for at in range(0, len(characters), 64):  # asked for in blocks: each character is between a letter, a number, a mark and spaces
        t = "\n".join(f"{c}a{c}1{c}!{c} {c}" for c in characters[at : at + 64])
        assert own.encode_ordinary(t) == [i for m in split(t) for i in own._core_bpe.encode_single_piece(m.encode())], hex(ord(characters[at]))


def test_ascii_texts_are_split_alike():
    import regex

    rng, plain = random.Random(9), B.ascii_twin(PATTERN)
    for _ in range(20_000):
        t = "".join(chr(rng.choice((rng.randrange(128), 32, 32, 10, 39, 115, 116))) for _ in range(rng.randint(0, 12)))
        assert plain.findall(t) == regex.findall(PATTERN, t), t
    assert B.ascii_twin(r"\p{Lu}+|.") is None and B.ascii_twin(r"\w+") is None


def test_a_rank_file_with_unreachable_tokens(tmp_path):
    """Tokens that merges do not lead to are given only for a match that is such a token."""
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b"xyz", b"aa", b"aaa", b"aaaa", b"bcd"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    ranks = B.Ranks(str(path))
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(ranks.whole), special_tokens={})
    rng = random.Random(2)
    for t in ["xyz", "xyzz", "bcd", "abcd"] + ["".join(rng.choice("abcdxyz") for _ in range(rng.randint(1, 14))) for _ in range(4000)]:
        assert ranks.encode(t.encode()) == own.encode_ordinary(t), t


def test_a_long_match_takes_linear_time(ranks, library):
    t = "".join(random.Random(3).choice("abcdefghijklmnop") for _ in range(200_000))
    assert ranks.encode(t.encode()) == library.encode_ordinary(t)


def test_append_and_edit_equal_encoding_anew(ranks):
    rng = random.Random(5)
    for _ in range(1500):
        t = random_text(rng, rng.randint(0, 25))
        made, more = B.PrefixTable(ranks, PATTERN, t), random_text(rng, rng.randint(0, 5))
        made.append(more)
        fresh = B.PrefixTable(ranks, PATTERN, t + more)
        assert (made.last, made.starts, made.ids(), made.text) == (fresh.last, fresh.starts, fresh.ids(), t + more)
        t, new = t + more, random_text(rng, rng.randint(0, 3))
        i = rng.randint(0, len(t))
        j = min(len(t), i + rng.randint(0, 6))
        made.edit(len(t[:i].encode()), len(t[:j].encode()), new.encode())
        fresh = B.PrefixTable(ranks, PATTERN, t[:i] + new + t[j:])
        assert (made.last, made.starts, made.ids()) == (fresh.last, fresh.starts, fresh.ids()), (t, i, j, new)


def test_only_what_is_near_a_change_is_encoded(ranks):
    words = " ".join(f"word{i}" for i in range(5000))
    made = B.PrefixTable(ranks, PATTERN, words)
    made.append(" and more")
    assert made.filled < 60
    made.edit(2000, 2003, b"new")
    assert made.filled < 80
    one = "".join(random.Random(6).choice("abcdefgh") for _ in range(20_000))  # a single match
    made = B.PrefixTable(ranks, PATTERN, one)
    made.edit(10_000, 10_002, b"xyz")
    assert made.filled < 10 * ranks.longest
    assert made.last == B.PrefixTable(ranks, PATTERN, one[:10_000] + "xyz" + one[10_002:]).last
    made.append("tail")
    assert made.filled <= 4 and made.ids() == B.PrefixTable(ranks, PATTERN, made.text).ids()


def test_tables_as_columns(spark, ranks, library):
    rows = [(1, "some words here", " and more", 5, 5, "WORDS"), (2, None, "x", 0, 3, None), (3, "", None, 9, 1, "é"), (3, "", None, 9, 1, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string, at int, n int, new string")
    tables = B.prefix_tables(df).join(df.drop("text").distinct(), "doc_id")
    more = {r.doc_id: r for r in B.append(tables, "more").collect()}
    assert {k: r.text for k, r in more.items()} == {1: "some words here and more", 2: "x", 3: ""}
    edited = {r.doc_id: r for r in B.edit(tables, "at", "n", "new").collect()}
    assert {k: r.text for k, r in edited.items()} == {1: "some WORDS here", 2: "", 3: "é"}
    for r in [*more.values(), *edited.values()]:
        assert list(r.ids) == library.encode_ordinary(r.text) and len(r["last"]) == len(r.text.encode())


def test_round_trip_with_extra_columns(spark, library):
    rows = [(i, t, "kept") for i, t in enumerate([None, "", " ", "a\n\nb  c", "<|endoftext|>", "é 中文 😀", "'S it's"])] + [(0, None, "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string").withColumnRenamed("decoded", "__last")
    out = B.decode(B.encode(df)).collect()
    assert len(out) == 8 and all(bytes(r.decoded).decode() == (r.text or "") and list(r.ids) == library.encode_ordinary(r.text or "") and r["__last"] == "kept" for r in out)
    assert B.decode(B.encode(df.limit(0), packed=True)).count() == 0


def test_query_against_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = B.op12_byte_bpe(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.lossless
