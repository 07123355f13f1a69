"""Byte-level BPE encoding and decoding (operator 12): prefix dynamic programming.

A text is split by a pattern; each match is encoded by itself. For every byte prefix of a match there is exactly one token that can end its encoding: token t ends the
prefix of length e if the last token of the prefix of length e - len(t) and t stay apart under the merges. A table of these last tokens is filled left to right and read backwards for
the encoding; it needs no queue of merges and takes linear time. Whether two tokens stay apart is decided by undoing their merges from the latest to the earliest:
they do not if at some time the two parts at the seam form a token of a lower rank than the merge undone last.

The table is what makes changes cheap. Text put behind a text extends it (`append`), as earlier prefixes do not change; behind an edit (`edit`) the old table holds again from where
matches of the pattern meet old ones (splitting goes to the end of the text, encoding does not), or inside one match from where as many last tokens agree as the longest token has bytes.

Cases: null text counts as empty (no tokens, no bytes); empty texts have no tokens; special tokens do not exist, their strings are ordinary text; a match that is a token as a whole is that token, even if
no merges lead to it; long texts and matches are walked whole; repeated rows give repeated results; an empty table stays empty; other columns stay only if asked for, under their names
(`keep`), and may have any name but those that are added. Ids of tables are their ranks. Decoding an unknown id fails.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import env_path, table

_NEVER = 1 << 40


def default_ranks() -> str:
    """Path of the rank file; TIDEPANEL_RANKS overrides it."""
    import public_tokenizers

    return env_path("TIDEPANEL_RANKS", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Ranks:
    """Tokens by rank, the two parts that each merges from, and the tokens that merges reach."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.whole = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {rank: token for token, rank in self.whole.items()}
        self.by_rank = np.empty(max(self.bytes_of) + 1, object)
        for rank, token in self.bytes_of.items():
            self.by_rank[rank] = token
        self.longest = max(map(len, self.whole))
        single = {token: rank for token, rank in self.whole.items() if len(token) == 1}
        if len(single) != 256:
            raise ValueError("a rank file needs all 256 bytes")
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.apart: dict[int, bool] = {}
        self.size = {rank: len(token) for token, rank in self.whole.items()}
        self.ends = dict(single)  # all ends of tokens, -1 where they are none: what is not here, no longer token ends with either
        for token, rank in sorted(self.whole.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            found = self.tokens(token, self.extend(token, []))
            if len(found) == 2:  # else no merges of lower ranks lead to it
                self.parts[rank], self.pairs[found[0], found[1]], self.ends[token] = (found[0], found[1]), rank, rank
                for i in range(1, len(token)):
                    self.ends.setdefault(token[i:], -1)
                self.apart.clear()
        self.words = _Words(self)

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are left as they are. At equal ranks the merge further left comes first."""
        until = _NEVER
        while True:
            if self.pairs.get((left, right), _NEVER) < until:
                return False
            whole_left, whole_right = left in self.parts, right in self.parts
            if not whole_left and not whole_right:
                return True
            if whole_left and (not whole_right or left > right):
                until, left = left, self.parts[left][1]
            else:
                until, right = right + 1, self.parts[right][0]

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Fills the table of a match from its known prefixes (len(last)) on, up to a length. Returns the table."""
        ends, size, apart = self.ends, self.size, self.apart
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            found = []  # tokens that end here, the longest last
            for start in range(end - 1, -1, -1):
                token = ends.get(data[start:end])
                if token is None:
                    break
                if token >= 0:
                    found.append(token)
            # one of them is the last token; the longest is the likeliest
            while True:
                token = found.pop()
                start = end - size[token]
                if start == 0 or not found:
                    break
                seam = last[start - 1] << 24 | token
                free = apart.get(seam)
                if free is None:
                    free = apart[seam] = self.stay_apart(last[start - 1], token)
                if free:
                    break
            last.append(token)
        if len(apart) > 400_000:
            apart.clear()
        return last

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding that a whole table holds."""
        out, at = [], len(data)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode(self, match: bytes) -> list[int]:
        token = self.whole.get(match)
        return [token] if token is not None else self.tokens(match, self.extend(match, []))


class _Words(dict):
    """Encoded matches by their text, as little-endian unsigned 32-bit integers. Only short ones are kept, and so many at most; this bounds memory and changes no result."""

    def __init__(self, ranks: Ranks, chars: int = 40, most: int = 400_000) -> None:
        self.ranks, self.chars, self.most = ranks, chars, most

    def __missing__(self, match: str) -> bytes:
        return np.array(self.ranks.encode(match.encode()), "<u4").tobytes()

    def learn(self, matches: set[str]) -> None:
        """Encodes the new ones in order, so that each goes on from the table of the prefix that it shares with the one before."""
        new = sorted(m for m in matches.difference(self) if len(m) <= self.chars)
        if len(self) + len(new) > self.most:
            for old in list(self)[: max(len(new), self.most // 2)]:
                del self[old]
        before, last, ranks = b"", [], self.ranks
        for match in new:
            data = match.encode()
            same = 0
            for x, y in zip(before, data, strict=False):
                if x != y:
                    break
                same += 1
            del last[same:]
            ranks.extend(data, last)
            token = ranks.whole.get(data)
            self[match] = np.array([token] if token is not None else ranks.tokens(data, last), "<u4").tobytes()
            before = data


@cache
def ranks_of(path: str) -> Ranks:
    """Built once in a worker."""
    return Ranks(path)


#: A letter, a number and an other character of all versions of Unicode, none of them part of a contraction.
_LIKE = {"a": "\u00e9", "1": "\u00b2", "!": "\uffff"}


@cache
def unsettled() -> tuple[np.ndarray, dict[int, str]]:
    """Characters that this regex library takes for letters or numbers and the encoding library, of another version of Unicode, does not: a mark per code point, and for each a character of its class there.
    Found by asking the encoding library about those that Python's own tables lack, with pairs of bytes that merge inside a match only."""
    import tiktoken

    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    doubtful = [c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c)[0] not in "LN"]
    merges = {bytes([i]): i for i in range(256)}
    for pair in (bytes([a, b]) for a in range(128, 256) for b in b"a1!"):
        merges[pair] = len(merges)
    probe = tiktoken.Encoding("classes", pat_str=default_pattern(), mergeable_ranks=merges, special_tokens={})
    there = {c: next((k for k in "a1!" if len(probe.encode_ordinary(c + k)) == len(c.encode())), "!") for c in doubtful}
    here = {c: "a" if regex.match(r"\p{L}", c) else "1" for c in doubtful}
    table = {ord(c): _LIKE[there[c]] for c in doubtful if there[c] != here[c]}
    marks = np.zeros(sys.maxunicode + 1, bool)
    marks[list(table)] = True
    return marks, table


def ascii_twin(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII only, where letters are A-Z and a-z, numbers 0-9 and spaces those six: the standard library is the faster one there. None if the pattern has other classes."""
    out, inside = [], False
    for part in re.findall(r"\\p\{.*?\}|\\.|.", pattern, re.S):
        if part.startswith("\\p{"):
            known = {"\\p{L}": "A-Za-z", "\\p{N}": "0-9"}.get(part)
            if known is None:
                return None
            part = known if inside else f"[{known}]"
        elif part in ("\\P", "\\d", "\\w", "\\W", "\\D", "\\b", "\\B", "\\X", "\\R"):
            return None
        inside = part == "[" or (inside and part != "]")
        out.append(part)
    try:
        return re.compile("".join(out), re.A)
    except re.error:
        return None


@cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Splits a text into the matches of the pattern, as the encoding library does."""
    find, (marks, table), plain = regex.compile(pattern), unsettled(), ascii_twin(pattern)

    def split(text: str) -> list[str]:
        if text.isascii():
            return (plain or find).findall(text)
        if not marks[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return find.findall(text)
        return [text[m.start() : m.end()] for m in find.finditer(text.translate(table))]

    return split


class PrefixTable:
    """A text with the last token of every byte prefix of its matches, and where the matches start (bytes)."""

    #: A match is settled once two characters behind it are known: no choice of the pattern looks further.
    LOOKS_AHEAD = 2

    def __init__(self, ranks: Ranks, pattern: str, text: str = "", last: list[int] | None = None, starts: list[int] | None = None) -> None:
        self.ranks, self.pattern, self.data = ranks, pattern, text.encode()
        self.last, self.starts, self.filled = [], [], 0
        if last is not None and starts is not None:
            self.last, self.starts = list(last), list(starts)
        else:
            self._rest(0, 0, None)

    @property
    def text(self) -> str:
        return self.data.decode()

    def ids(self) -> list[int]:
        out = []
        for start, end in zip(self.starts, [*self.starts[1:], len(self.data)][: len(self.starts)], strict=True):
            match = self.data[start:end]
            token = self.ranks.whole.get(match)
            out += [token] if token is not None else self.ranks.tokens(match, self.last[start:end])
        return out

    def _rest(self, at: int, same: int, old: tuple | None) -> None:
        """Splits and fills anew from byte `at`, where a match begins. The first `same` bytes are those of the old table; `old`: (its last, starts, bytes, first byte here that is
        old again, shift)."""
        known, starts = (old[0], old[1]) if old else ([], [])
        met = {s + old[4] for s in starts if s + old[4] >= old[3]} if old else set()
        before = bisect_right(starts, at) - 1 if starts else -1
        old_ends = dict(zip(starts, [*starts[1:], old[2]], strict=True)) if starts else {}
        end = at
        for found in splitter(self.pattern)(self.data[at:].decode()):
            start, match = end, found.encode()
            end = start + len(match)
            if start in met:  # from here on all is as it was
                at_old = start - old[4]
                i = bisect_right(starts, at_old) - 1
                self.starts += [s + old[4] for s in starts[i:]]
                self.last += known[at_old:]
                return
            self.starts.append(start)
            table: list[int] = []
            if before >= 0 and starts[before] == start < same:  # a match that began here before: its prefixes in front of the change hold
                table = list(known[start : min(same, end, old_ends[start])])
            self.filled += self._fill(match, table, start, end, old, old_ends)
            self.last += table
            while 0 <= before < len(starts) - 1 and starts[before] < end:
                before += 1

    def _fill(self, match: bytes, table: list[int], start: int, end: int, old: tuple | None, old_ends: dict) -> int:
        """Fills a match's table; where the old one holds again inside of it, takes it from there. Returns the number of prefixes worked out."""
        n = self.ranks.longest
        if old and start < old[3] < end:  # ends behind the change
            shift = old[4]
            inside = [s for s in old_ends if s + shift < end and old_ends[s] + shift == end]
            if inside:
                begin, done = inside[0], len(table)
                at = max(len(table), old[3] - start)
                while at < len(match):
                    upto = min(at + n, len(match))
                    self.ranks.extend(match, table, upto)
                    low = start + upto - n - shift  # of the old text
                    if upto - n >= old[3] - start + n and low - begin >= n and table[upto - n : upto] == old[0][low : low + n]:
                        table += old[0][start + upto - shift : old_ends[begin]]
                        return upto - done
                    at = upto
        done = len(table)
        self.ranks.extend(match, table)
        return len(match) - done

    def append(self, more: str) -> PrefixTable:
        """Puts text behind: only the last match may grow, the others are settled. Prefixes it had keep their last tokens."""
        return self.edit(len(self.data), len(self.data), more.encode())

    def edit(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Puts `new` in place of the bytes start..end (at whole characters)."""
        old_starts, old_last, size, shift = self.starts, self.last, len(self.data), len(new) - (end - start)
        k = max(0, bisect_right(old_starts, max(0, start - 1)) - 1 - self.LOOKS_AHEAD)
        at = old_starts[k] if old_starts else 0
        self.data = self.data[:start] + new + self.data[end:]
        self.starts, self.last, self.filled = old_starts[:k], old_last[:at], 0
        self._rest(at, start, (old_last, old_starts, size, start + len(new), shift))
        return self


def _fields(df: DataFrame, keep: list[str], extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema] + [extra])


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, ranks: str | None = None, pattern: str | None = None, packed: bool = False) -> DataFrame:
    """Adds ids to the columns in `keep` (default: all): array<int>, or with `packed` a binary of little-endian unsigned 32-bit integers."""
    keep, path, split = docs.columns if keep is None else keep, ranks or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, find = ranks_of(path).words, splitter(split)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                matches = [find(t) if t else [] for t in part.column("__text").to_pylist()]
                words.learn(set().union(*matches))
                ids = [b"".join(map(words.__getitem__, m)) for m in matches]
                if packed:
                    column = pa.array(ids, pa.binary())
                else:
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [column], names=[*keep, "ids"])

    ready = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    return ready.mapInArrow(run, _fields(docs, keep, "ids " + ("binary" if packed else "array<int>")))


def decode(encoded: DataFrame, ids_col: str = "ids", keep: list[str] | None = None, ranks: str | None = None) -> DataFrame:
    """Adds decoded (binary, the bytes of all tokens; a cast to string gives the text) to the columns in `keep` (default: all). ids: an array, or packed."""
    keep, path = encoded.columns if keep is None else keep, ranks or default_ranks()
    packed = encoded.select(ids_col).schema[0].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = ranks_of(path).by_rank
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = part.column("__ids").to_pylist()
                texts = [b"".join(by_rank[np.frombuffer(x, "<u4") if packed else np.array(x)]) if x else b"" for x in rows]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(texts, pa.binary())], names=[*keep, "decoded"])

    ready = encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(ids_col).alias("__ids"))
    return ready.mapInArrow(run, _fields(encoded, keep, "decoded binary"))


_TABLE = "text string, ids array<int>, last array<int>, starts array<int>"


def _tables(df: DataFrame, columns: list, key_col: str, change, ranks: str | None, pattern: str | None) -> DataFrame:
    path, split = ranks or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                made = [change(ranks_of(path), split, row) for row in part.drop_columns([key_col]).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key_col), pa.array([x.text for x in made], pa.string()), *[pa.array(v, lists) for v in ([x.ids() for x in made], [x.last for x in made], [x.starts for x in made])]],
                    names=[key_col, "text", "ids", "last", "starts"],
                )

    return df.select(F.col(key_col), *columns).mapInArrow(run, _fields(df, [key_col], _TABLE))


def prefix_tables(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Key, text, ids, last (last token of each byte prefix of each match) and starts (first bytes of the matches): what append and edit go on from."""
    return _tables(docs, [F.col(text_col).alias("t")], key_col, lambda r, p, row: PrefixTable(r, p, row["t"] or ""), ranks, pattern)


def append(tables: DataFrame, more_col: str, key_col: str = "doc_id", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The tables with the text of more_col behind each text (null: none). Only the growth is encoded."""

    def change(r: Ranks, p: str, row: dict) -> PrefixTable:
        return PrefixTable(r, p, row["text"] or "", row["last"], row["starts"]).append(row["more"] or "")

    return _tables(tables, ["text", "last", "starts", F.col(more_col).alias("more")], key_col, change, ranks, pattern)


def edit(tables: DataFrame, at_col: str, length_col: str, new_col: str, key_col: str = "doc_id", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The tables with new_col in place of length_col characters from at_col (from 0; beyond the text: its end). Only what is near the change is encoded."""

    def change(r: Ranks, p: str, row: dict) -> PrefixTable:
        text = row["text"] or ""
        start = len(text[: max(0, row["at"] or 0)].encode())
        end = len(text[: max(0, row["at"] or 0) + max(0, row["n"] or 0)].encode())
        return PrefixTable(r, p, text, row["last"], row["starts"]).edit(start, end, (row["new"] or "").encode())

    return _tables(tables, ["text", "last", "starts", F.col(at_col).alias("at"), F.col(length_col).alias("n"), F.col(new_col).alias("new")], key_col, change, ranks, pattern)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and whether decoding gives the text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    back = decode(encode(docs, keep=["doc_id", "sha"], packed=True))
    sha = F.sha2("decoded", 256)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), sha.alias("decoded_sha256"), (sha == F.col("sha")).alias("lossless"))
