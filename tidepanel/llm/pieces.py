"""SentencePiece encoding and decoding (operator 5): sampled segmentations by forward filtering and backward sampling.

The lattice of a text holds every vocabulary piece that matches at every position; a character without a piece of its own goes as its
UTF-8 bytes. A piece of vocabulary rank r weighs (r + 10) ** -alpha. Forward filtering sums the weights of all paths into each node;
backward sampling walks from the end, choosing each piece with its share of that sum, so a segmentation is drawn with probability
proportional to its product of weights. Draws are hashes of (seed, row key, character position): the same row gives the same pieces in
any batch, order or retry. No piece spans a space that follows another character, so the lattice falls apart into chunks (spaces and the word
behind them); the forward pass runs once per distinct chunk, and the backward walks of a batch run together in numpy.

Decoding is lossless: pieces and bytes joined, the prefixed space dropped; no text is normalised.

Cases: null text has null ids and decodes to null; an empty text is the prefixed space alone; U+2581 in a text goes as bytes, as pieces use
it for the space; rows with equal keys and texts get equal pieces; a null key counts as a key of its own; an empty table stays empty; other
columns are kept only if asked for, under their names. Long texts and long words are walked whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import env_path, table

#: Chunks that no piece spans: a new line, or spaces with the word behind them.
_CHUNK = re.compile(r"\n| *[^ \n]+| +")
_MARK = "▁"


def default_model() -> str:
    """Path of the piece model; TIDEPANEL_PIECES overrides it."""
    return env_path("TIDEPANEL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a model, the space written as a space, and the bytes they stand for."""

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(_MARK, " ")
                self.ids[text] = i
                self.bytes_of.append(text.encode())
        self.longest = max(map(len, self.ids))
        if " " not in self.ids or any(" " in t.lstrip(" ") or "\n" in t for t in self.ids):
            raise ValueError("pieces of this model may span words")
        self.weight = (np.arange(len(self.bytes_of) + 1) + 10.0) ** -alpha  # the last is that of a character spelled as bytes
        hashes = {}
        self.begins, self.whole = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        for text, i in self.ids.items():
            h = np.uint64(0)
            for c in text:
                h = _roll(h, np.uint64(ord(c)))
                self.begins[h >> np.uint64(44)] = True
            self.whole[h >> np.uint64(44)] = True
            hashes[int(h)] = i
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.hash_ids = np.array([hashes[int(h)] for h in self.hashes], np.int64)
        slots = self.hashes >> np.uint64(44)
        self.at_slot = np.zeros(1 << 20, np.int32)
        self.at_slot[slots] = np.arange(len(slots))
        self.crowded = np.bincount(slots.astype(np.int64), minlength=1 << 20) > 1  # slots of several pieces

    def find(self, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Place of each hash among self.hashes; any place if it has none."""
        at = self.at_slot[slot]
        shared = np.flatnonzero(self.crowded[slot])
        at[shared] = np.minimum(np.searchsorted(self.hashes, h[shared]), len(self.hashes) - 1)
        return at

    def decode(self, ids) -> str:
        """The text of ids; the space prefixed in encoding goes."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data[1:].decode() if data[:1] == b" " else data.decode()

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """The texts of all lists, from one gather of their pieces' bytes. Null lists give nulls."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        n = sizes[ids]
        ends = np.cumsum(n)
        data = blob[np.repeat((np.cumsum(sizes) - sizes)[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        last = np.cumsum(count)
        cut = np.concatenate([[0], ends])
        texts = []
        for a, b, valid in zip(cut[last - count], cut[last], lists.is_valid().to_pylist(), strict=True):
            texts.append(data[a + (data[a : a + 1] == b" ") : b].decode() if valid else None)
        return pa.array(texts, pa.string())


def _roll(h, code):
    with np.errstate(over="ignore"):
        return (h + code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


class Lattices:
    """Lattices of distinct chunks: all edges in flat arrays, by end. A node is the character it ends with."""

    def __init__(self, v: Vocabulary, chunks: list[str]) -> None:
        self.v = v
        sizes = np.array([len(c) for c in chunks], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.codes = codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        left = np.repeat(self.end, sizes) - np.arange(len(codes))  # characters from here to the chunk's end
        at, h, begin, length, piece = np.arange(len(codes)), np.zeros(len(codes), np.uint64), [], [], []
        for n in range(1, v.longest + 1):
            h = _roll(h, codes[at + n - 1].astype(np.uint64))
            slot = h >> np.uint64(44)
            some = np.flatnonzero(v.whole[slot])
            found = h[some]
            where = v.find(found, slot[some])
            hit = v.hashes[where] == found
            begin.append(at[some[hit]])
            length.append(np.full(hit.sum(), n, np.int64))
            piece.append(v.hash_ids[where[hit]])
            if n == 1:
                spelled = np.ones(len(codes), bool)
                spelled[begin[0]] = False
                begin.append(np.flatnonzero(spelled))
                length.append(np.ones(spelled.sum(), np.int64))
                piece.append(np.full(spelled.sum(), len(v.weight) - 1))
            more = v.begins[slot] & (left[at] > n)
            at, h = at[more], h[more]
        begin, length, piece = np.concatenate(begin), np.concatenate(length), np.concatenate(piece)
        order = np.lexsort((length, begin + length - 1))
        begin, self.length, self.piece = begin[order], length[order], piece[order]
        self.key = self._filter(begin, np.repeat(self.start, sizes))

    def _filter(self, begin: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Forward filtering: for each edge, its node and the summed share of the node's edges so far, in 2**-32."""
        node = begin + self.length - 1
        weight = self.v.weight[self.piece]
        share = np.empty(len(node))
        mass = np.ones(len(first))
        rank = node - first[node]
        order = np.argsort(rank, kind="stable")
        cuts = np.searchsorted(rank[order], np.arange(rank.max() + 2)) if len(order) else [0]
        for e in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)):
            before = np.where(begin[e] > first[node[e]], mass[begin[e] - 1], 1.0)
            w = weight[e] * before
            heads = np.flatnonzero(np.diff(node[e], prepend=-1))
            total = np.add.reduceat(w, heads)
            share[e] = w / np.repeat(total, np.diff(np.append(heads, len(e))))
            mass[node[e[heads]]] = total
            for n in node[e[heads]][total < 1e-150]:  # only ratios within reach matter
                low = max(first[n], n - self.v.longest)
                mass[low : n + 1] *= 1e150
                if n - first[n] < self.v.longest:
                    raise ValueError("alpha is too large for this vocabulary")
        parts = np.floor(share * 2.0**32).astype(np.int64)
        cum = np.cumsum(parts)
        heads = np.flatnonzero(np.diff(node, prepend=-1))
        cum -= np.repeat(cum[heads] - parts[heads], np.diff(np.append(heads, len(node))))
        key = (node << 32) + cum
        key[np.append(heads[1:], len(node)) - 1] = (node[heads] + 1) << 32
        self.first_edge = heads  # every character ends an edge, so heads go by node
        return key

    def walk(self, chunk: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling, all chunks together: ids of the paths in order, and the number of ids of each chunk. draw: the random stream at each chunk's start."""
        base, at = self.start[chunk], self.end[chunk] - 1
        who, edges, owners = np.arange(len(chunk)), [], []
        while len(who):
            here = at[who]
            u = _mix(draw[who] + _GOLD * (here - base[who] + 1).astype(np.uint64)) >> np.uint64(32)
            e, value = self.first_edge[here], (here << 32) + u.astype(np.int64)
            on = np.flatnonzero(self.key[e] <= value)
            while len(on):
                e[on] += 1
                on = on[self.key[e[on]] <= value[on]]
            edges.append(e)
            owners.append(who)
            at[who] = here = here - self.length[e]
            who = who[here >= base[who]]
        if not edges:
            return np.zeros(0, np.int32), np.zeros(len(chunk), np.int64)
        step = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        e, owner = np.concatenate(edges), np.concatenate(owners)
        order = np.lexsort((-step, owner))
        e, owner = e[order], owner[order]
        ids, n = self.piece[e].astype(np.int32), np.ones(len(e), np.int64)
        raw = np.flatnonzero(ids == len(self.v.weight) - 1)
        if len(raw):
            # an edge's node is found again from its place among the keys
            chars = self.codes[(self.key[e[raw]] - 1) >> 32]
            spelled = [chr(c).encode(errors="replace") for c in chars]
            n[raw] = [len(x) for x in spelled]
            ids = np.repeat(ids, n)
            ids[np.repeat(np.isin(np.arange(len(n)), raw, assume_unique=True), n)] = self.v.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.bincount(owner, weights=n, minlength=len(chunk)).astype(np.int64)


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def sample_ids(v: Vocabulary, texts: list[str | None], keys: np.ndarray, seed: int, step: int = 1 << 18) -> pa.ListArray:
    """Sampled ids of each text; keys: a 64-bit number per row. Texts of about step chunks are walked together, over the lattices of their distinct chunks."""
    pieces, counts = [], np.zeros(len(texts), np.int64)
    numbers, chunks, streams, rows, have = _Numbers(), [], [], [], 0

    def flush() -> None:
        nonlocal numbers, have
        if have:
            lat = Lattices(v, list(numbers))
            lengths = [len(c) for c in chunks]
            chunk, row = np.concatenate(chunks), np.repeat(np.arange(len(rows)), lengths)
            size = (lat.end - lat.start)[chunk]
            ends = np.cumsum(size)
            offset = ends - size
            offset -= np.repeat(offset[np.cumsum(lengths) - lengths], lengths)  # every text has a chunk at least, that of the prefixed space
            ids, n = lat.walk(chunk, np.array(streams, np.uint64)[row] + _GOLD * offset.astype(np.uint64))
            pieces.append(ids)
            counts[rows] = np.bincount(row, weights=n, minlength=len(rows)).astype(np.int64)
        numbers, have = _Numbers(), 0
        for x in (chunks, streams, rows):
            x.clear()

    for r, text in enumerate(texts):
        if text is not None:
            found = np.array([numbers[c] for c in _CHUNK.findall(" " + text)], np.int64)
            chunks.append(found)
            streams.append(_stream(int(keys[r]), seed))
            rows.append(r)
            have += len(found)
            if have >= step:
                flush()
    flush()
    values = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    null = np.array([t is None for t in texts], bool)
    if null.any():
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), pa.array(values))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _stream(key: int, seed: int) -> int:
    x = (key ^ (seed * 0xD1342543DE82EF95)) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 32)


def _schema(df: DataFrame, keep: list[str], extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [extra])


def encode_sampled(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", seed: int = 1, alpha: float = 1.0, model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds piece_ids (array<int>) to the columns in `keep` (default: all)."""
    keep, path = docs.columns if keep is None else keep, model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path, alpha)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = part.column("__key").to_numpy(zero_copy_only=False)
                ids = sample_ids(v, part.column("__text").to_pylist(), keys, seed)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [ids], names=[*keep, "piece_ids"])

    ready = docs.select(*[F.col(c) for c in keep], F.xxhash64(F.col(key_col).cast("string")).alias("__key"), F.col(text_col).alias("__text"))
    return ready.mapInArrow(run, _schema(docs, keep, "piece_ids array<int>"))


def encode_best(docs: DataFrame, text_col: str = "text", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds piece_ids as the model's own deterministic encoding gives them. Null stays null."""
    keep, path = docs.columns if keep is None else keep, model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            ids = [None if t is None else sp.encode(t, num_threads=1) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "piece_ids"])

    return docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text")).mapInArrow(run, _schema(docs, keep, "piece_ids array<int>"))


def decode(encoded: DataFrame, ids_col: str = "piece_ids", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds decoded (string) to the columns in `keep` (default: all)."""
    keep, path = encoded.columns if keep is None else keep, model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [v.decode_all(part.column("__ids"))], names=[*keep, "decoded"])

    return encoded.select(*[F.col(c) for c in keep], F.col(ids_col).alias("__ids")).mapInArrow(run, _schema(encoded, keep, "decoded string"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces, and whether decoding gives the text again."""
    docs = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    back = decode(encode_sampled(docs, keep=["doc_id", "sha"]))
    return back.select("doc_id", "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), F.sha2("decoded", 256).eqNullSafe(F.col("sha")).alias("lossless"))
