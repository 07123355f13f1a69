"""Suffix-array dedup (operator 7): bytes covered by a 200-byte string that starts more than once in the corpus.

The method named for it, column-wise construction of a collection's Burrows-Wheeler transform, takes one round per symbol of the longest document and
passes over the whole transform each round; the README has the figures. This operator finds the same bytes by content-defined anchors:

1. In every window of `width` bytes the least hash of its 64-byte strings marks an anchor (ties: the rightmost), so equal windows have the same anchor at
   the same offset. Consecutive windows share an anchor; they form a span. About 1.5 % of the positions are anchors, and only they are shuffled.
2. Anchors are sorted by hash, after those of spans repeated within a task have been combined, so a line that fills a third of the corpus is no hot key. A span that occurs twice is covered whole. A span that occurs once, under an anchor with other spans, is compared window by window
   with those, once per distinct span; anchors that occur once are dropped.
3. Documents with a hit are read again, the intervals united and cut out. Equal texts are counted by digest: such texts are covered whole.

Hashes have 64 bits and are compared under an equal anchor hash, 128 bits together. Nothing is collected per anchor: sorted rows are streamed, and an anchor with more
than `crowd` distinct spans has its windows counted by a distributed aggregation.

Cases: null counts as empty; texts under `width` bytes have no such string; overlapping occurrences count; repeated rows are copies of each other;
a null doc_id is kept as it is; an empty table gives an empty result; other columns are not read. Long texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import materialise, table

_K = np.uint64(0x9E3779B97F4A7C15)
_KINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
GRAM = 64
_NAMES = ["gh", "span", "doc", "tag", "lo", "n", "back"]
_HIT = "kind int, gh long, span long, doc long, tag long, lo long, n int, back int"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(data: np.ndarray):
    """Function from starts and ends to hashes of the bytes between."""
    power = np.cumprod(np.full(len(data) + 1, _K, np.uint64))
    inverse = np.cumprod(np.full(len(data), _KINV, np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse)])
    return lambda start, end: (total[end] - total[start]) * power[end]


def anchors(parts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Of each span: anchor hash, span hash, number of the text, first window, number of windows, and the anchor's place behind the first window."""
    none = np.zeros(0, np.int64)
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    m = width - GRAM + 1
    if len(data) < width:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    rolled = _rolling(data)
    i = np.arange(len(data) - GRAM + 1)
    gram = _mix(rolled(i, i + GRAM))
    # least hash, then the rightmost; 32 bits decide, so equal windows choose alike
    key = ((gram >> np.uint64(32)) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - i.astype(np.uint64))
    blocks = np.concatenate([key, np.full(-len(key) % m, ~np.uint64(0))]).reshape(-1, m)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(key) - m + 1
    at = (np.uint64(0xFFFFFFFF) - (np.minimum(behind[:count], ahead[m - 1 : m - 1 + count]) & np.uint64(0xFFFFFFFF))).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:count]
    start = np.flatnonzero(np.arange(count) + width <= ends[doc])
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    at, doc = at[start], doc[start]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    lo, hi, at, doc = start[head], start[np.append(head[1:], len(start)) - 1], at[head], doc[head]
    span = _mix(_mix(rolled(lo, hi + width)) + (at - lo).astype(np.uint64) * _K + (hi - lo).astype(np.uint64))
    return gram[at], span, doc, lo - (ends - sizes)[doc], hi - lo + 1, at - lo


def _texts(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[list, list, list]]:
    """doc, tag and bytes of texts, about most bytes at a time; a longer text comes alone."""
    docs, tags, parts, size = [], [], [], 0
    for batch in batches:
        for d, g, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            t = t.encode(errors="replace") if isinstance(t, str) else t or b""
            if parts and size + len(t) > most:
                yield docs, tags, parts
                docs, tags, parts, size = [], [], [], 0
            docs.append(d)
            tags.append(g)
            parts.append(t)
            size += len(t)
    if parts:
        yield docs, tags, parts


def _anchor_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of copies within a task one is enough: copies are covered by their digest
        for docs, tags, parts in _texts(batches):
            fresh = []
            for k, p in enumerate(parts):
                if len(p) >= width:
                    digest = hashlib.blake2b(p, digest_size=16).digest()
                    if digest not in seen:
                        seen.add(digest)
                        fresh.append(k)
            gh, span, d, lo, n, back = anchors([parts[k] for k in fresh], width)
            doc = np.array([docs[k] for k in fresh], np.int64)[d] if len(d) else d
            tag = np.array([tags[k] for k in fresh], np.int64)[d] if len(d) else d
            # a span that occurs twice here already is covered: one of its rows meets those of other tasks, the others go anywhere
            order = np.lexsort((span, gh))
            same = np.zeros(len(gh), bool)
            same[order[1:]] = (gh[order[1:]] == gh[order[:-1]]) & (span[order[1:]] == span[order[:-1]])
            state = np.where(same, 2, 0)
            first = order[:-1][same[order[1:]]]
            state[first[~same[first]]] = 1
            route = np.where(same, _mix(doc.astype(np.uint64) * _K + lo.astype(np.uint64)), gh)
            cols = (route.view(np.int64), state.astype(np.int32), gh.view(np.int64), span.view(np.int64), doc, tag, lo, n.astype(np.int32), back.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["route", "state", *_NAMES])

    return run


def _stream_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by (gh, span), state 2 being covered already and 1 known to occur again: kind 0, spans that occur again; kind 1 and 2, one of each distinct span under an anchor with several: 1 occurs once, 2 again.

    Of the rows seen, the first of the last run is held back, until the next run shows whether it shares the anchor.
    """
    names = _NAMES
    held, dup, same = None, False, False

    def rows(cols: list[np.ndarray], pick: np.ndarray, kind) -> pa.RecordBatch:
        kinds = np.broadcast_to(np.asarray(kind, np.int32), (len(pick),))
        return pa.RecordBatch.from_arrays([pa.array(kinds)] + [pa.array(c[pick]) for c in cols], names=["kind", *names])

    for batch in batches:
        state = batch.column("state").to_numpy(zero_copy_only=False)
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        yield rows(cols, np.flatnonzero(state == 2), 0)
        meet = state < 2
        if not meet.any():
            continue
        cols, state = [c[meet] for c in cols], state[meet]
        if held is not None:
            state = np.concatenate([[0], state])
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        gh, span = cols[:2]
        head = np.flatnonzero(np.concatenate([[True], (gh[1:] != gh[:-1]) | (span[1:] != span[:-1])]))
        size = np.diff(np.append(head, len(gh)))
        again = (size > 1) | np.logical_or.reduceat(state == 1, head)
        told = held is not None and dup  # its first row went out before
        again[0] |= told
        before = np.concatenate([[same], gh[head[1:]] == gh[head[:-1]]])
        after = np.append(before[1:], False)
        covered = np.repeat(again, size)
        if told:
            covered[0] = False
        yield rows(cols, np.flatnonzero(covered), 0)
        several = np.flatnonzero((before | after)[:-1])
        yield rows(cols, head[several], np.where(again[several], 2, 1))
        held, dup, same = [c[head[-1] : head[-1] + 1] for c in cols], bool(again[-1]), bool(before[-1])
    if held is not None and same:
        yield rows(held, np.zeros(1, np.int64), 2 if dup else 1)


def _windows(data: np.ndarray, lengths: np.ndarray, counts: np.ndarray, back: np.ndarray, gh: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of each span (their bytes joined in data): number of the span, place in it, hash under its anchor and offset."""
    base = np.cumsum(lengths) - lengths
    own = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = base[own] + place
    h = _mix(_rolling(data)(start, start + width))
    return own, place, _mix(h + gh[own] * _K + (back[own] - place).astype(np.uint64))


def _fine_intervals(width: int):
    """From distinct spans sorted by anchor: the intervals of once-occurring spans whose windows occur in another one. Whole anchors are taken together."""

    def solve(parts: list[dict]) -> pa.RecordBatch:
        cat = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        own, place, h = _windows(cat["data"], cat["length"], cat["n"].astype(np.int64), cat["back"].astype(np.int64), cat["gh"].view(np.uint64), width)
        order = np.argsort(h, kind="stable")
        gh = cat["gh"][own]
        a, b = order[:-1], order[1:]
        equal = (h[a] == h[b]) & (gh[a] == gh[b])
        shared = np.zeros(len(h), bool)
        shared[a[equal]] = shared[b[equal]] = True
        at = np.flatnonzero(shared & (cat["kind"][own] == 1))
        run = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(own[at]) != 0)])) if len(at) else at
        first, last = at[run], at[np.append(run[1:], len(at)) - 1] if len(at) else at
        o = own[first]
        lo = cat["lo"][o]
        return pa.RecordBatch.from_arrays([pa.array(cat["doc"][o]), pa.array(cat["tag"][o]), pa.array(lo + place[first]), pa.array(lo + place[last] + width)], names=["doc", "tag", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("bytes")
            part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("gh", "kind", "doc", "tag", "lo", "n", "back")}
            blobs = raw.to_pylist()
            part["length"] = np.array([len(x) for x in blobs], np.int64)
            part["data"] = np.frombuffer(b"".join(blobs), np.uint8)
            cut = int(np.searchsorted(part["gh"], part["gh"][-1])) if len(part["gh"]) else 0  # the last anchor may go on
            ends = np.concatenate([[0], np.cumsum(part["length"])])
            split = lambda a, b: {k: v[ends[a] : ends[b]] if k == "data" else v[a:b] for k, v in part.items()}  # noqa: E731, B023
            if cut:
                held.append(split(0, cut))
                yield solve(held)
                held = []
            held.append(split(cut, len(blobs)))
        if held:
            yield solve(held)

    return run


def _span_rows(width: int):
    """The bytes of the listed spans of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gh", "kind", "crowded", "doc", "tag", "lo", "n", "back", "bytes"]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for doc, tag, text, fine in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "text", "fine")), strict=True):
                data = text.encode(errors="replace") if isinstance(text, str) else text or b""
                rows += [(f["gh"], f["kind"], f["crowded"], doc, tag, f["lo"], f["n"], f["back"], data[f["lo"] : f["lo"] + f["n"] - 1 + width]) for f in fine]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def _crowded_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                blobs = part.column("bytes").to_pylist()
                get = lambda c: part.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                own, place, h = _windows(np.frombuffer(b"".join(blobs), np.uint8), np.array([len(x) for x in blobs], np.int64), get("n").astype(np.int64), get("back").astype(np.int64), get("gh").view(np.uint64), width)
                yield pa.RecordBatch.from_arrays([pa.array(get(c)[own]) for c in ("gh", "kind", "doc", "tag")] + [pa.array(h.view(np.int64)), pa.array(get("lo")[own] + place)], names=["gh", "kind", "doc", "tag", "wh", "start"])

    return run


def _cut(width: int):
    """Unites each text's intervals and cuts them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags, texts, full, fine = (batch.column(c).to_pylist() for c in ("doc", "tag", "text", "full", "more"))
            removed, spans, shas = [], [], []
            for text, a, b in zip(texts, full, fine, strict=True):
                data = text.encode(errors="replace") if isinstance(text, str) else text or b""
                found = sorted([(x["lo"], x["lo"] + x["n"] - 1 + width) for x in a or []] + [(x["start"], x["end"]) for x in b or []])
                kept, at, gone, runs = hashlib.sha256(), 0, 0, 0
                for start, end in found:
                    if start > at or not runs:
                        kept.update(data[at:start])
                        runs += 1
                        gone += end - start
                        at = end
                    elif end > at:
                        gone += end - at
                        at = end
                kept.update(data[at:])
                removed.append(gone)
                spans.append(runs)
                shas.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=["doc", "tag", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, crowd: int = 2_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    if width < GRAM:
        raise ValueError(f"width is {GRAM} at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows that share an id are told apart by a 64-bit hash of their text
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"), F.col(id_col).alias("id"))
    texts = keyed.select("doc", "tag", "text")
    found = texts.mapInArrow(_anchor_rows(width), "route long, state int, gh long, span long, doc long, tag long, lo long, n int, back int")
    hits = materialise(found.repartition("route").sortWithinPartitions("gh", "span").mapInArrow(_stream_hits, _HIT), "hits")
    spans = hits.where("kind > 0")
    # the few anchors over the bound are stored, so the join has exchanges of its own and adaptive execution may split a frequent anchor
    many = materialise(spans.groupBy("gh").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("gh", F.lit(True).alias("crowded")), "crowded-anchors")
    fine = spans.join(many, "gh", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))).groupBy("doc", "tag").agg(F.collect_list(F.struct("gh", "kind", "crowded", "lo", "n", "back")).alias("fine"))
    full = hits.where("kind = 0").groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "n")).alias("full"))
    chosen = materialise(texts.join(full.join(fine, ["doc", "tag"], "full_outer"), ["doc", "tag"]), "hit-texts")
    rows = chosen.where("fine is not null").select("doc", "tag", "text", "fine")
    cut = materialise(rows.mapInArrow(_span_rows(width), "gh long, kind int, crowded boolean, doc long, tag long, lo long, n int, back int, bytes binary"), "spans")
    near = cut.where("not crowded").drop("crowded").repartition("gh").sortWithinPartitions("gh").mapInArrow(_fine_intervals(width), "doc long, tag long, start long, end long")
    windows = cut.where("crowded").mapInArrow(_crowded_windows(width), "gh long, kind int, doc long, tag long, wh long, start long")
    again = windows.groupBy("gh", "wh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    far = windows.where("kind = 1").join(again, ["gh", "wh"]).select("doc", "tag", "start", (F.col("start") + width).alias("end"))
    more = near.union(far).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    done = chosen.join(more, ["doc", "tag"], "left").select("doc", "tag", "text", "full", "more").mapInArrow(_cut(width), "doc long, tag long, n_removed long, n_spans long, kept_sha256 string")
    done = done.where("n_removed > 0").dropDuplicates(["doc", "tag"])  # repeated rows come once each
    digests = keyed.select("id", "doc", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"))
    copies = digests.where(F.col("n_bytes") >= width).groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", F.lit(True).alias("copied"))
    out = digests.join(copies, "sha", "left").join(done, ["doc", "tag"], "left")
    whole = F.coalesce("copied", F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
