"""N-gram Jaccard join (operator 9): PartEnum signatures over sets of word shingles, exact links, components.

Two sets with a Jaccard similarity of 3/4 or more differ in at most (|A| + |B|) / 7 features. Sets of similar size share a band (its upper end is 4/3 of its lower
end); sets near a lower end also enumerate in the band below, so similar sets meet in one band at least. A band with at most K differences cuts the feature domain into
n1 partitions and each of these into n2 parts; a partition with at most k2 differences agrees on n2 - k2 parts, so its signatures are all subsets of n2 - k2 parts,
with the features in them. A set enumerates its first k // (k2 + 1) + 1 + s partitions (k: its own differences), so similar sets agree in 1 + s partitions.

A signature without features says nothing, and one that more than `crowd` sets hold (passages that many documents share, large groups of near copies) is hot. A set
whose partitions with such signatures are s at most loses no link without them. Others are handled apart: sets with too many empty subsets ("thin", short ones
as a rule) also meet on the first features of their sorted sets, as prefix filtering does; sets with too many hot signatures are joined among themselves in blocks, after those
that are similar to a pivot of their group have been set aside. Signatures are counted over all sets, by one shuffle that also drops those of one set alone.

Equal sets are one node, so exact copies cost one row each. Candidates are verified on the full sets: any choice of parameters gives the same, exact links.

Cases: null, empty and blank texts have an empty set, no link, and are their own component; a text with one to four words is one shingle; ties have no
meaning here (a component's id is its smallest doc_id); rows that share a doc_id are one document for links, with the size of each row's own set; a null doc_id links nothing and takes the
component of an equal set with an id, else null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import materialise, table
from tidepanel.llm.components import connected_components

WIDTH = 5
_K = np.uint64(0x9E3779B97F4A7C15)
_KINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word of all texts, and the number of its text."""
    parts = [(t or "").encode(errors="replace") for t in texts]
    data = _FOLD[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    blank = _BLANK[data]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power = np.cumprod(np.full(len(data) + 1, _K, np.uint64))
    inverse = np.cumprod(np.full(len(data), _KINV, np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse)])
    words = _mix((total[end] - total[start]) * power[end] + (end - start).astype(np.uint64))
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    return words, np.searchsorted(offsets, start, "right") - 1


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of each distinct shingle, by text and hash."""
    words, doc = word_hashes(texts)
    n = len(words)
    whole = np.flatnonzero(doc[: max(0, n - width + 1)] == doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    h = np.zeros(len(whole), np.uint64)
    for j in range(width):
        h = _mix(h * _K + words[whole + j] + np.uint64(j + 1))
    owner = doc[whole]
    count = np.bincount(doc, minlength=len(texts))
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        first = np.searchsorted(doc, few)
        short = np.zeros(len(few), np.uint64)
        for j in range(width - 1):
            has = count[few] > j
            short[has] = _mix(short[has] * _K + words[first[has] + j] + np.uint64(j + 1))
        h, owner = np.concatenate([h, short]), np.concatenate([owner, few])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], h[keep]


def max_difference(size: np.ndarray) -> np.ndarray:
    """Most features in which a set of this size and a similar one differ."""
    return (size + size * 4 // 3) // 7


def _bands() -> np.ndarray:
    """Upper ends of the size bands: 1, 2, 4, 6, 9, 13, ... (4/3 of the lower end)."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append((ends[-1] + 1) * 4 // 3)
    return np.array(ends, np.int64)


BANDS = _bands()


def _parameters() -> np.ndarray:
    """By band: K (differences), k2, n2, s, n1. Small bands have one or two partitions with many parts, the next pairs of parts of three. In large ones, where the number of
    partitions that must agree tells sets apart, subsets would only multiply the signatures (by 1.5 for pairs of three): there a partition is one part."""
    out = []
    for k in max_difference(BANDS):
        k2, n2 = {0: (0, 1), 1: (1, 3), 2: (2, 5), 3: (3, 6), 4: (2, 5), 5: (2, 5)}.get(int(k), (1, 3) if k <= 48 else (0, 1))
        least = int(k) // (k2 + 1) + 1
        spare = 0 if k < 6 else max(1, -(-least // 4)) if k2 else -(-least * 9 // 50)
        out.append((int(k), k2, n2, spare, least + spare))
    return np.array(out, np.int64)


PARAMETERS = _parameters()
#: Low bits of a signature: the band's parity and the partition, or all ones for a thin set's feature. Partition numbers are whole up to bands of some 17 million shingles (a text of 100 MB).
PART_BITS = 24
PART = (1 << PART_BITS) - 1
_PARTS = PART >> 1


def signatures(owner: np.ndarray, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures by text (values, ends), and by text and band parity the partitions beyond those with an empty subset that it can spare.

    owner, h: as shingle_sets gives them. Spare counts under 0 mark thin sets; a parity in which the text has no signature has the least number.
    """
    size = np.bincount(owner, minlength=n_texts)
    own = np.searchsorted(BANDS, np.maximum(size, 1))
    left = np.full((n_texts, 2), -(1 << 30), np.int64)
    out_o, out_t = [], []
    y = _mix(h ^ np.uint64(0x5851F42D4C957F2D))
    thin = np.zeros(n_texts, bool)
    for below in (0, 1):
        chosen = size > 0
        if below:
            chosen &= (own > 0) & (-(-size * 3 // 4) <= BANDS[own - 1])
        band = own - below
        diff, k2, n2, spare, n1 = PARAMETERS[band].T
        most = (size + BANDS[np.maximum(own - 1, 0)]) // 7 if below else max_difference(size)  # differences from a set that it meets in this band
        first = np.minimum(most, diff) // (k2 + 1) + 1 + spare  # partitions enumerated
        texts = np.flatnonzero(chosen)
        left[texts, band[texts] & 1] = (spare - first)[texts]
        for parts, drop in {(int(n2[t]), int(k2[t])) for t in texts}:
            part = ((h >> np.uint64(32)) * n1.astype(np.uint64)[owner]) >> np.uint64(32)
            pick = np.flatnonzero((chosen & (n2 == parts) & (k2 == drop))[owner] & (part < first.astype(np.uint64)[owner]))
            if not len(pick):
                continue
            o, p, v = owner[pick], part[pick], y[pick]
            at = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (p[1:] != p[:-1])]))
            second = (v >> np.uint64(40)) % np.uint64(parts)
            sums = [np.add.reduceat(np.where(second == np.uint64(j), v, np.uint64(0)), at) for j in range(parts)]
            has = np.bitwise_or.reduceat(np.uint64(1) << second, at)
            o, p = o[at], p[at]
            parity = band[o] & 1
            code = (parity.astype(np.uint64) << np.uint64(PART_BITS - 1)) | (p % np.uint64(_PARTS))
            seed = _mix(p * _K + band[o].astype(np.uint64) + np.uint64(17))
            full = np.ones(len(o), bool)
            for number, subset in enumerate(combinations(range(parts), parts - drop)):
                filled = (has & np.uint64(sum(1 << j for j in subset))) != 0
                full &= filled
                t = _mix(sum(sums[j] for j in subset) + seed + np.uint64(number << 32))
                out_o.append(o[filled])
                out_t.append(((t & ~np.uint64(PART)) | code)[filled])
            np.add.at(left, (o[full], parity[full]), 1)
        thin[texts] |= left[texts, band[texts] & 1] < 0
    rank = np.arange(len(h)) - np.searchsorted(owner, owner)
    pick = thin[owner] & (rank < (size - -(-size * 3 // 4) + 1)[owner])
    out_o.append(owner[pick])
    out_t.append(h[pick] | np.uint64(PART))
    o, t = np.concatenate(out_o), np.concatenate(out_t)
    order = np.argsort(o, kind="stable")
    return t[order], np.searchsorted(o[order], np.arange(n_texts + 1)), left


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[list, list]]:
    """Ids and texts, about most characters at a time; a longer text comes alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and size + len(t or "") > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t or "")
    if texts:
        yield ids, texts


def _digests(h: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    import hashlib

    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]


def histogram(h: np.ndarray) -> bytes:
    """Number of features by hash bucket, a byte each; half as many buckets as features or more, a power of two."""
    buckets = 1 << max(4, int(len(h) // 2).bit_length())
    return np.minimum(np.bincount((_mix(h ^ _KINV) % np.uint64(buckets)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def may_be_similar(a: bytes, b: bytes, sizes: int) -> bool:
    """Whether the histograms of two sets leave room for enough common features: a bucket has no more in common than its lesser count. (A full bucket, 255, leaves any room.)"""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    if x.max(initial=0) == 255 or y.max(initial=0) == 255:
        return True
    x = x.reshape(-1, len(y)).sum(axis=0)
    return 175 * int(np.minimum(x, y).sum()) >= 75 * sizes


_SETS = "doc_id long, n_shingles long, digest binary, left_even int, left_odd int, counts binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the size and digest of its set, and the partitions it can spare."""
    for ids, texts in _chunks(batches):
        owner, h = shingle_sets(texts)
        size = np.bincount(owner, minlength=len(texts))
        digests = _digests(h, np.concatenate([[0], np.cumsum(size)]))
        left = signatures(owner, h, len(texts))[2].astype(np.int32)
        ends = np.cumsum(size)
        counts = [histogram(h[b - n : b]) if n else None for b, n in zip(ends, size, strict=True)]
        columns = [pa.array(ids, pa.int64()), pa.array(size), pa.array(digests, pa.binary()), pa.array(left[:, 0]), pa.array(left[:, 1]), pa.array(counts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SETS.split(", ")])


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig, doc_id of each signature; a task gives those of equal sets once. Rows without an id or a word have none."""
    known: set = set()
    for ids, texts in _chunks(batches):
        owner, h = shingle_sets(texts)
        fresh = np.zeros(len(texts), bool)
        for i, d in enumerate(_digests(h, np.searchsorted(owner, np.arange(len(texts) + 1)))):
            if d is not None and ids[i] is not None and d not in known:
                known.add(d)
                fresh[i] = True
        pick = fresh[owner]
        t, ends, _ = signatures(owner[pick], h[pick], len(texts))
        who = np.repeat(np.array([i or 0 for i in ids], np.int64), np.diff(ends))
        for at in range(0, len(t), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(t[at : at + (1 << 16)].view(np.int64)), pa.array(who[at : at + (1 << 16)])], names=["sig", "doc_id"])


def _block_links(owner: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Links between the sets of a block or of two as a spanning forest, by counting common features."""
    feature, index = np.unique(h, return_inverse=True)
    often = np.bincount(index, minlength=len(feature)) > 1
    new = np.cumsum(often) - 1
    pick = often[index]
    owner, index = owner[pick], new[index[pick]]
    m, total = len(sizes), int(often.sum())
    common = np.zeros((m, m), np.int64)
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    step = 4096
    for at in range(0, total, step):
        a, b = np.searchsorted(index, [at, at + step])
        dense = np.zeros((m, min(step, total - at)), np.float32)
        dense[owner[a:b], index[a:b] - at] = 1
        common += (dense @ dense.T).astype(np.int64)  # 4096 at most, exact
    linked = 100 * common >= 75 * (sizes[:, None] + sizes[None, :] - common)
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    forest = []
    for i, j in np.argwhere(np.triu(linked, 1)):
        if (a := root(i)) != (b := root(j)):
            parent[b] = a
            forest.append((int(i), int(j)))
    return forest


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 64, block_features: int = 400_000, block_sets: int = 512, pivots: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    crowd: a signature of more sets is hot. block_sets and block_features: size of a block of crowded sets. pivots: rounds of setting aside what is similar to one set of the group.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(texts.mapInArrow(_sets, _SETS), "sets")
    distinct = sets.where("digest is not null and doc_id is not null").groupBy("digest")
    nodes = distinct.agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.max("left_even").alias("left_even"), F.max("left_odd").alias("left_odd"), F.any_value("counts").alias("counts"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs, crowded = _candidates(texts, sets, nodes, crowd)
    pairs = materialise(_roomy(pairs, nodes), "roomy-pairs")
    full = _features(texts, nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi"))
    links = _pair_links(pairs, full).union(_same_document(sets, nodes))
    if not crowded.isEmpty():
        apart = _features(texts, nodes.join(crowded.select("node").distinct(), "node", "left_semi"))
        links = links.union(_crowded_links(crowded, apart, block_features, block_sets, pivots))
    found = connected_components(links)
    grouped = nodes.select("digest", "node", "first_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = materialise(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")), "components")
    of_set = materialise(grouped.join(least, "component").select("digest", "component_id"), "set-components")
    out = sets.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _candidates(texts: DataFrame, sets: DataFrame, nodes: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes that share enough signatures, and the crowded nodes with their hot signatures (node, sig).

    Different sets of one doc_id take each other's signatures as well: they are one document for links, and pairs are verified.
    """
    each = texts.mapInArrow(_signature_rows, "sig long, doc_id long")
    several = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("n > 1").select("sig", "doc_id")
    of = sets.where("doc_id is not null and digest is not null").select("doc_id", "digest").distinct().join(nodes.select("digest", "node"), "digest").select("doc_id", "node")
    shared = materialise(materialise(several, "shared").join(materialise(of, "doc-nodes"), "doc_id").select("sig", "node").distinct(), "signatures")
    counts = materialise(shared.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "signature-counts")
    part = F.col("sig").bitwiseAND(F.lit(PART))
    key = F.when(part == PART, F.lit(2)).otherwise(F.shiftright(part, PART_BITS - 1)).cast("int")
    hot = materialise(shared.join(counts.where(F.col("n") > crowd), "sig").select("sig", "node", key.alias("key"), F.col("n").alias("held")), "hot")
    # a set's own hot signatures in one row: the most held first
    own = hot.groupBy("node", "key").agg(F.sort_array(F.collect_list(F.struct((-F.col("held")).alias("under"), "sig"))).alias("hots"))
    own = own.withColumn("parts", F.transform("hots", lambda x: x["sig"].bitwiseAND(F.lit(PART)))).withColumn("weak_parts", F.array_distinct("parts"))
    spare = nodes.select("node", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("key"), c.alias("left")) for i, c in enumerate((F.col("left_even"), F.col("left_odd"), F.lit(0)))])).alias("x")).select("node", "n", "x.*")
    left = F.col("left") - F.when(F.col("hots").isNull(), 0).otherwise(F.size("weak_parts"))
    # Crowded sets that share no cold signature share hot ones of left + 1 partitions at least, so each may leave out those of its `left` most held partitions
    first = F.when(F.col("left") < 0, 1).otherwise(F.array_position("parts", F.get("weak_parts", F.col("left"))).cast("int"))
    used = F.when(left < 0, F.slice("hots", first, F.size("hots")))
    spare = materialise(spare.join(own, ["node", "key"], "left").select("node", "n", "key", left.alias("left"), used.alias("used")), "spare")
    crowded = spare.where("used is not null").select("node", F.inline("used")).select("node", "sig", (-F.col("under")).alias("held"))
    crowded = materialise(crowded, "crowded")
    cold = materialise(shared.join(counts.where(F.col("n") <= crowd).select("sig"), "sig"), "cold")  # `crowd` rows a signature at most
    met = cold.select("sig", F.col("node").alias("a")).join(cold.select("sig", F.col("node").alias("b")), "sig").where("a < b").select("a", "b", part.alias("part"), key.alias("key"))
    agreed = met.groupBy("a", "b", "key").agg(F.count_distinct("part").alias("agreed"))
    side = lambda c: spare.select(F.col("node").alias(c), "key", F.col("left").alias(f"left_{c}"), F.col("n").alias(f"n_{c}"))
    fits = agreed.join(side("a"), ["a", "key"]).join(side("b"), ["b", "key"]).where("agreed > greatest(left_a, left_b, 0) and 4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a")
    return materialise(fits.select("a", "b").distinct(), "pairs"), crowded


def _features(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, features (sorted array<long>) of the wanted nodes, shingled from their first document again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in _chunks(batches):
            owner, h = shingle_sets(part)
            ends = np.searchsorted(owner, np.arange(len(part) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_digests(h, ends), pa.binary()), lists], names=["doc_id", "digest", "features"])

    keys = wanted.select(F.col("first_id").alias("doc_id"), "digest", "node")
    rows = texts.join(keys.select("doc_id"), "doc_id", "left_semi").mapInArrow(run, "doc_id long, digest binary, features array<long>")
    return materialise(rows.join(keys, ["doc_id", "digest"]).select("node", "features"), "features")


def _roomy(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose histograms leave room for a link; a histogram is a tenth of its set or less."""

    @F.pandas_udf("boolean")
    def fits(a: pd.Series, b: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([may_be_similar(x, y, int(n)) for x, y, n in zip(a, b, sizes, strict=True)], dtype=bool)

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("counts").alias(f"counts_{c}"), F.col("n").alias(f"n_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(fits("counts_a", "counts_b", F.col("n_a") + F.col("n_b"))).select("a", "b")


def _pair_links(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Links that connect what the similar pairs connect. First each node is compared with its smallest partner; of the other pairs only those between two of the
    components that result are compared, as the rest could not join anything more. In a group of copies that leaves about one comparison a copy."""
    first = materialise(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), full), "first-links")
    found = connected_components(first)
    side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}"))
    apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(in_a, a) <> coalesce(in_b, b)").select("a", "b")
    return first.union(materialise(_verified(apart, full), "other-links"))


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar."""
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("features").alias("fa")), "a").join(full.select(F.col("node").alias("b"), F.col("features").alias("fb")), "b")
    return both.select("a", "b", _similar("fa", "fb").alias("similar")).where("similar").select("a", "b")


def _similar(a: str, b: str) -> F.Column:
    """100 * common >= 75 * (|a| + |b| - common), with common computed once."""
    sizes = (F.size(a) + F.size(b)).cast("long")
    return 175 * F.size(F.array_intersect(a, b)).cast("long") >= 75 * sizes


def _same_document(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the different sets of rows that share a doc_id."""
    several = sets.where("doc_id is not null and digest is not null").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").drop("high")
    rows = sets.select("doc_id", "digest").join(several, "doc_id").where("digest <> low").select("digest", "low").distinct()
    ids = nodes.select("digest", "node")
    return rows.join(ids.withColumnRenamed("node", "a"), "digest").join(ids.select(F.col("digest").alias("low"), F.col("node").alias("b")), "low").select("a", "b")


def _crowded_links(crowded: DataFrame, full: DataFrame, block_features: int, block_sets: int, pivots: int) -> DataFrame:
    """Links among crowded sets. Sets that share hot signatures form a group; in it, what is similar to a pivot is linked with that and set aside as a pile; two piles,
    and a pile or the rest with the rest, are joined block by block, but no pile with itself: its sets are one component already."""
    spark = crowded.sparkSession
    low = materialise(crowded.groupBy("sig").agg(F.min("node").alias("low")), "hot-lows")
    groups = connected_components(crowded.join(low, "sig").select("node", "low").where("node <> low").distinct(), "node", "low")
    # the set whose signatures most others hold is the middle of its group
    weight = crowded.groupBy("node").agg(F.sum("held").alias("weight"))
    rest = materialise(full.join(groups, "node").join(weight, "node").select("component", "node", "features", "weight"), "crowded-sets")
    piles, links = [], spark.createDataFrame([], "a long, b long")
    for pile in range(pivots):
        middle = F.max_by(F.struct("node", "features"), F.struct("weight", -F.col("node")))
        center = materialise(rest.groupBy("component").agg(middle.alias("m")).select("component", F.col("m.node").alias("pivot"), F.col("m.features").alias("center")), "centers")
        seen = materialise(rest.join(center, "component").withColumn("near", _similar("features", "center")).drop("center"), "seen")
        near = seen.where("near")
        links = links.union(near.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        piles.append(near.select("component", F.lit(pile).alias("pile"), "node", "features"))
        rest = seen.where("not near").select("component", "node", "features", "weight")
    dealt = rest.select("component", F.lit(pivots).alias("pile"), "node", "features")
    for p in piles:
        dealt = dealt.union(p)
    sizes = dealt.groupBy("component", "pile").agg(F.greatest(F.ceil(F.sum(F.size("features")) / block_features), F.ceil(F.count(F.lit(1)) / block_sets)).cast("int").alias("blocks"))
    sizes = materialise(sizes, "block-counts")
    dealt = dealt.join(sizes, ["component", "pile"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    # the block pairs that each block takes part in: with every block of another pile, and within the rest with all
    other = sizes.select("component", F.col("pile").alias("pile2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own2"))
    spread = dealt.join(materialise(other, "blocks"), "component").where((F.col("pile") != F.col("pile2")) | (F.col("pile") == pivots))
    mine, its = F.struct("pile", "own"), F.struct(F.col("pile2").alias("pile"), F.col("own2").alias("own"))
    keyed = spread.select("component", F.least(mine, its).alias("x"), F.greatest(mine, its).alias("y"), "node", "features")

    def join(group: pa.Table) -> pa.Table:
        ids = group.column("node").to_numpy()
        features = group.column("features").combine_chunks()
        n = features.value_lengths().to_numpy(zero_copy_only=False)
        forest = _block_links(np.repeat(np.arange(len(ids)), n), features.flatten().to_numpy().view(np.uint64), n.astype(np.int64))
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in forest], pa.int64()), "b": pa.array([int(ids[y]) for _, y in forest], pa.int64())})

    return links.union(keyed.groupBy("component", "x", "y").applyInArrow(join, "a long, b long"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are the smallest id of their component, with all their columns. The rows to drop are joined away; rows with a null id stay."""
    found = jaccard_components(docs, id_col, text_col, **options)
    drop = materialise(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__id")).distinct(), "near-copies")
    return docs.join(drop, F.col(id_col) == F.col("__id"), "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.seen) AS component_id FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL
"""
