"""Hard-negative mining (operator 11): exact integer inner products by bit-planes, candidates dropped by score intervals.

Components are whole numbers; a candidate's are sliced into bit-planes (two's complement). After the planes down to 2^j are multiplied with an anchor, what is missing of each component lies in
0 .. 2^j - 1, so the score lies between the sum so far plus (2^j - 1) times the anchor's negative components and the same with its positive ones. A pair is dropped once its interval cannot
reach what the anchor still asks for: the k-th best lower end, or a window's bounds and the k-th best score found in it. What is left after the last plane is exact. Planes of a block are
multiplied for all pairs while most live, then pair by pair for those that do.

1. Positives: per anchor the best k rows of its label. 2. Negatives: per anchor and positive the best k rows of other labels in the window that the positive's score opens.

Anchors (a hundredth of the rows, so their number grows with the input) are a stated query set. They go through in chunks: at most `chunk` anchors and 64 MB, a bound that holds at every size, are broadcast, and
all rows are scanned for them; a task keeps k rows per anchor and window, so what it sends depends on neither its rows nor labels, and a label that holds most rows is spread over all tasks like any other.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of different lengths meet as if the shorter one ended in zeros; an empty vector scores 0 with all;
ties of scores go to the smaller id; rows of the anchor's own id are none of its candidates; repeated rows are candidates each, and anchors each; an anchor without positives, or a positive without negatives,
has no result; a negative positive score opens an empty window; an empty table gives an empty result; other columns are not read. Scores beyond 62 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import materialise, scratch_path, table

#: Anchors and rows multiplied at a time.
ANCHORS, ROWS = 512, 2048
#: Share of living pairs of a block under which the rest goes pair by pair.
FEW = 0.06
_CHUNK_BYTES = 64 << 20


@dataclass
class Anchors:
    """A chunk of anchors: numbers, ids, labels, components; windows (low and high score, one column per window) with what they ask for."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool


def bits_of(values: np.ndarray) -> int:
    """Planes that hold all values in two's complement."""
    return max(int(values.max(initial=0)).bit_length(), int(-1 - values.min(initial=0)).bit_length()) + 1


def exact_type(anchors: np.ndarray, rows: np.ndarray) -> type:
    """The cheapest type in which no partial sum is rounded."""
    largest = (1 << bits_of(rows)) * int(np.abs(anchors).sum(axis=1, dtype=object).max() if anchors.size else 0)
    if largest >= 1 << 62:
        raise ValueError("scores of these components do not fit 64 bits")
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64


def surviving(anchors: np.ndarray, rows: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, score) among the wanted ones whose exact scores lie in one of the anchor's windows, but for those that cannot be among its best k of an open window."""
    kind = exact_type(anchors, rows)
    a, low, high = anchors.astype(kind), _bounds(low, kind), _bounds(high, kind)
    up, down = np.maximum(anchors, 0).sum(axis=1).astype(kind)[:, None], np.minimum(anchors, 0).sum(axis=1).astype(kind)[:, None]
    n_bits, alive, sums = bits_of(rows), wanted.copy(), np.zeros((len(anchors), len(rows)), kind)
    open_windows = low.shape[1] == 1
    plane = lambda j: ((rows >> j) & 1).astype(kind)
    weight = lambda j: kind(-(1 << j) if j == n_bits - 1 else 1 << j)
    for j in range(n_bits - 1, -1, -1):
        sums += weight(j) * (a @ plane(j).T)
        rest = kind((1 << j) - 1)
        least = sums + rest * down
        most = sums + rest * up
        if open_windows and len(rows) > k:  # at least k rows score as much as the k-th best lower end
            sure = np.partition(np.where(alive, least, _bounds(np.array(-np.inf), kind)), len(rows) - k, axis=1)[:, len(rows) - k]
            low = np.maximum(low, sure[:, None])
        alive &= _meets(least, most, low[:, None, :], high[:, None, :])
        if j and np.count_nonzero(alive) < FEW * alive.size:
            break
    at, row = np.nonzero(alive)
    score = sums[at, row]
    for lower in range(j - 1, -1, -1):
        if not len(at):
            break
        score = score + weight(lower) * np.einsum("ij,ij->i", a[at], plane(lower)[row])
        rest = kind((1 << lower) - 1)
        keep = _meets(score + rest * down[at, 0], score + rest * up[at, 0], low[at], high[at])
        at, row, score = at[keep], row[keep], score[keep]
    return at, row, score.astype(np.int64)


def _bounds(values: np.ndarray, kind: type) -> np.ndarray:
    """Windows' ends as the type of the sums. Ends that a short float cannot hold lie beyond all sums."""
    if kind is np.int64:
        return np.clip(values, -(2.0**62), 2.0**62).astype(np.int64)
    return values.astype(kind)


def _meets(least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros(least.shape, bool)
    for w in range(low.shape[-1]):
        out |= (most >= low[..., w]) & (least <= high[..., w])
    return out


class Best:
    """The best k (score, then smaller id) of every anchor and window so far."""

    def __init__(self, anchors: Anchors, k: int) -> None:
        self.k, self.windows = k, anchors.low.shape[1]
        self.low, self.high = anchors.low.copy(), anchors.high
        self.key, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes new pairs and raises the low ends of full windows to their k-th best score."""
        keys, scores, new = [self.key], [self.score], [self.ids]
        for w in range(self.windows):
            inside = (score >= self.low[at, w]) & (score <= self.high[at, w])
            keys.append(at[inside] * self.windows + w)
            scores.append(score[inside])
            new.append(ids[inside])
        key, score, ids = np.concatenate(keys), np.concatenate(scores), np.concatenate(new)
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.k
        self.key, self.score, self.ids = key[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.low[key[full] // self.windows, key[full] % self.windows] = score[full]


def scan(anchors: Anchors, batches: Iterator[pa.RecordBatch], k: int) -> Best:
    """Meets all rows of the batches (vec_id, label, v) with all anchors, block by block."""
    best = Best(anchors, k)
    order = np.argsort(anchors.labels, kind="stable")
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            ids, labels, rows = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"))
            by_label = np.argsort(labels, kind="stable")
            ids, labels, rows = ids[by_label], labels[by_label], rows[by_label]
            for first in range(0, len(order), ANCHORS):
                block = order[first : first + ANCHORS]
                own = anchors.labels[block]
                if anchors.same_label:  # only rows of the block's labels
                    near = slice(np.searchsorted(labels, own[0]), np.searchsorted(labels, own[-1], side="right"))
                else:
                    near = slice(0, len(labels))
                if near.start == near.stop:
                    continue
                wanted = (own[:, None] == labels[None, near]) == anchors.same_label
                wanted &= anchors.ids[block][:, None] != ids[None, near]
                a, r = _same_width(anchors.vectors[block], rows[near])
                at, row, score = surviving(a, r, wanted, best.low[block], best.high[block], k)
                best.add(block[at], score, ids[near][row])
    return best


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors as rows of a matrix, zeros behind shorter ones."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    wide = lambda x: x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return wide(a), wide(b)


_FOUND = "anchor long, window int, vec_id long, score long"


def best_rows(rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """anchor (its number), window, vec_id, score, rank of the best k rows of every anchor and window."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = sent.value
        best = scan(chunk, batches, k)
        at, window = best.key // best.windows, best.key % best.windows
        yield pa.RecordBatch.from_arrays([pa.array(chunk.number[at]), pa.array(window.astype(np.int32)), pa.array(best.ids), pa.array(best.score)], names=["anchor", "window", "vec_id", "score"])

    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "vec_id"))
    return rows.mapInArrow(run, _FOUND).withColumn("rank", place).where(F.col("rank") <= k)


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, v (array<long>) of the rows that take part."""
    x = F.col(vector_col)
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & usable)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("v"))


def mine(rows: DataFrame, anchors: DataFrame, k: int = 5, low: int = 80, high: int = 100, chunk: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows, anchors: vec_id, label, v.

    Per anchor the best k rows of its label are its positives; per positive the best k rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    Each chunk of anchors costs two scans of the rows; its results are appended to a table in the shared folder.
    """
    spark = rows.sparkSession
    n, width = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    size = max(1, min(chunk, _CHUNK_BYTES // (8 * max(1, width))))
    dealt = anchors.repartition(max(1, -(-n // size))).withColumn("anchor", F.monotonically_increasing_id())
    place = F.col("anchor") % (1 << 33)
    dealt = materialise(dealt.withColumns({"part": F.spark_partition_id(), "cut": F.floor(place / size)}), "anchors")
    pairs, found = scratch_path(spark, "positives"), scratch_path(spark, "negatives")
    for part, cut in dealt.select("part", "cut").distinct().orderBy("part", "cut").toLocalIterator():
        now = dealt.where((F.col("part") == part) & (F.col("cut") == cut)).orderBy("anchor").select("anchor", "vec_id", "label", "v").toArrow()  # at most `size` rows
        numbers, ids, labels = (now.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
        ends = np.full((len(ids), 1), np.inf)
        one = Anchors(numbers, ids, labels, _matrix(now.column("v").combine_chunks()), -ends, ends, True)
        best_rows(rows, one, k).write.mode("append").parquet(pairs)
        mine_ = spark.read.schema(_FOUND + ", rank int").parquet(pairs).where(F.col("anchor").between(int(numbers[0]), int(numbers[-1])))
        of = mine_.select("anchor", "rank", "score").toArrow()  # at most k for each anchor
        at, window = np.searchsorted(numbers, of.column("anchor").to_numpy()), of.column("rank").to_numpy() - 1
        lows, highs = np.full((len(ids), k), np.inf), np.full((len(ids), k), -np.inf)
        score = of.column("score").to_numpy()
        lows[at, window], highs[at, window] = -((-low * score) // 100), (high * score) // 100
        best_rows(rows, Anchors(numbers, ids, labels, one.vectors, lows, highs, False), k).write.mode("append").parquet(found)
    if n == 0:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    read = lambda path: spark.read.schema(_FOUND + ", rank int").parquet(path)
    positives = read(pairs).select("anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    negatives = read(found).select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(dealt.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return negatives.join(named, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    rows = materialise(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), "vectors")
    return mine(rows, rows.where("vec_id % 100 = 0"))


ORACLE = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), pos AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), neg AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
    FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT * FROM neg WHERE rank <= 5
"""
