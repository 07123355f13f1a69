"""Target-distribution importance resampling (operator 13): hashed n-gram features, weights by the ratio of two bucket counts, a draw by Gumbel scores.

A feature is a run of 1 to n consecutive words joined by one space; its bucket is the CRC-32 of its bytes modulo the number of buckets. No run is ever put together: every word's CRC is
computed once from its bytes, and the CRC of a run follows from that of the run without its last word, by the algebra of the code: crc(A B) is crc(A) shifted by len(B) zero bytes, XOR
crc(B), and a shift by 2^j bytes is a 32 x 32 matrix over GF(2), the square of the one before. A shift by any length is a product of those of its binary digits. Matrices are kept as four
tables of 256 entries and applied to all words of a batch at once.

1. Both corpora are counted: a row per task and bucket, added up by Spark. The counts have `buckets` rows, a bound that does not grow with the data; so the gains, made from them, are broadcast.
2. Each row's weight is the floored mean of its features' gains. A row's score adds Gumbel noise drawn from a hash of the seed and its id, so a draw is repeatable in any partitioning.
3. Ranks are positions in the table sorted by score, worked out per range partition from the sizes of those before it, so no task sees all rows.

Cases: null text has no words: no features, weight 0; long texts and words are read whole; upper-case A-Z is lowered, other letters are not; ties of scores go to the smaller id; repeated
rows (same id) are counted and ranked each; a null id counts as an empty one in the hash and comes last among ties; an empty table gives an empty result, an empty target counts none;
other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import materialise, table

#: The reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
_SPACE = zlib.crc32(b" ")
#: Bytes of words (0-9, a-z, all bytes of characters beyond ASCII), as they are lowered; 0 for the others.
_LOWERED = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LOWERED[_b] = _b
_LOWERED[0x41:0x5B] = np.arange(0x61, 0x7B)
#: Words up to so many bytes are worked out together; longer ones one by one.
_TOGETHER = 64


@cache
def _byte_table() -> np.ndarray:
    """CRC register after a byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


@cache
def shift_matrix(power: int) -> np.ndarray:
    """The matrix that shifts a CRC by 2^power zero bytes, as its 32 columns."""
    if power == 0:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return _byte_table()[columns & 0xFF] ^ (columns >> np.uint32(8))
    half = shift_matrix(power - 1)
    return _apply(_tables(power - 1), half)


@cache
def _tables(power: int) -> np.ndarray:
    """The same matrix as four tables, one for each byte of the CRC."""
    columns, values = shift_matrix(power), np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where((values >> np.uint32(bit)) & np.uint32(1), columns[8 * k + bit], np.uint32(0))
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][(crc >> 8) & 0xFF] ^ tables[2][(crc >> 16) & 0xFF] ^ tables[3][crc >> 24]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs (uint32) shifted by so many zero bytes each."""
    out, power, left = crc.copy(), 0, lengths.copy()
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _apply(_tables(power), out[odd])
        left, power = left >> 1, power + 1
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: byte k of all words that have one, for k = 0, 1, ..."""
    step, out = _byte_table(), np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-lengths, kind="stable")  # longest first, so that the words still going on are a prefix
    order = order[int(np.count_nonzero(lengths > _TOGETHER)) :]
    at, size, crc = starts[order], lengths[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    going = len(order) - np.searchsorted(size[::-1], np.arange(_TOGETHER), side="right")
    for k in range(int(size[0]) if len(size) else 0):
        n = int(going[k])
        crc[:n] = step[(crc[:n] ^ data[at[:n] + k]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _TOGETHER):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return out


def features(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: number of words per text; bucket and text number of every feature."""
    none = np.zeros(0, np.int64)
    raw = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if len(raw) == 0 or offsets[0] == offsets[-1]:
        return np.zeros(len(raw), np.int64), none, none
    data = _LOWERED[np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = data != 0
    # a word begins where the byte before is none of a word, or of another text
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = word_crcs(data, starts, lengths)
    out, docs, run, of = [words % np.uint32(buckets)], [doc], words, doc
    for k in range(1, n):
        # the runs of k words that have a further word in their text, and that word
        more = np.flatnonzero(of[: len(doc) - k] == doc[k:]) if len(doc) > k else none
        whole = np.full(len(doc), 0, np.uint32)
        whole[more] = shifted(_apply(_tables(0), run[more]) ^ np.uint32(_SPACE), lengths[more + k]) ^ words[more + k]
        out.append(whole[more] % np.uint32(buckets))
        docs.append(doc[more])
        run, of = whole, np.full(len(doc), -1, np.int64)
        of[more] = doc[more]
    return np.bincount(doc, minlength=len(raw)), np.concatenate(out).astype(np.int64), np.concatenate(docs)


def _parts(column: pa.Array, most: int = 32 << 20) -> Iterator[tuple[int, int]]:
    """Slices of a column of texts of about so many bytes at most; a longer text is a slice of its own."""
    sizes = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in column)]) if len(column) else np.zeros(1)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
        yield at, end - at
        at = end


def bucket_counts(rows: DataFrame, text_col: str = "text", n: int = 2, buckets: int = 10_000) -> DataFrame:
    """bucket, count of all features of all rows. A task sends one row for each bucket it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, size in _parts(batch.column(0)):
                total += np.bincount(features(batch.column(0).slice(at, size), n, buckets)[1], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "count"])

    return rows.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """Gain of every bucket, 1000 times the log ratio of its smoothed shares, floored. Reads two tables of `buckets` rows at most."""
    counts = [np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)]
    for side, df in enumerate((source, target)):
        for r in df.collect():  # at most `buckets` rows
            counts[side][r["bucket"]] = r["count"]
    s, t = counts[0].tolist(), counts[1].tolist()
    all_s, all_t = sum(s), sum(t)
    return [math.floor(1000 * math.log((t[i] + 1) * (all_s + buckets) / ((s[i] + 1) * (all_t + buckets)))) for i in range(buckets)]


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", n: int = 2) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for at, size in _parts(batch.column("text")):
                part = batch.slice(at, size)
                words, bucket, doc = features(part.column("text"), n, len(gain))
                have = np.bincount(doc, minlength=size)
                total = np.zeros(size, np.int64)
                np.add.at(total, doc, gain[bucket])
                weight = np.where(have > 0, total // np.maximum(have, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(have), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, share: int, eligible: str) -> DataFrame:
    """rows with rank: 1, 2, ... in the order of score (highest first) and doc_id for the first share % of the eligible ones, null for the others.

    Rows are sorted by ranges; a row's rank is its place in its partition and the sizes of those in front of it, a table of one row per partition.
    """
    order = [F.col("out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = rows.withColumn("out", F.when(F.expr(eligible), 0).otherwise(1)).orderBy(*order)
    placed = materialise(placed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id() % (1 << 33)}), "sorted")
    sizes = sorted((r["part"], r["n"], r["m"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("out") == 0).alias("m")).collect())
    before, seen, of = [], 0, 0
    for part, n, m in sizes:
        before.append((part, seen))
        seen, of = seen + n, of + m
    ahead = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"))  # one row per partition
    rank = F.col("before") + F.col("place") + 1
    return placed.join(ahead, "part").withColumn("rank", F.when(rank <= share * of // 100, rank)).drop("part", "place", "out", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = 2, buckets: int = 10_000, seed: int = 7, share: int = 25, min_words: int = 20) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs. Of the rows with min_words words and more, share % are drawn; rank is null for the others."""
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets), buckets)
    rows = weigh(docs, gain, id_col, text_col, n)
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = rows.withColumn("score", F.col("weight") + noise)
    return ranked(scored, share, f"n_words >= {min_words}").withColumnRenamed("doc_id", id_col)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
