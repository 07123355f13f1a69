"""Language ID (operator 4): averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is lower-cased, its ASCII non-letters become spaces, and every run of 1 to 4 bytes (UTF-8) is hashed to a bucket; the buckets'
embeddings are averaged and a linear softmax gives the languages. Prediction folds embedding and softmax into one bucket-by-language
table, so a whole text costs four gathers a byte. The softmax is calibrated by a temperature, and the rejection threshold by the scores
of right answers, both on a part of the sample that training did not see.

Training sample: at most `sample` rows (parameter), those with the smallest hash of their id among rows that have a label and a text with a letter.

Cases: null text or text without a letter is `und`, score 0, rejected; an empty table, or one without labels, learns nothing: every row is `und` then;
one label only predicts that label; repeated rows are predicted each; of rows that share an id the least (text, label) is learned from; letters are the Unicode categories L; ties go to the label that sorts first; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import table

UND = "und"
ORDERS = (1, 2, 3, 4)
PAD = ORDERS[-1] - 1
_WORDY = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    """Whether a character of the Unicode categories L is in text; number signs such as U+00BD and U+2460 are none."""
    return bool(text) and any(m[0].isalpha() for m in _WORDY.finditer(text))


def buckets_of(data: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bucket of each byte run of each order, by start; runs beyond the end are padded with spaces."""
    padded = np.concatenate([data, np.full(ORDERS[-1], 32, np.uint8)]).astype(np.uint32)
    h = np.zeros(len(data), np.uint32)
    for n in ORDERS:
        h = h * np.uint32(0x01000193) + padded[n - 1 : n - 1 + len(data)] + np.uint32(1)
        yield ((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def text_bytes(text: str) -> np.ndarray:
    """A text's bytes with a space before and PAD behind; runs start before the padding, so none leaves its text."""
    return _FOLD[np.frombuffer(f" {text.lower()}   ".encode(errors="replace"), np.uint8)]


@dataclass
class LanguageModel:
    """weights: bucket by label, embedding and softmax folded; temperature and threshold as calibrated."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    def logits(self, texts: list[str], step: int = 1 << 20) -> np.ndarray:
        """Mean weights of each text's buckets, over whole texts, step bytes at a time."""
        out, group, size = [], [], 0
        for text in [*texts, None]:
            data = None if text is None else text_bytes(text)
            if group and (data is None or size + len(data) > step):
                out.append(self._group(group, step))
                group, size = [], 0
            if data is not None:
                group.append(data)
                size += len(data)
        return np.concatenate(out) + self.bias if out else np.zeros((0, len(self.labels)))

    def _group(self, group: list[np.ndarray], step: int) -> np.ndarray:
        sizes = np.array([len(g) for g in group])
        runs = sizes - PAD
        data = np.concatenate(group)
        if len(group) == 1 and len(data) > 2 * step:  # one long text: sums over slices, with the runs that cross their ends
            total = np.zeros((1, len(self.labels)))
            for at in range(0, runs[0], step):
                n = min(step, runs[0] - at)
                for h in buckets_of(data[at : at + n + PAD], self.bits):
                    total += self.weights[h[:n]].sum(axis=0, dtype=np.float64)
            return total / (runs[0] * len(ORDERS))
        starts = np.cumsum(sizes) - sizes
        bounds = np.stack([starts, starts + runs], axis=1).ravel()  # runs of a text, then its padding
        total = np.zeros((len(group), len(self.labels)))
        for h in buckets_of(data, self.bits):
            total += np.add.reduceat(self.weights[h], bounds, axis=0)[::2]
        return total / (runs[:, None] * len(ORDERS))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, score and rejection of each text."""
        labels, scores, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.labels else []
        if at:
            p = softmax(self.logits([texts[i] for i in at]) / self.temperature)
            best = p.argmax(axis=1)
            scores[at] = p[np.arange(len(at)), best]
            rejected[at] = scores[at] < self.threshold
            for i, b in zip(at, best, strict=True):
                labels[i] = self.labels[b]
        return labels, scores, rejected


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], bits: int = 15, dim: int = 16, steps: int = 20_000, rate: float = 1.0, emb_rate: float = 20.0, seed: int = 7, wrongly_rejected: float = 0.001) -> LanguageModel:
    """Fits the model on the driver. Every fifth text calibrates; the rest trains, one text a step, about `steps` in all, the rate falling to 0. emb_rate makes up for the average, which spreads a step thinly over the buckets."""
    labels = sorted(set(langs))
    if not labels:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    y = np.array([labels.index(x) for x in langs])
    feats = []
    for t in texts:
        data = text_bytes(t)
        count = np.zeros(1 << bits, np.float32)
        for h in buckets_of(data, bits):
            count += np.bincount(h[:-PAD], minlength=1 << bits)
        ids = np.flatnonzero(count)
        feats.append((ids, (count[ids] / count.sum()).astype(np.float32)))
    hold = np.arange(len(texts)) % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    order = np.flatnonzero(~hold)
    epochs, done = max(2, round(steps / len(order))), 0
    for _ in range(epochs):
        for i in rng.permutation(order):
            ids, w = feats[i]
            x = w @ emb[ids]
            p = softmax((x @ out + bias)[None])[0]
            p[y[i]] -= 1
            lr = rate * (1 - done / (epochs * len(order)))
            back = out @ p
            out -= lr * np.outer(x, p)
            bias -= lr * 0.1 * p
            emb[ids] -= (emb_rate * lr * w)[:, None] * back
            done += 1
    folded = (emb @ out).astype(np.float32)
    model = LanguageModel(labels, folded, bias.astype(np.float64), 1.0, 0.0)
    if hold.any():
        z = np.stack([feats[i][1] @ folded[feats[i][0]] for i in np.flatnonzero(hold)]) + bias
        truth, rows = y[hold], np.arange(hold.sum())
        sure = 1 - 1 / (len(rows) + 2)  # smoothed targets: a sample without errors does not make every score 1

        def loss(t: float) -> float:
            p = softmax(z / t)[rows, truth]
            return -(sure * np.log(p + 1e-12) + (1 - sure) * np.log(1 - p + 1e-12)).mean()

        model.temperature = float(min(np.exp(np.linspace(-2.5, 2.5, 101)), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        if len(right):
            model.threshold = float(min(0.5, np.quantile(right, wrongly_rejected)))
    return model


def fit(docs: DataFrame, eligible: Column, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> LanguageModel:
    """Trains on at most `sample` eligible rows: those with the smallest hash of their id. Ids are chosen first, then only the chosen texts move."""
    usable = docs.where(eligible & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("__id"), text_col, lang_col)
    chosen = usable.select("__id").distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
    picked = usable.join(F.broadcast(chosen), "__id", "left_semi").groupBy("__id").agg(F.min(F.struct(text_col, lang_col)).alias("r"))
    rows = picked.select("__id", "r.*").collect()  # bounded by `sample` rows
    rows = sorted((r for r in rows if has_letter(r[text_col])), key=lambda r: str(r["__id"]))
    return train([r[text_col] for r in rows], [r[lang_col] for r in rows], **options)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns of docs in `keep` (default: all) with label, score and rejection under `names`. The model is shipped to the tasks: its size is fixed by its bits and labels."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = text_col if text_col in keep else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores, rejected = shared.value.predict(batch.column(source).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(labels, pa.string()), pa.array(scores), pa.array(rejected)], names=[*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    extra = [] if source == text_col else [F.col(text_col).alias(source)]
    return docs.select(*[F.col(c) for c in keep], *extra).mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def in_fold(id_col: str = "doc_id") -> Column:
    """The held-out fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~in_fold())
    return predict(docs.withColumn("held_out", in_fold()), model, keep=["doc_id", "held_out"])
