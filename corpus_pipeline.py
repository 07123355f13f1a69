"""Corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's docs.

1. language_id: the model learns from labelled rows of its input (a bounded sample); documents it rejects go (no letter, or a score under its calibrated threshold).
2. exact_dedup: of equal texts (A-Z lower-cased) the largest doc_id stays.
3. near_dedup: of each component of documents with a shingle similarity of 0.75 or more the smallest doc_id stays.
4. mixing: sources are read once at least and MAX_REPEAT times at most, by temperature; repeated reads are repeated rows.
5. sentencepiece: sampled piece ids of every row, seeded by doc_id.

Null texts go in the first stage, as they have no language. Further columns of documents stay up to the last stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import exact_dedup as exact
from tidepanel.llm import jaccard_join, mixing, pieces
from tidepanel.llm import language_id as languages
from tidepanel.llm.common import Scratch, materialise, table

MAX_REPEAT = 1.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = languages.fit(docs, F.lit(True))
    return languages.predict(docs, model, names=("__lang", "__score", "__rejected")).where("not __rejected").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, max_repeat=MAX_REPEAT, epoch_col="__epoch").drop("__epoch")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_sampled(docs, keep=["doc_id", "lang", "source"])
    return encoded.withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("sentencepiece", sentencepiece)]
#: SQL cannot express the trained model, the hashed block permutation and the sampled pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, outputs = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        with Scratch(spark) as own:  # what the stage writes on the way goes with it, its output once the next one is written
            docs = own.keep(materialise(stage(spark, docs, sf_dir), name), outputs)
        outputs.clear(but_last=1)
    return docs
