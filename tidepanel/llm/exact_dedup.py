"""Exact dedup (operator 1): a persistent digest index, bucketed and sorted by digest.

A batch is reduced to one row per digest (map-side combine, so a group of copies that holds a third of all rows shrinks
before the shuffle), sort-merge anti-joined with the index, and what is new is appended to the index's table.
A table that comes whole is cut into batches by ranges of its ids, the largest first, so the index decides for the largest id of equal texts.

Cases: null text counts as empty, so null and empty texts are equal; of equal texts the largest doc_id of the batch that
first brought the text stays; repeated rows (same doc_id and text) count in group_size and all carry the same verdict;
an empty table gives an empty result; columns of docs other than the id and text are not read and may have any name.
A null doc_id never stays if its group has another id; a group of null ids only has a null keep_id and is not kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import ascii_lower, materialise, table


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


class DigestIndex:
    """Digest -> the document that stays, over all batches so far; a bucketed, sorted table of the session catalog."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, bucket_rows: int = 2_000_000) -> None:
        """buckets: of a new table; default: one for every bucket_rows rows of its first batch, as a power of two, 16 at least. An existing table keeps its own."""
        self.spark, self.name, self.buckets, self.bucket_rows = spark, name, buckets, bucket_rows
        if self.exists():
            said = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(said[1]) if said else buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index lacks. The index side is read in its buckets and order, without a shuffle."""
        if not self.exists():
            return groups
        return groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the unseen groups (digest binary, keep_id, group_size). Each task holds whole buckets, so a bucket is one file a batch."""
        fresh = self.unseen(groups).select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        if self.buckets is None:
            self.buckets = 16
            while self.buckets * self.bucket_rows < groups.count():
                self.buckets *= 2
        fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text of docs: digest, keep_id (largest id), group_size."""
    hashed = docs.select(F.col(id_col).alias("keep_id"), F.unhex(text_digest(F.col(text_col))).alias("digest"))
    return hashed.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Appends the new texts of docs to the index and returns a verdict per row of docs.

    Columns: the id, keep_id, group_size (rows of the batch that first brought the text), kept, text_sha256. A row is kept if its batch brought the text first
    and it is the row that stays. The last join reads the index by its files, so both sides are exchanged and adaptive execution may split a hot digest.
    """
    spark = docs.sparkSession
    batch = uuid.uuid4().hex
    index.append(digest_groups(docs, id_col, text_col), batch)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(text_digest(F.col(text_col))).alias("digest"))
    files = spark.read.schema(index.rows().schema).parquet(*index.rows().inputFiles()) if index.rows().inputFiles() else index.rows()
    joined = rows.join(files, "digest")
    kept = F.coalesce((F.col("batch") == batch) & (F.col("doc_id") == F.col("keep_id")), F.lit(False))
    return joined.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup_table(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 4) -> DataFrame:
    """As exact_dedup, for a whole table of numeric ids that goes through a new index in batches: ranges of the id, largest first; rows without an id come last.

    group_size counts the rows of all batches. Digests are computed once and stored; the index's anti-join decides which rows stay.
    """
    spark = docs.sparkSession
    hashed = materialise(docs.select(F.col(id_col).alias("doc_id"), F.unhex(text_digest(F.col(text_col))).alias("digest")), "digests")
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(hashed.agg(F.percentile_approx("doc_id", shares)).first()[0] or ()))
    number = F.coalesce(sum((F.col("doc_id") <= c).cast("int") for c in cuts) if cuts else F.lit(0), F.lit(len(cuts)))
    sizes = materialise(hashed.groupBy("digest", number.alias("step")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    for step in range(len(cuts) + 1):
        index.append(sizes.where(F.col("step") == step).drop("step"), uuid.uuid4().hex)
    kept = materialise(index.rows().select("digest", "keep_id"), "keepers").join(sizes.groupBy("digest").agg(F.sum("group_size").alias("group_size")), "digest")
    # both sides of the last join are exchanged, so adaptive execution may split a hot digest
    joined = hashed.join(materialise(kept, "verdicts"), "digest")
    stays = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return joined.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows (same id and text) one stays. Rows with a null id do not stay.

    Rows to drop are few, as a rule, so those are joined away rather than the others joined in.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, f"tidepanel_digests_{uuid.uuid4().hex}")
    verdict = materialise(exact_dedup(docs, index, id_col, text_col), "verdicts")
    index.drop()
    drop = verdict.where("not kept").select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__sha")).where("__id is not null").distinct()
    hashed = docs.withColumn("__digest", F.unhex(text_digest(F.col(text_col))))
    left = hashed.join(drop, (F.col(id_col) == F.col("__id")) & (F.col("__digest") == F.col("__sha")), "left_anti").where(F.col(id_col).isNotNull())
    repeated = verdict.where("kept").groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id")
    if not repeated.isEmpty():
        again = F.col(id_col) == F.col("__id")
        left = left.join(repeated, again, "left_anti").union(left.join(repeated, again, "left_semi").dropDuplicates([id_col, "__digest"]))
    return left.drop("__digest")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"tidepanel_digests_{uuid.uuid4().hex}")
    verdict = dedup_table(table(spark, sf_dir, "documents"), index)
    index.drop()
    return verdict


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
