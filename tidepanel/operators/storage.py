"""Intermediate tables of operators that run in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidepanel-")
    return found.rstrip("/")


class Rounds:
    """Tables that one run of an operator writes: each cuts the lineage, and those before the last ones are deleted as the run goes on. The object owns its tables, so runs side by
    side do not touch each other's."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: DataFrame) -> None:
        """Deletes a table that put has returned and nothing reads any more."""
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
