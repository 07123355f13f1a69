"""Shared storage and small column helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition, `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. It is set here only in local mode, where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidepanel.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidepanel-")
        spark.conf.set("spark.tidepanel.shared.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there belongs to the current scope."""
    path = f"{shared_dir(spark)}/tidepanel/{name}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.paths.append(path)
    return path


class Scratch:
    """The tables that one run has written to the shared folder. Inside `with Scratch(spark) as scratch:` every table that materialise writes, in this thread, belongs to it; runs in other threads, or with
    scopes of their own, do not see them. At the end of the block its tables are deleted, but for those kept (`keep`). Without a scope tables stay until the shared folder is cleared."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self._before = spark, [], []

    def __enter__(self) -> Scratch:
        self._before.append(_scope.set(self))
        return self

    def __exit__(self, *error) -> None:
        _scope.reset(self._before.pop())
        self.clear()

    def keep(self, df: DataFrame, owner: Scratch | None = None) -> DataFrame:
        """Takes the tables that df reads out of the scope: they outlive it, and belong to the other owner, if one is given."""
        files = [_bare(f) for f in df.inputFiles()]
        kept = [p for p in self.paths if any(f.startswith(_bare(p) + "/") for f in files)]
        self.paths = [p for p in self.paths if p not in kept]
        if owner is not None:
            owner.paths += kept
        return df

    def clear(self, but_last: int = 0) -> int:
        """Deletes the tables, but the last ones, and says how many."""
        gone = self.paths[: len(self.paths) - but_last]
        for path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = self.paths[len(gone) :]
        return len(gone)


_scope: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def _bare(path: str) -> str:
    return re.sub(r"^[a-z]+:/*", "/", path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, and survives lost executors. The table belongs to the current scope, if there is one."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() on bytes-only text takes Spark's fast path; other text is translated."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def env_path(variable: str, default: str) -> str:
    return os.environ.get(variable, default)
