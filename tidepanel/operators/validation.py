"""Walk-forward windows, purged cross-validation, point-in-time checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _months(day: dt.date, n: int) -> dt.date:
    m = day.month - 1 + n
    return dt.date(day.year + m // 12, m % 12 + 1, 1)


def walk_forward(spark: SparkSession, start: dt.date, end: dt.date, train: int, test: int, expanding: bool = False) -> DataFrame:
    """window, train_start, test_start, test_end (exclusive), in months; test windows do not overlap, the last is cut at end."""
    rows, first = [], start.replace(day=1)
    cut = _months(first, train)
    while cut <= end:
        stop = min(_months(cut, test), end + dt.timedelta(days=1))
        rows.append((len(rows), first if expanding else _months(cut, -train), cut, stop))
        cut = _months(cut, test)
    return spark.createDataFrame(rows, "window int, train_start date, test_start date, test_end date")


def assign(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows x window with part (train or test). Windows are a short driver-made list; their months are exploded, so the join is on a month."""
    month = F.date_trunc("month", F.col("ts")).cast("date")
    each = windows.withColumn("_m", F.explode(F.sequence(F.trunc("train_start", "month"), F.date_sub("test_end", 1), F.expr("interval 1 month"))))
    out = rows.withColumn("_m", month).join(F.broadcast(each), "_m").where("ts >= train_start and ts < test_end")
    return out.withColumn("part", F.when(F.col("ts") >= F.col("test_start"), "test").otherwise("train")).drop("_m")


def perturb_future(bars: DataFrame, cut: dt.date, factor: float = 1.5) -> DataFrame:
    """Scales prices after the cut: what an operator says up to the cut must not change."""
    return bars.withColumns({c: F.when(F.col("ts") > F.lit(cut), F.col(c) * factor).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})


def looks_ahead(before: DataFrame, after: DataFrame, cut: dt.date) -> DataFrame:
    """Rows up to the cut that differ: empty for an operator that only looks back."""
    return before.where(F.col("ts") <= F.lit(cut)).exceptAll(after.where(F.col("ts") <= F.lit(cut)))


def fingerprint(rows: DataFrame) -> DataFrame:
    """n and two order-free hashes of all rows: their exclusive or, and their sum, in which repeated rows do not cancel."""
    each = rows.select(F.xxhash64(*sorted(rows.columns)).alias("h"))
    return each.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("hash"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"))
