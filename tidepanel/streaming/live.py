"""Structured Streaming: event-time windows, per-key state, and a runner that drains what a source has."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.rolling import by_time
from tidepanel.operators.storage import shared_folder


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """Events of a growing folder of Parquet files, with a watermark of a day."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


def day_windows(events: DataFrame) -> DataFrame:
    out = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))


def user_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("purchases"))


def latest(updates: DataFrame, key: str, order: str) -> DataFrame:
    """Of the updates of a key, the one with the greatest order value."""
    at = updates.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return at.where("_r = 1").drop("_r")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str, flush: bool = False) -> DataFrame:
    """Runs the stream over all its source has, then returns the emitted rows. flush: windows that the watermark has not closed are emitted too.

    Update and complete rows go through foreachBatch, each batch to its own folder, so a repeated batch overwrites itself.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    stream.writeStream.outputMode("complete" if flush else mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/rows")
    if flush:  # complete mode repeats all windows in each batch
        last = rows.agg(F.max("batch").alias("b"))
        rows = rows.join(F.broadcast(last), F.col("batch") == F.col("b")).drop("b")
    return rows.drop("batch")


def last_valid(values: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    """Batch twin of a causal stream: the last present value before each row."""
    return values.withColumn("last_valid", F.last(value, ignorenulls=True).over(by_time(key).rowsBetween(Window.unboundedPreceding, -1)))
