"""Panels over the star-schema tables: daily bars, trades, fills; and readers of price files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (date), open, high, low, close, volume: a brand's line items of a ship date, in key order.

    One aggregation; of lineitem six columns are read.
    """
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.to_date("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_quantity",
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return (
        items.join(parts, "l_partkey")
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("px", "k").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "k").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade per order, from the least of its first lines: entry at the order date, exit some days later, signed quantity, execution and arrival prices."""
    line = F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")).alias("x")
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(line).select("l_orderkey", "x.*").withColumn("exec_px", F.col("l_extendedprice") / F.col("l_quantity"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("entry_date"), "o_orderpriority")
    key = F.col("l_orderkey")
    return (
        orders.join(first, "l_orderkey")
        .join(parts, "l_partkey")
        .select(
            key.alias("trade_id"),
            "symbol",
            "entry_date",
            F.date_add("entry_date", (key % 30 + 1).cast("int")).alias("exit_date"),
            F.when(key % 2 == 0, 1).otherwise(-1).alias("side"),
            F.col("l_quantity").alias("qty"),
            "exec_px",
            (F.col("exec_px") * (1 + (key % 7 - 3) / 1000.0)).alias("arrival_px"),
            (F.col("exec_px") * (1 + (key % 11 - 5) / 1000.0)).alias("decision_px"),
            F.col("l_discount").alias("maker_share"),
            F.col("l_tax").alias("rate"),
            F.col("o_orderpriority").alias("venue"),
        )
    )


def nan_to_null(value: Column) -> Column:
    """NaN and infinities as null, as missing data is null in every operator."""
    return F.when(F.isnan(value) | value.isin(float("inf"), float("-inf")), None).otherwise(value)


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate that df has, ignoring case."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[c.lower()] for c in candidates if c.lower() in have), None)
    if found is None:
        raise ValueError(f"none of {list(candidates)} in {df.columns}")
    return found


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet", fields: Sequence[str] = ("close", "adj_close", "price"), ts_unit: str | None = None, sep: str = ",") -> DataFrame:
    """symbol, ts, price from a long parquet or CSV file; the price is the first of `fields` the file has, ts may be epoch numbers of ts_unit (s, ms, us)."""
    raw = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).option("sep", sep).csv(path)
    symbol, ts = resolve_column(raw, ("symbol", "ticker")), F.col(resolve_column(raw, ("ts", "date", "timestamp", "time")))
    stamp = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[ts_unit](ts.cast("long")) if ts_unit else F.try_to_timestamp(ts.cast("string"))
    price = F.expr(f"try_cast(`{resolve_column(raw, fields)}` AS double)")
    return raw.select(F.upper(F.trim(F.col(symbol))).alias("symbol"), stamp.alias("ts"), nan_to_null(price).alias("price")).where("ts is not null").dropDuplicates(["symbol", "ts"])


def read_intraday(spark: SparkSession, path: str, symbol: str, day: str) -> DataFrame:
    """Bars of one symbol and day from a table partitioned by both; other partitions are not listed."""
    return spark.read.parquet(path).where((F.col("symbol") == symbol) & (F.col("day") == day))


def write_panel(panel: DataFrame, path: str, by_symbol: bool = False) -> None:
    """Writes a panel through the commit protocol, optionally partitioned by symbol; rows are dealt by symbol first, so a partition is few files."""
    out = panel.repartition("symbol").write.mode("overwrite") if by_symbol else panel.write.mode("overwrite")
    (out.partitionBy("symbol") if by_symbol else out).parquet(path)


BARS = """bars AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts, arg_min(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open,
max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS close, sum(l_quantity) AS volume
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""

TRADES = """firsts AS (SELECT * FROM lineitem WHERE l_linenumber = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) = 1),
trades AS (SELECT o_orderkey AS trade_id, p_brand AS symbol, CAST(o_orderdate AS DATE) AS entry_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 + 1 AS INT) AS exit_date,
CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, l_quantity AS qty, l_extendedprice / l_quantity AS exec_px, l_extendedprice / l_quantity * (1 + (o_orderkey % 7 - 3) / 1000.0::DOUBLE) AS arrival_px,
l_extendedprice / l_quantity * (1 + (o_orderkey % 11 - 5) / 1000.0::DOUBLE) AS decision_px, l_discount AS maker_share, l_tax AS rate, o_orderpriority AS venue
FROM orders JOIN firsts ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"""
