"""Readers and writers of the files around a panel: bars of all fields, pair lists, volume maps, universes, screeners, a store of fundamentals, result pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.scalars import normalize_symbol, pair_leg
from tidepanel.sources.panel import nan_to_null, resolve_column

FIELDS = ("open", "high", "low", "close", "volume")


def read_table(spark: SparkSession, path: str, fmt: str | None = None, sep: str = ",") -> DataFrame:
    """A table by its format, or by the end of its path: parquet, csv, tsv, json."""
    kind = fmt or next((k for k in ("csv", "tsv", "json") if path.rstrip("/").lower().endswith(k)), "parquet")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.json(path)
    return spark.read.option("header", True).option("sep", "\\t" if kind == "tsv" else sep).csv(path)


def read_bars(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """symbol, ts (date), open, high, low, close, volume from a long table (missing fields are null), or from a wide one with a column per symbol and field (A_close) or per symbol (A: its close)."""
    raw = read_table(spark, path, fmt)
    ts = F.to_date(F.try_to_timestamp(F.col(resolve_column(raw, ("ts", "date", "timestamp", "time"))).cast("string")))
    names = {c.lower(): c for c in raw.columns}
    value = lambda c: nan_to_null(F.expr(f"try_cast(`{c}` AS double)"))
    if "symbol" in names or "ticker" in names:
        symbol = F.upper(F.trim(F.col(resolve_column(raw, ("symbol", "ticker")))))
        found = {f: value(names[f]) if f in names else F.lit(None).cast("double") for f in FIELDS}
        return raw.select(symbol.alias("symbol"), ts.alias("ts"), *[c.alias(f) for f, c in found.items()]).where("ts is not null")
    cells = []
    for c in raw.columns:
        if c.lower() in ("ts", "date", "timestamp", "time"):
            continue
        head, _, tail = c.rpartition("_")
        field = tail.lower() if head and tail.lower() in FIELDS else "close"
        cells.append(F.struct(F.lit((head if head and tail.lower() in FIELDS else c).upper()).alias("symbol"), F.lit(field).alias("field"), value(c).alias("value")))
    long = raw.select(ts.alias("ts"), F.inline(F.array(*cells))).where("ts is not null and value is not null")
    return long.groupBy("symbol", "ts").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])


def read_pairs(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """left, right of a list of pairs: two columns, or one that holds both; pairs of one symbol and repeats go."""
    raw = read_table(spark, path, fmt)
    names = {c.lower() for c in raw.columns}
    two = next((p for p in (("left", "right"), ("y", "x"), ("t1", "t2"), ("symbol_1", "symbol_2")) if set(p) <= names), None)
    pair = None if two else F.col(resolve_column(raw, ("pair", "pairs", "name")))
    legs = [F.col(resolve_column(raw, (n,))) for n in two] if two else [pair_leg(pair, 0), pair_leg(pair, 1)]
    return raw.select(F.upper(F.trim(legs[0])).alias("left"), F.upper(F.trim(legs[1])).alias("right")).where("left <> right and left <> '' and right <> ''").distinct()


def read_adv(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """symbol, adv: positive numbers only, the largest of repeated symbols."""
    raw = read_table(spark, path, fmt)
    adv = nan_to_null(F.expr(f"try_cast(`{resolve_column(raw, ('adv', 'dollar_adv', 'adv_usd', 'value'))}` AS double)"))
    return raw.select(normalize_symbol(F.col(resolve_column(raw, ("symbol", "ticker")))).alias("symbol"), adv.alias("adv")).where("adv > 0").groupBy("symbol").agg(F.max("adv").alias("adv"))


def write_adv(adv: DataFrame, path: str) -> None:
    adv.select("symbol", "adv").write.mode("overwrite").parquet(path)


def read_universe(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """symbol, start_date, end_date of a universe file; open ends are null, blank symbols go."""
    raw = read_table(spark, path, fmt)
    names = {c.lower(): c for c in raw.columns}
    day = lambda *n: next((F.to_date(F.try_to_timestamp(F.col(names[x]).cast("string"))) for x in n if x in names), F.lit(None).cast("date"))
    symbol = normalize_symbol(F.col(resolve_column(raw, ("symbol", "ticker"))))
    return raw.select(symbol.alias("symbol"), day("start_date", "start", "from").alias("start_date"), day("end_date", "end", "to").alias("end_date")).where("symbol <> ''")


def read_screener(spark: SparkSession, path: str, columns: Sequence[str] = ("symbol", "name", "sector", "industry", "market cap", "country")) -> DataFrame:
    """A screener's CSV: symbols normalised, numbers freed of $ , and %, columns in snake case, repeated symbols once."""
    raw = read_table(spark, path, "csv")
    names = {c.lower().strip(): c for c in raw.columns}
    out = raw.select(*[F.trim(F.col(names[c])).alias(c.replace(" ", "_")) for c in columns if c in names])
    if "market_cap" in out.columns:
        out = out.withColumn("market_cap", F.expr("try_cast(regexp_replace(market_cap, '[$,%]', '') AS double)"))
    return out.withColumn("symbol", normalize_symbol(F.col("symbol"))).where("symbol <> ''").dropDuplicates(["symbol"])


class Fundamentals:
    """A store of rows (symbol, updated_at, fields): appended to, read as the last row of each symbol."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def latest(self, max_age_days: int | None = None) -> DataFrame:
        """The last row of each symbol; with max_age_days only those not older than that before the store's newest row."""
        rows = self.spark.read.option("mergeSchema", True).parquet(self.path)
        last = rows.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "symbol"]), "updated_at").alias("r")).select("symbol", "r.*")
        if max_age_days is None:
            return last
        newest = rows.agg(F.max("updated_at").alias("_newest"))  # one row
        return last.join(F.broadcast(newest)).where(F.datediff("_newest", "updated_at") <= max_age_days).drop("_newest")


def write_both(df: DataFrame, path: str) -> None:
    """A small report as Parquet and as CSV beside it."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_pairs(selected: DataFrame, path: str) -> None:
    """Selected pairs with their statistics, partitioned by nothing and sorted by pair: one small table."""
    selected.orderBy("pair").write.mode("overwrite").parquet(path)
