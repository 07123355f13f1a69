"""Declared constraints over tables, and what breaks them: one row per rule with how many rows do and the first of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHAPE = ["code", "severity", "n", "n_bad", "first_bad", "last_bad"]


@dataclass(frozen=True)
class Rule:
    """A row of a table breaks the rule where `bad` holds; it is told by `name` (a string column)."""

    code: str
    severity: str
    bad: Column
    name: Column


def check_rows(table: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: code, severity, n, n_bad, first_bad and last_bad (by name). One pass and one aggregation for all rules of a table."""
    hit = lambda r: F.coalesce(r.bad, F.lit(False))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, r in enumerate(rules):
        named = F.when(hit(r), r.name.cast("string"))
        aggs += [F.count_if(hit(r)).alias(f"b{i}"), F.min(named).alias(f"f{i}"), F.max(named).alias(f"l{i}")]
    one = table.agg(*aggs)
    rows = [F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.col("n"), F.col(f"b{i}").alias("n_bad"), F.col(f"f{i}").alias("first_bad"), F.col(f"l{i}").alias("last_bad")) for i, r in enumerate(rules)]
    return one.select(F.inline(F.array(*rows)))


def check_unique(table: DataFrame, code: str, severity: str, keys: Sequence[str]) -> DataFrame:
    """Keys that more rows than one have."""
    counted = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return check_rows(counted, [Rule(code, severity, F.col("_n") > 1, F.concat_ws("/", *keys))])


def check_referred(table: DataFrame, other: DataFrame, code: str, severity: str, keys: Sequence[str]) -> DataFrame:
    """Keys of a table that another one lacks."""
    have = other.select(*keys).distinct().withColumn("_there", F.lit(True))
    return check_rows(table.select(*keys).distinct().join(have, list(keys), "left"), [Rule(code, severity, F.col("_there").isNull(), F.concat_ws("/", *keys))])


def report(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*_SHAPE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_SHAPE))
    return out


#: Bounds of a yearly borrow rate.
RATE_MIN, RATE_MAX = 0.0001, 0.5


def check_borrow(rates: DataFrame, symbols: DataFrame, availability: DataFrame | None = None) -> DataFrame:
    """Checks of borrow inputs: rates (symbol, ts, rate_annual) missing or out of bounds, symbols without a rate; of availability (symbol, ts, available) unknown symbols and negative numbers."""
    name = F.concat_ws("/", "symbol", "ts")
    rate = F.col("rate_annual")
    parts = [
        check_rows(rates, [Rule("RATE_MISSING", "fail", rate.isNull() | F.isnan(rate), name), Rule("RATE_OUT_OF_BOUNDS", "warn", ~rate.between(RATE_MIN, RATE_MAX), name)]),
        check_referred(symbols, rates, "SYMBOL_WITHOUT_RATE", "warn", ["symbol"]),
    ]
    if availability is not None:
        parts += [check_referred(availability, symbols, "AVAILABILITY_OF_UNKNOWN_SYMBOL", "warn", ["symbol"]), check_rows(availability, [Rule("AVAILABILITY_NEGATIVE", "fail", F.col("available") < 0, name)])]
    return report(*parts)


def check_universe(listed: DataFrame, prices: DataFrame, volumes: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Checks of a universe's outputs: listed (symbol), prices (symbol, ts, open, high, low, close), volumes (symbol, ts, volume), fundamentals (symbol, ...)."""
    row = F.concat_ws("/", "symbol", "ts")
    day = F.to_date("ts")
    days = prices.select("ts").distinct()
    per_day = days.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("_n"))
    ohlc = [F.col(c) for c in ("open", "high", "low", "close")]
    return report(
        check_unique(listed, "TICKERS_DUPLICATES", "error", ["symbol"]),
        check_referred(listed, prices, "TICKERS_WITHOUT_PRICES", "error", ["symbol"]),
        check_referred(prices, listed, "PRICES_OF_UNLISTED", "error", ["symbol"]),
        check_referred(listed, fundamentals, "FUNDAMENTALS_MISSING", "warn", ["symbol"]),
        check_unique(prices, "PRICE_INDEX_ORDER", "error", ["symbol", "ts"]),
        check_referred(prices, volumes, "INDEX_MISMATCH", "error", ["symbol", "ts"]),
        check_rows(per_day, [Rule("MULTIPLE_TIMES_PER_DAY", "error", F.col("_n") > 1, F.col("day"))]),
        check_rows(days, [Rule("WEEKEND_ROWS", "warn", F.weekday("ts") >= 5, F.col("ts"))]),
        check_rows(
            prices,
            [
                Rule("PRICE_NOT_POSITIVE", "error", F.least(*ohlc) <= 0, row),
                Rule("HIGH_BELOW_LOW", "error", F.col("high") < F.col("low"), row),
                Rule("OHLC_BROKEN", "warn", (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")), row),
                Rule("CLOSE_MISSING", "warn", F.col("close").isNull(), row),
            ],
        ),
        check_rows(volumes, [Rule("VOLUME_NEGATIVE", "error", F.col("volume") < 0, row), Rule("VOLUME_ZERO", "warn", F.col("volume") == 0, row)]),
    )
