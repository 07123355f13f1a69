"""Window frames by rows, with minimum counts of present values."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_time(key: str = "symbol", ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts)


def at_least(agg: Column, value: Column, frame: WindowSpec, n: int) -> Column:
    """agg over the frame where it has n present values, else null."""
    return F.when(F.count(value).over(frame) >= n, agg.over(frame))


def trailing(n: int, key: str = "symbol", ts: str = "ts") -> WindowSpec:
    return by_time(key, ts).rowsBetween(-(n - 1), 0)


def past(n: int, key: str = "symbol", ts: str = "ts") -> WindowSpec:
    """The n rows before the current one."""
    return by_time(key, ts).rowsBetween(-n, -1)


def median(value: Column) -> Column:
    return F.percentile(value, F.lit(0.5))


def past_zscore(value: Column, n: int, least: int, key: str = "symbol") -> Column:
    """(value - mean) / deviation of the n earlier rows (ddof 0); null if flat or too few."""
    frame = past(n, key)
    sd = F.stddev_pop(value).over(frame)
    return F.when((F.count(value).over(frame) >= least) & (sd > 0), (value - F.avg(value).over(frame)) / sd)


def inclusive_zscore(value: Column, n: int, least: int, key: str = "symbol") -> Column:
    frame = trailing(n, key)
    sd = F.stddev_pop(value).over(frame)
    return F.when((F.count(value).over(frame) >= least) & (sd > 0), (value - F.avg(value).over(frame)) / sd)


def log_return(price: Column, key: str = "symbol") -> Column:
    """ln(price) minus that of the row before; null where either is not positive."""
    log = F.when(price > 0, F.ln(price))
    return log - F.lag(log).over(by_time(key))


def ffill(value: Column, key: str = "symbol") -> Column:
    return F.last(value, ignorenulls=True).over(by_time(key).rowsBetween(Window.unboundedPreceding, 0))


def rank_bucket(order: list, n: int, key: str | None = None) -> Column:
    """Bucket 1..n by first-come rank, with the cut points of linear quantiles (not ntile)."""
    by = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    r, total = F.row_number().over(by.orderBy(*order)), F.count(F.lit(1)).over(by)
    return F.greatest(F.lit(1), F.ceil((r - 1) * n / F.nullif(total - 1, F.lit(0)))).cast("int")
