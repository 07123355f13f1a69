"""Cross-validation folds over the rows of a table: blocks of neighbouring rows, purged and embargoed.

Rows are numbered by prefix sums over ranges of their order, so no task numbers all of them. Of n rows the first n mod blocks blocks are one row longer. What a fold does with a block is an interval of row
numbers, worked out from n alone; rows meet the intervals of their block by an equi-join.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.reports import prefix_sums


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds i, the row's place (from 0) by a numeric column that no two rows share."""
    at = prefix_sums(rows.withColumn("_one", F.lit(1.0)), order, ["_one"])
    return at.withColumn("i", (F.col("cum__one") - 1).cast("long")).drop("_one", "cum__one")


def boundaries(n: int, blocks: int) -> list[int]:
    return [b * (n // blocks) + min(b, n % blocks) for b in range(blocks + 1)]


def embargo_rows(embargo: float, block: int) -> int:
    """A whole number is rows, a fraction is a share of the block, rounded up."""
    return 0 if embargo <= 0 else int(embargo) if float(embargo).is_integer() else math.ceil(embargo * block)


def intervals(n: int, blocks: int, tests: list[tuple[int, ...]], purge: int, embargo: float, together: bool = False, trim: bool = True) -> list[tuple[int, int, str, int, int]]:
    """(fold, block, part, lo, hi) of the rows that each fold uses of each block.

    Test blocks lose purge rows in front and purge + embargo behind (trim; together: the stretch of test blocks as a whole). Training blocks lose purge + embargo on each side next to a test block.
    A fold without test rows is none.
    """
    cuts, out = boundaries(n, blocks), []
    for fold, chosen in enumerate(tests):
        left, right = cuts[chosen[0]], cuts[chosen[-1] + 1]
        found = []
        for b in range(blocks):
            lo, hi = cuts[b], cuts[b + 1]
            if b in chosen:
                start, end = (left, right) if together else (lo, hi)
                if trim:
                    first = min(end, start + purge)
                    last = max(first, end - purge - embargo_rows(embargo, end - start))
                    lo, hi = max(lo, first), min(hi, last)
                part = "test"
            else:
                gap = purge + embargo_rows(embargo, hi - lo)
                lo, hi = lo + gap * (b - 1 in chosen), hi - gap * (b + 1 in chosen)
                part = "train"
            if hi > lo:
                found.append((fold, b, part, lo, hi))
        if any(part == "test" for _, _, part, _, _ in found):
            out += found
    return out


def combinations(blocks: int, k: int, most: int | None = None) -> list[tuple[int, ...]]:
    """Every choice of k test blocks in order, or the first `most`."""
    return list(itertools.islice(itertools.combinations(range(blocks), k), most))


def runs(blocks: int, k: int, most: int | None = None) -> list[tuple[int, ...]]:
    """Every k neighbouring blocks in order, or the first `most`."""
    return [tuple(range(b, b + k)) for b in range(blocks - k + 1)][:most]


def fold_rows(rows: DataFrame, order: str, blocks: int, tests: list[tuple[int, ...]], purge: int = 0, embargo: float = 0, together: bool = False, trim: bool = True) -> DataFrame:
    """rows x fold with i, fold and part: test, train, or dropped. Empty if there are fewer rows than blocks. Folds are as many as `tests` says; counts the rows once."""
    n = rows.count()
    if blocks < 2 or n < blocks or not tests or not all(0 < len(t) < blocks for t in tests):
        return rows.limit(0).selectExpr("*", "0L AS i", "0 AS fold", "'' AS part")
    spark, (size, more) = rows.sparkSession, divmod(n, blocks)
    used = intervals(n, blocks, tests, purge, embargo, together, trim)
    folds = sorted({u[0] for u in used})
    have = {(f, b) for f, b, *_ in used}
    used += [(f, b, "dropped", 0, 0) for f in folds for b in range(blocks) if (f, b) not in have]
    table = spark.createDataFrame(used, "fold int, _block int, _part string, _lo long, _hi long")  # folds x blocks
    block = F.when(F.col("i") < more * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(more + F.floor((F.col("i") - more * (size + 1)) / size)).cast("int")
    at = numbered(rows, order).withColumn("_block", block).join(F.broadcast(table), "_block")
    inside = (F.col("i") >= F.col("_lo")) & (F.col("i") < F.col("_hi"))
    return at.withColumn("part", F.when(inside, F.col("_part")).otherwise("dropped")).drop("_block", "_part", "_lo", "_hi")
