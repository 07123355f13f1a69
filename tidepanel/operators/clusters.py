"""Hierarchical clustering with average linkage on a table of distances, in rounds.

A round finds every cluster's nearest neighbour and merges all pairs that are each other's nearest at once: average linkage never brings a merged pair nearer to others than the nearer of
the two was, so such pairs would be merged one after the other anyway. A pair of clusters carries the sum of its leaves' distances and the clusters' sizes, so the distance of merged clusters is a sum by key.
The number of rounds follows the depth of the tree, not the number of merges; no task holds the matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.storage import Rounds


def correlation_distances(pairs: DataFrame) -> DataFrame:
    """left, right, d: sqrt(2 (1 - corr)), 0 at least. pairs: left, right, corr. A missing correlation raises an error when it is read."""
    corr = F.coalesce(F.nanvl("corr", F.lit(None)), F.raise_error(F.lit("missing correlation")).cast("double"))
    return pairs.select("left", "right", F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - corr))).alias("d"))


def agglomerate(distances: DataFrame, height: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Merges and, per symbol, its cluster. distances: left, right, d of all pairs of symbols, each once.

    Merges: step (from 0, by height), a and b (numbers of the merged clusters, a < b: symbols by name from 0, then the cluster of step k is number of symbols + k), height, size.
    Clusters: symbol, cluster: the first symbol (by name) of the cluster that it is in when merges up to `height` are made (none: of all).
    Equal distances: the pair with the lower numbers is the nearer one.
    """
    spark = distances.sparkSession
    rounds = Rounds(spark, "clusters")
    names = distances.select(F.col("left").alias("symbol")).union(distances.select(F.col("right").alias("symbol"))).distinct()
    leaves = rounds.put(names.withColumn("leaf", (F.row_number().over(Window.orderBy("symbol")) - 1).cast("long")))  # one row per symbol
    n = leaves.count()
    number = lambda side: leaves.select(F.col("symbol").alias(side), F.col("leaf").alias(f"{side}_no"))
    numbered = distances.join(number("left"), "left").join(number("right"), "right")
    a, b = F.least("left_no", "right_no"), F.greatest("left_no", "right_no")
    now = rounds.put(numbered.select(a.alias("a"), b.alias("b"), F.col("d").alias("s"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    where = rounds.put(leaves.withColumns({"of": F.col("leaf"), "cluster": F.col("leaf")}))
    merges, step = [], 0
    while not now.isEmpty():
        near = now.select("a", "b", "na", "nb", (F.col("s") / (F.col("na") * F.col("nb"))).alias("d"))
        edge = F.struct("d", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("na") + F.col("nb")).alias("size"))
        nearest = near.select(F.explode(F.array("a", "b")).alias("node"), edge.alias("e")).groupBy("node").agg(F.min("e").alias("e"))
        both = nearest.groupBy("e").count().where("count = 2").select("e.lo", "e.hi", F.col("e.d").alias("height"), "e.size")
        step += 1
        # a cluster is named by the round and its first leaf, which is that of its lower part
        made = rounds.put(both.withColumn("id", F.lit(step * n) + F.col("lo") % n).withColumn("round", F.lit(step)))
        merges.append(made)
        to = made.select(F.explode(F.array("lo", "hi")).alias("old"), "id", "size", "height")
        swap = lambda side: to.select(F.col("old").alias(side), F.col("id").alias(f"id_{side}"), F.col("size").alias(f"size_{side}"))
        moved = now.join(swap("a"), "a", "left").join(swap("b"), "b", "left")
        x, y = F.coalesce("id_a", "a"), F.coalesce("id_b", "b")
        nx, ny = F.coalesce("size_a", "na"), F.coalesce("size_b", "nb")
        first = x % n < y % n  # numbers follow the clusters' first leaves
        out = moved.where(x != y).select(F.when(first, x).otherwise(y).alias("a"), F.when(first, y).otherwise(x).alias("b"), "s", F.when(first, nx).otherwise(ny).alias("na"), F.when(first, ny).otherwise(nx).alias("nb"))
        last, now = now, rounds.put(out.groupBy("a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb")))
        within = F.lit(True) if height is None else F.col("height") <= height
        moved = where.join(to.withColumnRenamed("old", "of"), "of", "left")
        before, where = where, rounds.put(moved.select("symbol", "leaf", F.coalesce("id", "of").alias("of"), F.when(F.col("id").isNotNull() & within, F.col("id") % n).otherwise(F.col("cluster")).alias("cluster")))
        rounds.drop(last)
        rounds.drop(before)
    names = leaves.select(F.col("leaf").alias("cluster"), F.col("symbol").alias("name"))
    clusters = where.join(names, "cluster").select("symbol", F.col("name").alias("cluster"))
    if not merges:
        return spark.createDataFrame([], "step long, a long, b long, height double, size long"), clusters
    every = merges[0]
    for part in merges[1:]:
        every = every.unionByName(part)
    order = Window.orderBy("height", "round", "lo")  # one row per symbol at most
    every = every.withColumn("step", F.row_number().over(order) - 1)
    known = every.select(F.col("id").alias("temporary"), (F.col("step") + n).alias("no"))
    last = lambda side: known.select(F.col("temporary").alias(side), F.col("no").alias(f"{side}_no"))
    at = every.join(last("lo"), "lo", "left").join(last("hi"), "hi", "left").select("step", F.coalesce("lo_no", "lo").alias("x"), F.coalesce("hi_no", "hi").alias("y"), "height", "size")
    return at.select(F.col("step").cast("long").alias("step"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "height", "size"), clusters
