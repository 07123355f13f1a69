"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable), for every node that has an edge to another. The result is a stored table of one row per node.

    Every step is a min by node and a join with it. The least neighbours are stored before the join that a star's centre makes uneven, so that adaptive execution can
    split it; each round is written to the shared folder. Once every node with a lower neighbour has no other one, all components are stars, and the least neighbours are the result. A round on other
    graphs lowers the sum of the ends of the edges, so the rounds end; their number grows with the logarithm of the longest chain. Nulls and self edges are ignored.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = materialise(pair, "cc")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("lower"), F.count(F.lit(1)).alias("n"))
        low = materialise(least, "cc-low")
        if low.where("lower > 0 and n > 1").isEmpty():
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = both.where("v > u").join(low.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "cc")
