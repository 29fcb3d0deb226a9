"""Connected components by hooking and pointer jumping over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deflow.llm import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each node of ``links`` can reach.

    Large-star and small-star rounds: a round joins nothing, it groups edges by one end, and the minimum is
    spread along them. A node with very many neighbours is not gathered: its minimum is an aggregate that
    is joined back, which adaptive execution splits. The number of rounds grows with the logarithm of the
    longest chain; each ends in a table in the shared folder.
    """
    edges = common.written(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x > y").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x > y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(low, "x")
        small = joined.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y"))).where("x > y").distinct()
        new = common.written(small, "edges")
        if not new.join(edges, ["x", "y"], "left_anti").limit(1).count() and not edges.join(new, ["x", "y"], "left_anti").limit(1).count():
            break
        edges = new
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(
        edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
