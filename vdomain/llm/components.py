"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, digest


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """`edges` (a, b: long) to (node, root): the smallest node that is reachable, for every node with an edge.

    Minima are combined before they are shuffled, and a node with very many neighbours is met by a
    join with one row per node on the other side, which adaptive execution can split. Each round is a
    table in the shared folder. Self-links only name a node.
    """
    edges = scratch.table(edges.select("a", "b").distinct())  # what finds links runs once
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = digest(e, "u", "v")
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.x).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(low, large.u == low.x).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        e = scratch.table(small, e)
        after = digest(e, "u", "v")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(e, nodes.node == e.u, "left").select("node", F.coalesce("v", "node").alias("root"))
