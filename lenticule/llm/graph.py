"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the component is its smallest node.

    Each round hangs every node's larger neighbours on the smallest node around it, then every node's smaller neighbours,
    until nothing changes, which takes a number of rounds that grows with the logarithm of the nodes. The smallest neighbour comes from a partial aggregate and goes back by a join, so that a hub is
    never gathered in one place; the join's skew is split by adaptive execution. Each round is written to the shared
    folder, which keeps the lineage short, and the round before it is deleted. Self-loops and repeated edges do not matter.
    """
    spark = edges.sparkSession
    current = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    current = materialise(current, "edges")
    while True:
        both = current.union(current.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(below, "hi")
        small = joined.select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        after = materialise(small.filter("hi <> lo").distinct(), "edges")
        same = _same(current, after)
        discard(spark, current.path)
        current = after
        if same:
            break
    root = current.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two sets of edges are equal, by count and order-free sums of hashes."""
    sums = [F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.hash("lo", "hi").cast("long"))]
    return x.agg(*sums).first() == y.agg(*sums).first()
