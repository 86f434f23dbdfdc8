"""Connected components of a graph of any size by alternating stars.

``edges`` (a, b) become stars whose centre is the least node of a component:
large stars link every greater neighbour of a node to the least one around it,
small stars do the same downwards (Kiveris et al. 2014).  Each round is two
joins on partitioned edges, written to the shared folder; the driver sees one
row per round, the number of edges and a sum by which it knows that nothing
changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.session import stage


def _least(pairs: DataFrame) -> DataFrame:
    """The least node around each node, itself included."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = (both.join(_least(both), "u").filter("v > u and v > m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    large = stage(large, "stars")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return (small.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (a, b): the least node it is linked with.

    Edges may be repeated, in either direction, or join a node with itself.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == (seen["n"], seen["s"]):
            break
        state = (seen["n"], seen["s"])
        if not seen["n"]:
            break
        now = stage(_stars(now), "edges")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
