"""Connected components of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node that links reach.

    Large-star and small-star steps in turn: each node's neighbours move to the smallest among them until
    every edge is a star round its smallest node; rounds grow with the logarithm of the longest chain.  Each
    round is written to the shared folder, nothing but a count and sums reach the driver.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    was = _sum(edges)
    while was[0]:
        done = stored(_star(_star(edges, larger=True), larger=False).distinct(), "edges")
        drop_stored(edges.sparkSession, edges)
        edges, before, was = done, was, _sum(done)
        if was == before:
            break
    return edges.selectExpr("b as node", "a as component").union(edges.selectExpr("a as node", "a as component").distinct())


def joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``found`` (node, component) with further links (a, b): only whole components are joined anew."""
    nodes = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    own = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = [own.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab"]
    between = more.join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    anew = components(between).select(F.col("node").alias("component"), F.col("component").alias("now"))
    whole = found.union(own.join(found, "node", "left_anti").select("node", "component"))
    return whole.join(anew, "component", "left").select("node", F.coalesce("now", "component").alias("component"))


def _sum(edges: DataFrame) -> tuple:
    """Number of edges and two sums of hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)")), F.sum(F.xxhash64("b", F.lit(1), "a").cast("decimal(20)"))).first())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large-star: larger neighbours link to the smallest neighbour; small-star: the smaller and the node do."""
    if larger:
        both = edges.union(edges.selectExpr("b as a", "a as b"))  # node a, neighbour b
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").selectExpr("m as a", "b")
    else:
        node = edges.selectExpr("b as n", "a as s")  # node n, smaller neighbour s
        least = node.groupBy("n").agg(F.min("s").alias("m"))
        out = node.join(least, "n").selectExpr("m as a", "s as b").union(least.selectExpr("m as a", "n as b"))
    return out.where("a < b")
