"""Connected components of a pair graph, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b.  Large: every larger neighbour of a node gets the smallest node around it.
    Small: every smaller neighbour, and the node itself, does."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")))
    # Both sides are plain shuffles, so adaptive execution splits the partition of a node with very many edges.
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return checkpoint(out.where("a > b").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at most to a smaller node, which has none itself.

    One count by node of the edges down and up, combined before the shuffle, in a single job.
    """
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("node"), one.alias("down"), none.alias("up")).unionByName(edges.select(F.col("b").alias("node"), none.alias("down"), one.alias("up")))
    by = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not by.agg(F.bool_or((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0))).first()[0]


def connected_components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """node and component, the least node, of all nodes that a pair ties to another one.

    Nodes are numbers or strings.  Each step is a minimum by node, combined before the shuffle, and a join of the
    edges with those minima; only one truth value comes to the driver.  Every step that isn't the last moves some edge to
    a smaller node, so the steps end; they grow with the logarithm of the longest path.
    """
    real = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    edges = checkpoint(real.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct())
    while not _settled(edges):
        edges = _star(_star(edges, True), False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def cluster_statistics(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs, nodes, clusters, clusters of more than two, and the size of the largest."""
    sizes = connected_components(pairs, left, right).groupBy("component").agg(F.count("*").alias("n"))
    return pairs.agg(F.count("*").alias("pairs")).crossJoin(
        sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count("*").alias("clusters"), F.count_if(F.col("n") > 2).alias("over_two"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    )


def survivors(nodes: DataFrame, components: DataFrame, key: str, quality: str) -> DataFrame:
    """Each node's survivor: the best of its component, the smaller key if equal."""
    joined = nodes.select(F.col(key).alias("node"), F.col(quality).alias("q")).join(components, "node")
    best = joined.groupBy("component").agg(F.min_by("node", F.struct((-F.col("q")).alias("q"), "node")).alias("survivor"))
    return joined.join(best, "component").select("node", "component", "survivor")
