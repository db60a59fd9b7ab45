"""Connected components of a graph of keys, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, are tied to the smallest of them. ``a`` is the larger end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): the smallest node of each one's component.

    An edge of a node with itself names a node without neighbours; nulls name none. Each round writes its edges and
    compares two sums of them with those of the round before; the number of rounds grows with the logarithm of the
    number of nodes, and a graph that hasn't settled after ``most_rounds`` is an error, not a wrong answer.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    links = nodes.filter(F.col("a") != F.col("b"))
    sums = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = sums(links)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        links = cut_lineage(_small_star(_large_star(links)))
        now = sums(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    every = nodes.select(F.col("a").alias("node")).unionByName(nodes.select(F.col("b").alias("node"))).distinct()
    return every.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
