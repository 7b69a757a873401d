"""Connected components of an edge table: alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = edges.where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its smallest node.

    Each round is written to the shared folder, so that the plan does not grow with the rounds. The number of rounds
    grows with the logarithm of the longest path. Nodes without an edge do not appear.
    """
    stars = written(edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        last, mark = mark, stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == last or mark[0] == 0:
            break
        stars = written(_small_star(_large_star(stars)), "edges")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return roots.union(stars.select(F.col("a").alias("node"), F.col("b").alias("component")))
