"""Connected components of an undirected edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetshape.llm.frames import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = stored(around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them (edges run from larger to smaller)."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    tied = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", "m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long, not null); root is the least node reachable.

    Each round is two groupings, each with a join; rounds grow with the logarithm of the longest
    path. A hub with many neighbours is pre-aggregated before its shuffle. What it is joined with
    is a written table: Spark knows its size, and a join of two plain shuffles is one that
    adaptive execution splits where a hub is large. Loops and repeated edges change nothing; an
    empty table gives an empty one.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(stored(_large_star(edges), "large-stars")).distinct(), "stars")
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
