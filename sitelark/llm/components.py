"""Connected components of a large edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of an edge.

    edges: a, b (longs, a != b, in any direction, repeats allowed). Returns node, component; nodes without an edge are not in it.
    Each step aggregates by node and joins the minimum back, so that a node with very many edges is never gathered in a list;
    each step's edges are written, and the number of steps is logarithmic in the longest path.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        after = written(_small_star(_large_star(now)), "edges")
        changed = not (_same(now) == _same(after))
        dropped(now)
        now = after
        if not changed:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def _same(edges: DataFrame) -> tuple:
    """A count and two sums of hashes: alike for the same set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where(F.col("v") > F.col("u")).join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Each smaller neighbour, and u itself, is tied to the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
