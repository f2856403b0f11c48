"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """``(u, m)``: the smallest of each ``u`` and all its ``v``."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """For edges whose ``u`` is the larger end."""
    least = _smallest(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).filter("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``, where ``root`` is the smallest node reachable.

    Each round is two group-bys and joins on narrow rows; the number of rounds
    grows with the logarithm of the longest path. Repeated links, links of a
    node with itself and an empty table are allowed; nodes are not null.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    before = None
    mark = _mark(edges)
    while mark[0] and mark != before:
        before = mark
        edges = stored(_small_star(_large_star(edges)), "stars")
        mark = _mark(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
