"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import written


def _with_least(links: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and its partners; a shuffled join, so no relation is built on the driver."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return links.join(least.hint("merge"), "u")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each v is the least node of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    tangled = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR (out > 0 AND in > 0)")
    return tangled.isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component: the smallest node reachable.

    Links are undirected and may repeat; a link of a node with itself or with null
    counts for nothing, and a table without links gives no row. Each round
    replaces a link by one to a smaller node and keeps connectivity, until stars
    are left; the number of rounds grows with the logarithm of a component's size.
    Minima are combined before they are shuffled, and the joins are plain ones that
    adaptive execution splits where one node holds many links. Rounds are written
    to the shared folder, so a lost executor costs its own tasks only.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = written(links.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "component-links")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        least = _with_least(large)
        moved = least.filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = written(least.select("u", F.col("least").alias("v")).union(moved).distinct(), "component-links")
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
