"""Connected components of links kept in tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.session import stored


def _oriented(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller one."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every node but the roots has one link, and that to a root."""
    again = edges.groupBy("a").count().filter("count > 1").select("a")
    nested = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return again.union(nested).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node but the smallest of a component, and the smallest node of its component.

    Each round links the larger neighbours of a node to its smallest one, then a node and its smaller neighbours to the
    smallest of them, until all links lead to roots. Minima are combined before the shuffle and written before they are
    joined, so that AQE can split the links of a node that has very many. Each round is a table."""
    edges = stored(_oriented(edges), "links")
    while not _is_done(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = stored(low, "lowest")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(_oriented(large), "large-star")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(_oriented(small.union(low.select("a", F.col("m").alias("b")))), "links")
    return edges
