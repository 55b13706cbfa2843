"""Connected components of a graph of links, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitus.llm.common import stage


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _linked_to_least(near: DataFrame) -> DataFrame:
    """`near` (u, v) with `least`, the smallest of u and its neighbours; the minimum is taken before rows meet."""
    least = near.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return near.join(stage(least, "least"), "u")


def components(links: DataFrame) -> DataFrame:
    """`links` (a, b: bigint) as node, root: the smallest node of its component, for all nodes with a link.

    Each round ties every node's larger neighbours to its smallest one, then its smaller neighbours to the
    smallest of them, until only stars are left; the number of rounds grows with the logarithm of the nodes.
    """
    edges = stage(_distinct(links), "edges")
    seen = None
    while True:
        print_of = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_of == seen:
            break
        seen = print_of
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _linked_to_least(both).filter("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
        larger = stage(_distinct(large), "large")
        down = larger.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _linked_to_least(down)
        edges = stage(
            _distinct(
                small.select(F.col("v").alias("a"), F.col("least").alias("b")).unionByName(
                    small.select(F.col("u").alias("a"), F.col("least").alias("b"))
                )
            ),
            "edges",
        )
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
