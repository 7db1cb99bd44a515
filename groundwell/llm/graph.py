"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import saved


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); root is the smallest node reachable.

    Alternates large-star and small-star steps: every node's neighbours are hung on its
    smallest neighbour until nothing changes, in a number of rounds that grows with the
    logarithm of the longest chain. Minima are taken before the shuffle; a hub's neighbours
    are rows that a skewed join can split, never a list. Each round is written to the shared
    folder. Null ends and loops are passed over; an empty table gives an empty one.
    """
    edges = saved(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
        edges = saved(_small_star(_large_star(edges)))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u on the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), "m")
    return moved.unionByName(least).distinct().select("u", F.col("m").alias("v"))
