"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root``: the smallest node of its component, for every linked node but the roots themselves.

    Alternating large-star and small-star steps: every node tells its neighbours the smallest one it knows, so the
    number of rounds grows with the logarithm of the component's size and a round moves each link a few times.
    Only a count and a checksum per round reach the driver.
    """
    stars = materialised(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = checksum(stars)
    while before[0]:
        stars = materialised(small_star(large_star(stars)))
        after = checksum(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def checksum(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
