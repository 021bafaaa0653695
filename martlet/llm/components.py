"""Connected components of a table of links, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.shared import drop, table


def _signature(edges: DataFrame) -> tuple:
    """Equal for equal tables of distinct links, and for others with a chance of about 2^-90."""
    digest = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(digest), F.sum(F.pmod(digest, F.lit(1 << 26)))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of links (a, b), the smallest node that it reaches.

    Alternates two steps until neither changes the links. Large step: a node's larger neighbours are linked to its
    smallest neighbour. Small step: its smaller neighbours are. Both keep what is connected, and the links become stars
    around the smallest nodes. Each step takes a minimum per node, summed before the shuffle, and joins it back, where
    Spark can split hot nodes. Each round is a written table, and the one before it is deleted.
    """
    a, b = F.col("a"), F.col("b")
    edges = table(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links")
    signature = _signature(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(b, a))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        # Large: every neighbour v > u of u is linked to the least of u and its neighbours.
        large = edges.select(b.alias("u"), a.alias("v")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = table(large.filter("a <> b").distinct(), "links")
        # Small: u and its smaller neighbours are linked to the least of these.
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(lowest, a == F.col("k")).select(b.alias("a"), F.col("m").alias("b")).union(lowest.select("k", "m"))
        small = table(small.filter("a <> b").distinct(), "links")
        drop(edges, large)
        edges, before, signature = small, signature, _signature(small)
        if signature == before:
            break
    return edges.select(F.col("a").alias("node"), b.alias("component")).union(edges.select(b, b).distinct())
