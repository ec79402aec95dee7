"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.session import materialize


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another one; the root is the smallest node reachable.

    Each round hangs all neighbours of a node on the smallest one it knows, first the larger ones, then the smaller. A
    node with very many links is only read in aggregates that combine before the shuffle and in joins with one row per
    node. Rounds are written to the shared folder; they end when nothing changes.
    """
    a, b = F.greatest(left, right), F.least(left, right)
    edges = materialize(links.select(a.alias("a"), b.alias("b")).where("a > b").distinct(), "links")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        seen = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == state:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        state = seen
