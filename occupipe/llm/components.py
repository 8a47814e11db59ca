"""Connected components of links between numbers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occupipe.session import through_table


def _signature(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.sum(hashed.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(hashed, 32))).first()
    return tuple(row)


def components(links: DataFrame, one: str, other: str) -> DataFrame:
    """``node`` and ``root``, the smallest number its node can reach, for every linked node.

    Each round ties every node's larger neighbours, then its smaller ones, to the smallest of
    them. Rounds grow with the logarithm of the longest chain. Minima are aggregated in the map
    tasks and joined back, so the neighbours of a hub are never gathered in one task. Each
    round's links are written to the shared folder, which cuts the lineage.
    """
    pair = links.select(F.greatest(one, other).alias("a"), F.least(one, other).alias("b"))
    edges = through_table(pair.filter("a <> b").distinct())
    known = _signature(edges)
    while known[0]:
        ways = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = through_table(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(edges)
        if now == known:
            break
        known = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
