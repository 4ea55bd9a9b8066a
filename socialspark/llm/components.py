"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the undirected ``edges`` ``(u, v)``; the root is the least of its component.

    Rounds of two steps: first every node sends its least neighbour to its greater
    neighbours, then to its smaller ones. Edges never become more, and depth shrinks by
    halves, so rounds grow with the logarithm of the longest path. The least is taken by an
    aggregate that combines before its exchange and joined back, so a node with very
    many neighbours never gathers them in one task. Each round is cut into the shared folder.
    """
    edges = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("m")), F.struct(F.col("v").alias("a"), F.col("m").alias("m")))).alias("e"))
            .select(F.col("e.a").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
