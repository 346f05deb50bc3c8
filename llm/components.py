"""Connected components of a link table, by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of links(a long, b long) but the roots themselves.

    Each round moves edges to the smallest neighbour, first of larger and then of smaller nodes,
    until no edge changes; rounds grow with the logarithm of the longest path. Minima are
    aggregated before the shuffle, so a node with very many neighbours is no large group.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct(), "links")
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
