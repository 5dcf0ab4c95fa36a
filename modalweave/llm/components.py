"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalweave.llm.common import durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs, any order, repeats allowed). Returns node, component: the smallest node reachable.

    Only nodes of links between different nodes come back. A round is two aggregates with map-side minima and two joins,
    which Spark splits when a node has very many links; its result is written, so rounds don't lengthen the lineage.
    The number of rounds grows with the logarithm of the longest chain.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = durable(links.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low_of = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour is linked to the smallest of the neighbourhood.
        large = both.where("b > a").join(low_of, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low_of = large.groupBy("a").agg(F.min("b").alias("m"))
        # Small star: smaller neighbours and the node itself are linked to the smallest neighbour.
        small = large.join(low_of, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.unionAll(low_of.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b"), F.col("b")).distinct())
