"""Connected components of edges, by alternating stars, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm import common


def _least(edges: DataFrame, neighbours: str) -> DataFrame:
    """The least of each node and its (``neighbours``: all, or smaller) neighbours; partial minima come before the shuffle."""
    return edges.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")) if neighbours == "all" else edges.where("b < a").groupBy("a").agg(F.min("b").alias("least"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) from (a, b): the least node of each component, for every node that has an edge to another.

    Each round links the larger neighbours of a node, then the smaller ones, to the least of them, until every edge leads
    to a root. Nodes with many edges are joined with one row each: these least neighbours are stored before they are
    joined, so that either side of a join comes from an exchange of its own and Spark can split a hub. Each round is stored.
    """
    edges = common.stored(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), name)
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # larger neighbours of each node to the least of all its neighbours
        large = both.where("b > a").join(common.stored(_least(both, "all"), name), "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        # smaller neighbours, and the node, to the least of them
        down = common.stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
        least = common.stored(_least(down, "smaller"), name)
        small = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b"))).distinct()
        edges = common.stored(small, name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
