"""Connected components by alternating star contractions, in rounds written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souklens.llm.common import store


def _least(pairs: DataFrame) -> DataFrame:
    """The least neighbour of every node, reduced in each task; written, so that a hub's edges can be split."""
    return store(pairs.groupBy("a").agg(F.min("b").alias("least")), "stars")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for all nodes of the edges (``a``, ``b``).

    A large step hangs every larger neighbour of a node, a small step every smaller one, on the least of
    them. Rounds end when only stars are left; their number grows with the logarithm of the nodes.
    """
    down = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = store(edges.where("a <> b").select(*down("a", "b")).distinct(), "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        # large step: larger neighbours get the least of the node and its neighbours
        large = store(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")), "edges")
        # small step: smaller neighbours, and the node, get the least of them
        least = _least(large)
        joined = large.join(least, "a")
        small = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        now = store(small.distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Every node hangs on one other, which hangs on none."""
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    return twice.isEmpty() and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
