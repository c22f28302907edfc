"""Connected components by alternating stars, in DataFrame joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, hot_rows, materialise, split_join

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    Large-star and small-star steps alternate until nothing changes: each node points to
    the smallest neighbour it knows of, and the number of edges never grows. A node's
    neighbours are never gathered: its minimum is an aggregate that is joined back, for
    nodes of many neighbours without moving these.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star-edges")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "star-least")
        hot = hot_keys(least, ["a"], "n", hot_rows(links.sparkSession, 2 * before[0]))
        large = split_join(both, least.drop("n"), ["a"], hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Every large-star edge points down, so a node's smaller neighbours are its "b"s; it has no more of them than neighbours before.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, low, ["a"], hot).select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))).where("a <> b").distinct()
        edges = materialise(small, "star-edges")
        if (after := _state(edges)) == before:
            break
        before = after
    else:
        raise RuntimeError("components have not settled")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
