"""Connected components by alternating star contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize


#: Rows (of 16 bytes) that one task can take whatever their keys.
ONE_TASK = 1 << 18


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (a, b), about ``total`` of them, with the least b of each a.  The centre of a large
    star holds a large share of the rows: such nodes are looked up by broadcast, unless one task
    could take all rows."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if total <= ONE_TASK:
        return rows.join(least.drop("n"), "a")
    return lookup(rows, materialize(least, "least"), "a", "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    near = _with_least(_both_ways(edges), 2 * total).withColumn("m", F.least("a", "m"))
    return near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = _with_least(down, total)
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(joined.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component.

    The smallest nodes label themselves.  Self-links and repeated links are allowed.  Each round is
    written to the shared folder, so a lost executor costs one round at most; the number of rounds
    grows with the logarithm of the longest chain.
    """
    current = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen or not state["n"]:
            break
        seen = (state["n"], state["h"])
        large = materialize(_large_star(current, state["n"]), "large-star")
        current = materialize(_small_star(large, state["n"]), "star")
    return (
        current.select(F.col("a").alias("node"), F.col("b").alias("label"))
        .unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")))
        .distinct()
    )
