"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, spill


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step: each neighbour above u gets u's smallest neighbour (or u)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """One small-star step: u and its neighbours below it get the smallest of them.  Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Each round is written to the shared folder, so nothing is lost with an executor and no plan grows.
    Hubs are joined by key, where adaptive execution splits the hot side.
    """
    now = spill(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(limit):
        after = spill(_small(_stars(now)), "edges")
        forget(now)
        now, seen = after, state
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())
        if state == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
