"""Connected components by alternating large-star and small-star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014. Each round is two grouped minima and
two joins; links never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.storage import discard, materialise


def _least(edges: DataFrame, least) -> DataFrame:
    """The smallest neighbour of each node, written once: a node with very many links then meets it in a join whose
    sides are both plain exchanges, which adaptive execution can split."""
    return materialise(edges.groupBy("a").agg(least.alias("m")), "least")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, F.least("a", F.min("b")))
    moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved, least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, F.min("b"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct(), least


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, one row per node that has an edge.

    The component is the smallest node reachable. Self loops and repeated edges are allowed; rows with a null end
    are ignored; no edges give an empty result.
    """
    at = materialise(edges.where("a <> b").select("a", "b"), "links")
    state = _state(at)
    while state[0]:
        large, first = _large_star(at)
        large = materialise(large, "links")
        small, second = _small_star(large)
        moved = materialise(small, "links")
        discard(at, first, second, large)
        at, before = moved, state
        state = _state(at)
        if state == before:
            break
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
