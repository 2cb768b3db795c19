"""Connected components of an undirected edge list, by large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a digest of their set, of any size: exclusive or has no overflow."""
    parts = [F.expr(f"bit_xor(xxhash64({i}, a, b))") for i in range(2)]
    return tuple(edges.agg(F.count(F.lit(1)), *parts).first())


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(v, label): for each vertex of the edges (a, b) the smallest vertex it is connected with.

    Each round joins every vertex with the smallest neighbour of its neighbours; aggregates have partial
    sums, joins leave hot keys to adaptive skew handling, and a reliable checkpoint ends the round.
    """
    current = cut(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct())
    state = _state(current)
    for _ in range(max_rounds):
        near = _both(current)
        least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        current = cut(small.where("a <> b").distinct())
        before, state = state, _state(current)
        if before == state:
            return current.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(
                current.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct()
            )
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
