"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.plans.lineage import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest neighbour of that node."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    moved = both.join(least, "src").where("dst > src")
    return moved.select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below move to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").where("dst > m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select("src", F.col("m").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (src long, dst long)``; root is the smallest node reachable.

    Each round is written to the shared checkpoint folder, so a lost executor
    costs one round at most. The number of rounds grows with the logarithm of
    the number of nodes. Self loops are ignored; an empty edge table gives an
    empty result.
    """
    state = materialise(edges.where("src <> dst").select("src", "dst").distinct())
    seen = None
    while True:
        large = materialise(_large_star(state))
        small = materialise(_small_star(large))
        mark = small.agg(
            F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("src", "dst")), F.lit(0)), F.coalesce(F.bit_xor(F.hash("src", "dst")), F.lit(0))
        ).first()
        discard(large)
        discard(state)
        state = small
        if tuple(mark) == seen:
            return state.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(
                state.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
            )
        seen = tuple(mark)
