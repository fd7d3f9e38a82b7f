"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node with a link; ``root`` is the least node reachable.

    ``edges`` has long columns u > v. Each round is written to the shared folder, so lineage stays
    short. The number of rounds is logarithmic; only one row of sums comes to the driver per round.
    """
    state = settle(edges.select("u", "v"), "edges")
    seen = None
    for _ in range(rounds):
        state = settle(_small_star(_large_star(state).distinct()).distinct(), "edges")
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(now)
    raise RuntimeError("components did not settle")
