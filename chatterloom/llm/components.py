"""Connected components by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join, so a node with very many neighbours is never gathered in
one task: the minimum is combined before the shuffle, and adaptive execution splits the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.sources.staging import StagingArea


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v")))


def components(edges: DataFrame, area: StagingArea, name: str) -> DataFrame:
    """`(node, component)` for every node of `edges` (u, v); a component is named by its least node.

    Loops and repeated edges do no harm; nodes without an edge to another node are not listed. Rounds
    are staged in the shared folder and go on until one leaves the edges as they were.
    """
    current = area.stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{name}-0",
    )
    before, number = None, 0
    while True:
        state = tuple(
            current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        )
        if state == before or not state[0]:
            break
        before, number = state, number + 1
        moved = _small_star(_large_star(current)).where("u <> v").distinct()
        current = area.stage(moved, f"{name}-{number}")
    return current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")\
        .union(current.select("v", F.col("v").alias("component")).distinct())
