"""Connected components of an edge table, by rounds of contraction.

Each round every node takes the smallest node it touches (or itself), and the edges
move to those; nodes at least halve on random ids, so rounds grow with the logarithm of the
longest chain.  All steps are joins and map-side combined minima; a hub's edges are split by
the engine's skew handling, and nothing is collected but a yes or no a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowtrace.llm.common import pinned


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b) of type long; no rows without edges."""
    rounds: list[DataFrame] = []
    edges = pinned(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = pinned(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "roots")
        rounds.append(up)
        moved = edges.join(up.withColumnRenamed("root", "ra"), F.col("a") == F.col("node")).select("ra", "b")
        moved = moved.join(up.withColumnRenamed("root", "rb"), F.col("b") == F.col("node")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = pinned(moved.where("a <> b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a node's root of the last round, carried back to the first
    last = rounds.pop()
    while rounds:
        before = rounds.pop()
        step = last.select(F.col("node").alias("root"), F.col("root").alias("top"))
        last = pinned(before.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    return last
