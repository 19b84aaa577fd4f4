"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction over edges (a, b).

    Large: every node hangs its larger neighbours on its smallest neighbour.
    Small: every node hangs its smaller neighbours and itself there.
    The minimum is pre-aggregated before its shuffle, and the join back is a
    plain sort-merge join, so that a hub's rows can be split as skewed.
    """
    flip = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        near = edges.unionByName(flip)
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = near.join(low, "a")
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
    return out.where(F.col("a") != F.col("b")).distinct()


def connected(space: Workspace, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another node.

    ``edges`` has two long columns a and b, in any order, repeats allowed. The
    component is its smallest node. Each round is written to the shared
    folder; rounds grow with the logarithm of the longest chain.
    """
    now = space.save(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    seen = None
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        then = space.save(_star(_star(now, True), False))
        mark = then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        space.drop(now)
        now = then
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
