"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.scratch import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Hubs are never collected: the minimum is an aggregate, then joined back."""
    if large:
        around = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:  # every edge points from its larger to its smaller end
        around = edges
    least = around.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("src", "low"))
    moved = around.join(least, "src")
    if large:
        moved = moved.where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        moved = moved.select(F.explode(F.array("src", "dst")).alias("src"), F.col("low").alias("dst"))
    return (moved.where("src <> dst")
            .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, smallest: bool = True) -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the smallest node reachable.

    Edges are undirected; loops, repeats and rows with a null end are ignored. Without ``smallest``, nodes that
    are the smallest of their component have no row, and the result is one written table. Each
    round is a written table, so lineage stays short and lost executors cost one round.
    Nothing but one row of counts reaches the driver.
    """
    now = materialize(
        edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        after = materialize(_star(_star(now, True), False), "edges")
        release(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return found.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()) if smallest else found


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are a forest of stars: each larger end has one edge, no centre has one."""
    ends = edges.select("src", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("dst").alias("src"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    of = ends.groupBy("src").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return of.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] is not True
