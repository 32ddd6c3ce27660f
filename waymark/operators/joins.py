"""Joins with contracts, intervals and distance, each as an equi-join on a derived key plus an exact filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Counts of matched, left-only, right-only and differing rows of two products."""
    l = left.select(*key, *[F.col(v).alias(f"l_{v}") for v in values], F.lit(1).alias("_l"))
    r = right.select(*key, *[F.col(v).alias(f"r_{v}") for v in values], F.lit(1).alias("_r"))
    both = l.join(r, key, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"l_{v}").eqNullSafe(F.col(f"r_{v}"))
    present = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    count = lambda c, n: F.count_if(c).alias(n)
    return both.agg(count(present & same, "equal_rows"), count(present & ~same, "different"),
                    count(F.col("_r").isNull(), "left_only"), count(F.col("_l").isNull(), "right_only"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")


def key_violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def overlap_bins(spans: DataFrame, start: str, end: str, width_s: int) -> DataFrame:
    """One row per span and time bin it overlaps (start < bin end, end > bin start), by exploding bins.

    start, end: epoch seconds. ``bin``: epoch second of the bin's start; ``overlap_s``: clipped length (A50).
    """
    first = F.floor(F.col(start) / width_s)
    last = F.greatest(first, F.ceil(F.col(end) / width_s) - 1)
    out = spans.where(F.col(end) > F.col(start)).withColumn("bin", F.explode(F.transform(F.sequence(first, last), lambda b: b * width_s)))
    return out.withColumn("overlap_s", F.least(F.col(end), F.col("bin") + width_s) - F.greatest(F.col(start), F.col("bin")))


def adjacency(edges: DataFrame, src: str, dst: str, edge: str) -> DataFrame:
    """Upstream-downstream edge pairs through a shared node, an edge not with itself."""
    a = edges.select(F.col(edge).alias("upstream"), F.col(dst).alias("via"))
    b = edges.select(F.col(edge).alias("downstream"), F.col(src).alias("via"))
    return a.join(b, "via").where("upstream <> downstream").select("upstream", "downstream").distinct()


#: Grids of the nearest join; the finest is radius / 2^15.
_LEVELS = 16


def within_radius(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(id, target, distance) of planar points within the radius, by grid cells of its size and their 8 neighbours.

    Both frames: id, x, y. The smaller frame should be ``targets``: its rows are copied to 9 cells.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    p = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    t = targets.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.explode(near).alias("c")).select("target", "tx", "ty", "c.*")
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
    return p.join(t, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).select("id", "target", "distance")


def nearest(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """The nearest target within the radius, ties by target (J16). An aggregate, so no point is sorted with its candidates.

    Points and targets of one place are one row. A place looks around at the finest of ``_LEVELS`` grids, each half as wide as the one before, where its own cell
    holds a target: none nearer is beyond the next two cells. So dense targets are met in fine cells, and only places without one in their cell of the radius' size look around in that one.
    """
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    side = lambda level: F.lit(float(radius)) / F.pow(F.lit(2.0), level)
    cell = lambda c: F.floor(F.col(c) / side(F.col("level"))).cast("long")
    at_levels = lambda df: df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1)))).withColumns({"cx": cell("x"), "cy": cell("y")})
    places = points.where(known).select("x", "y").distinct()
    spots = at_levels(targets.where(known).groupBy("x", "y").agg(F.min("id").alias("target")))
    occupied = spots.select("level", "cx", "cy").distinct()
    own = at_levels(places).join(occupied, ["level", "cx", "cy"], "left_semi").groupBy("x", "y").agg(F.max("level").alias("level"))
    look = places.join(own, ["x", "y"], "left").na.fill(0, ["level"])
    around = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in range(-2, 3) for j in range(-2, 3)])
    look = look.withColumn("c", F.explode(around)).select("x", "y", "level", "c.*")
    t = spots.select("level", "cx", "cy", "target", F.col("x").alias("tx"), F.col("y").alias("ty"))
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
    found = look.join(t, ["level", "cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius)
    best = found.groupBy("x", "y").agg(F.min(F.struct("distance", "target")).alias("b"))
    return points.select("id", "x", "y").join(best, ["x", "y"]).select("id", "b.target", "b.distance")


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """The same unit under two runs: values and delta."""
    return (a.select(key, F.col(value).alias("value_a")).join(b.select(key, F.col(value).alias("value_b")), key)
            .withColumn("delta", F.col("value_b") - F.col("value_a")))


def outcome_transitions(a: DataFrame, b: DataFrame, key: str, outcome: str, value: str) -> DataFrame:
    """Units by outcome under one run and under the other, with their share of the first outcome's and mean change; a unit of one run only is ``absent`` in the other."""
    both = (a.select(key, F.col(outcome).alias("outcome_a"), F.col(value).alias("_va"))
            .join(b.select(key, F.col(outcome).alias("outcome_b"), F.col(value).alias("_vb")), key, "full_outer").na.fill("absent", ["outcome_a", "outcome_b"]))
    cells = both.groupBy("outcome_a", "outcome_b").agg(F.count("*").alias("n"), F.avg(F.col("_vb") - F.col("_va")).alias("mean_delta"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("outcome_a")))  # a row per pair of outcomes


def common_support(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Keys that every frame has."""
    out = frames[0].select(*key).distinct()
    for f in frames[1:]:
        out = out.join(f.select(*key), key, "left_semi")
    return out


def set_similarity(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Jaccard and overlap of the item sets of consecutive groups."""
    sets = rows.select(group, item).distinct()
    n = sets.groupBy(group).agg(F.count("*").alias("size"))
    order = Window.orderBy(group)  # one row per group, an ordered report
    pairs = n.withColumn("other", F.lead(group).over(order)).withColumn("other_size", F.lead("size").over(order)).where("other is not null")
    other = sets.select(F.col(group).alias("other"), item)
    shared = (sets.join(pairs.select(group, "other"), group).join(other, ["other", item]).groupBy(group).agg(F.count("*").alias("shared")))
    out = pairs.join(shared, group, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.select(group, "other", "shared", (F.col("shared") / (F.col("size") + F.col("other_size") - F.col("shared"))).alias("jaccard"),
                      (F.col("shared") / F.least("size", "other_size")).alias("overlap"))
