"""Clusters of near points without all their pairs, and counts within radii on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.exprs import EARTH_M, haversine_m
from waymark.operators.ranks import counted, same
from waymark.plans.components import connected_components
from waymark.plans.scratch import materialize

#: Cells of side radius / sqrt(2) that can hold a point within the radius; one of each opposite pair.
_AHEAD = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]


def _outside(x: Column, cell: Column, side: float) -> Column:
    """How far a coordinate is from a cell's range."""
    return F.greatest(cell * side - x, x - (cell + 1) * side, F.lit(0.0))


def near_clusters(points: DataFrame, radius: float) -> DataFrame:
    """``(id, cluster, members, cx, cy)`` of planar points (id, x, y): cluster is the smallest id reachable over steps within the radius, with its size and mean place.

    Points of a cell of side radius / sqrt(2) are all within the radius, so a cell is one node, whatever it holds. Neighbouring cells are
    linked by one pair first: in each, the distinct point nearest to the other cell. Only where two such cells are not yet of one component
    are their points compared, and only those within the radius of the other cell. Points without coordinates are clusters of their own.
    """
    side = radius / math.sqrt(2)
    known = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    placed = materialize(known.select("id", "x", "y", cell("x").alias("i"), cell("y").alias("j")), "placed")
    spots = materialize(placed.select("i", "j", "x", "y").distinct(), "spots")
    occupied = spots.select("i", "j").distinct()
    ahead = occupied.withColumn("d", F.explode(F.array(*[F.struct((F.col("i") + a).alias("i2"), (F.col("j") + b).alias("j2")) for a, b in _AHEAD]))).select("i", "j", "d.*")
    pairs = ahead.join(occupied.toDF("i2", "j2"), ["i2", "j2"])
    both = pairs.unionByName(pairs.select(F.col("i2").alias("i"), F.col("j2").alias("j"), F.col("i").alias("i2"), F.col("j").alias("j2")))
    gap = F.pow(_outside(F.col("x"), F.col("i2"), side), 2) + F.pow(_outside(F.col("y"), F.col("j2"), side), 2)
    around = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)]
    facing = spots.select("*", F.explode(F.array(*[F.struct((F.col("i") + a).alias("i2"), (F.col("j") + b).alias("j2")) for a, b in around])).alias("d")).select("i", "j", "x", "y", "d.*")
    nearest = materialize(facing.groupBy("i", "j", "i2", "j2").agg(F.min(F.struct(gap.alias("gap"), "x", "y")).alias("p"))  # partial minima: a full cell sends one row a task
                          .where(F.col("p.gap") <= radius * radius * (1 + 1e-12)).join(both, ["i", "j", "i2", "j2"], "left_semi"), "nearest")
    other = nearest.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("i2").alias("i"), F.col("j2").alias("j"), F.col("p").alias("q"))
    apart = lambda a, b: F.sqrt(F.pow(F.col(f"{a}.x") - F.col(f"{b}.x"), 2) + F.pow(F.col(f"{a}.y") - F.col(f"{b}.y"), 2))
    name = lambda i, j: F.concat_ws(":", i, j)
    met = materialize(nearest.join(other, ["i", "j", "i2", "j2"]).where("(i, j) < (i2, j2)").select(
        name("i", "j").alias("a"), name("i2", "j2").alias("b"), (apart("p", "q") <= radius).alias("linked"), "i", "j", "i2", "j2"), "met")
    links = met.where("linked").select("a", "b")
    first = materialize(connected_components(links, "a", "b"), "clusters")
    of = lambda n: first.select(F.col("node").alias(n), F.col("component").alias(f"of_{n}"))
    open_pairs = (met.where("not linked").join(of("a"), "a", "left").join(of("b"), "b", "left")
                  .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "i", "j", "i2", "j2"))
    open_pairs = materialize(open_pairs, "open")
    ours = spots.join(open_pairs, ["i", "j"]).where(gap <= radius * radius * (1 + 1e-12)).select("a", "b", F.struct("x", "y").alias("p"))
    theirs = spots.select(F.col("i").alias("i2"), F.col("j").alias("j2"), "x", "y").join(open_pairs, ["i2", "j2"])
    back = F.pow(_outside(F.col("x"), F.col("i"), side), 2) + F.pow(_outside(F.col("y"), F.col("j"), side), 2)
    theirs = theirs.where(back <= radius * radius * (1 + 1e-12)).select("a", "b", F.struct("x", "y").alias("q"))
    late = ours.join(theirs, ["a", "b"]).where(apart("p", "q") <= radius).select("a", "b").distinct()
    groups = connected_components(links.unionByName(late), "a", "b")
    named = placed.withColumn("node", name("i", "j")).join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    sizes = named.groupBy("group").agg(F.min("id").alias("cluster"), F.count("*").alias("members"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    out = named.join(sizes, "group").select("id", "cluster", "members", "cx", "cy")
    lost = points.where(F.col("x").isNull() | F.col("y").isNull())
    return out.unionByName(lost.select("id", F.col("id").alias("cluster"), F.lit(1).cast("long").alias("members"), *[F.lit(None).cast("double").alias(c) for c in ("cx", "cy")]))


#: Places of a cell that one share of it holds, about.
_SHARE = 256


def _turns(lon: Column) -> Column:
    """Longitude as degrees from -180 on, in [0, 360)."""
    return F.pmod(lon + 180, F.lit(360.0))


def sphere_counts(points: DataFrame, targets: DataFrame, categories: list[str], radii: list[int], density_at: int, active: list[str]) -> DataFrame:
    """Per point (id, lon, lat) the targets (lon, lat, category) within each radius in metres, by category; density a square kilometre, activity and its rank.

    Bands of latitude as high as the largest radius hold cells at least as wide wherever they are, so few at the poles; targets are
    copied to the cells that their circle meets, across 180 degrees and over a pole too, points to none, and one probe
    serves all radii. Points and targets of one place are one row, so copies add no pairs, and the places of a crowded cell are dealt out in shares, each of which
    meets the cell's targets in a task of its own. Different places within reach of each other are compared pair by pair. Columns: ``{category}_{radius}``, ``density``, ``activity`` (sum of log1p at ``density_at`` over ``active``) and ``activity_rank`` (average rank / points).
    """
    reach = float(max(radii))
    height = math.degrees(reach / EARTH_M) * 1.0001
    bands = math.ceil(180 / height)
    band = lambda lat: F.least(F.floor((lat + 90) / height), F.lit(bands - 1)).cast("long")

    def cells(b: Column) -> Column:
        """How many cells a band has: its shorter edge over the reach, one at least."""
        edge = F.greatest(F.abs(b * height - 90), F.abs((b + 1) * height - 90))
        return F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(edge, F.lit(90.0)))) * (2 * math.pi * EARTH_M / reach))).cast("long")

    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    p = points.where(known).select("lon", "lat").distinct().withColumn("band", band(F.col("lat")))
    p = p.withColumn("cell", F.floor(_turns(F.col("lon")) / 360 * cells(F.col("band"))).cast("long"))
    crowds = p.groupBy("band", "cell").agg(F.ceil(F.count("*") / _SHARE).cast("int").alias("shares"))
    p = p.join(crowds, ["band", "cell"]).withColumn("share", F.pmod(F.xxhash64("lon", "lat"), F.col("shares")).cast("int"))
    t = targets.where(known).groupBy("lon", "lat").agg(*[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in categories])
    t = t.withColumn("band", F.explode(F.array(*[band(F.col("lat")) + k for k in (-1, 0, 1)]))).where(f"band between 0 and {bands - 1}")
    cap = reach / EARTH_M * 1.0001
    wide = F.sin(F.lit(cap)) / F.cos(F.radians("lat"))
    half = F.when(F.radians(F.abs("lat")) + cap >= math.pi / 2, 180.0).otherwise(F.degrees(F.asin(F.least(wide, F.lit(1.0)))) + 1e-9)
    n = cells(F.col("band"))
    low, high = [F.floor((_turns(F.col("lon")) + s * half) / 360 * n).cast("long") for s in (-1, 1)]
    t = t.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(low, F.least(high, low + n)), lambda c: F.pmod(c, n)))))
    t = t.join(crowds, ["band", "cell"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    t = t.select("band", "cell", "share", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"), *[f"n_{c}" for c in categories])
    axes = lambda lon, lat: [EARTH_M * x for x in (F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat)))]
    p = p.withColumns(dict(zip(("x", "y", "z"), axes("lon", "lat"), strict=True)))
    t = t.withColumns(dict(zip(("tx", "ty", "tz"), axes("tlon", "tlat"), strict=True)))
    # the straight line decides but for a tenth of a millimetre around a radius, where the arc does
    line = sum(((F.col(f"t{c}") - F.col(c)) * (F.col(f"t{c}") - F.col(c)) for c in "yz"), (F.col("tx") - F.col("x")) * (F.col("tx") - F.col("x")))
    chord = lambda r: (2 * EARTH_M * math.sin(r / (2 * EARTH_M))) ** 2
    alike = (F.col("band") == F.col("_band")) & (F.col("cell") == F.col("_cell")) & (F.col("share") == F.col("_share"))
    # few places have many pairs: as many tasks as a shuffle has, which are not merged for being small
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p, t = (x.repartition(parts, "band", "cell", "share") for x in (p, t))
    t = t.toDF("_band", "_cell", "_share", *t.columns[3:])
    near = p.join(t, alike & (line <= chord(reach + 1e-4))).withColumn("line", line)
    arc = haversine_m(F.col("lon"), F.col("lat"), F.col("tlon"), F.col("tlat"))
    beyond = lambda d, far: sum(((d > far(r)).cast("int") for r in radii), F.lit(0))
    ring = F.when(beyond(F.col("line"), lambda r: chord(r - 1e-4)) == beyond(F.col("line"), lambda r: chord(r + 1e-4)), beyond(F.col("line"), chord)).otherwise(beyond(arc, float))
    rings = near.groupBy("lon", "lat", ring.alias("ring")).agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in categories])
    within = {r: len(radii) - sum(x >= r for x in radii) for r in radii}  # rings whose arc is at most r
    counts = rings.groupBy("lon", "lat").agg(*[F.sum(F.when(F.col("ring") <= within[r], F.col(f"n_{c}")).otherwise(0)).alias(f"{c}_{r}") for c in categories for r in radii])
    names = [f"{c}_{r}" for c in categories for r in radii]
    out = points.select("id", "lon", "lat").join(counts, ["lon", "lat"], "left").na.fill(0, names).select("id", *names)
    total = sum((F.col(f"{c}_{density_at}") for c in categories[1:]), F.col(f"{categories[0]}_{density_at}"))
    activity = sum((F.log1p(f"{c}_{density_at}") for c in active[1:]), F.log1p(f"{active[0]}_{density_at}"))
    out = materialize(out.withColumns({"density": total / (math.pi * density_at**2 / 1e6), "activity": F.round(activity, 12)}), "exposure")
    at = counted(out, [], "activity")
    ranks = at.select("activity", ((F.col("upto") - (F.col("n") - 1) / 2) / F.col("total")).alias("activity_rank"))
    return out.join(ranks, same(out, ranks, ["activity"])).select(out["*"], "activity_rank")
