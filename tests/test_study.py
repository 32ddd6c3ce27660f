"""Interpolated distributions, clusters, spheres, folds and streams at their edges, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import context, labels, ml, quantiles, reports, resample, spatial
from waymark.operators.ranks import at_places, with_quantiles
import waymark.study_queries  # noqa: F401
from waymark.queries import QUERIES
from waymark.streaming import windows


def test_interpolated_cdf_edges(spark):
    train = spark.createDataFrame([("a", 1.5)] * 2 + [("a", 7.5)] * 2 + [("b", 4.5), ("b", float("nan")), ("b", None), ("b", 99.0)], "k string, x double")
    asked = [("a", 1.9), ("a", 4.5), ("a", 0.1), ("a", 9.9), ("a", -5.0), ("a", 50.0), ("a", None), ("a", float("nan")), ("b", 4.0), ("b", 3.0), ("c", 7.1), ("a", 10.0)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "i long, k string, x double")
    got = {r.i: r for r in quantiles.interpolated_cdf(train, rows, {"own": F.col("k"), "all": F.lit("*")}, "x", 0.0, 10.0, 10, 1).collect()}
    assert [got[i].cdf for i in range(8)] == [0.25, 0.5, 0.0, 1.0, 0.0, 1.0, None, None]
    assert (got[8].cdf, got[8].support, got[9].cdf) == (0.5, 1, 0.0)  # a single occupied bin
    assert (got[10].level, got[10].support, got[10].cdf) == ("all", 5, 0.8) and got[11].cdf == 1.0
    few = quantiles.interpolated_cdf(train, rows, {"own": F.col("k"), "all": F.lit("*")}, "x", 0.0, 10.0, 10, 5).collect()
    assert {r.level for r in few} == {"all"}
    none = quantiles.interpolated_cdf(train, rows, {"own": F.col("k")}, "x", 0.0, 10.0, 10, 50).collect()
    assert len(none) == len(asked) and {r.cdf for r in none} == {None}


def brute_clusters(points, radius):
    known = [(i, x, y) for i, x, y in points if x is not None and y is not None]
    of = {i: i for i, _, _ in points}

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in range(len(known)):
        for b in range(a):
            if math.sqrt((known[a][1] - known[b][1]) ** 2 + (known[a][2] - known[b][2]) ** 2) <= radius:
                x, y = sorted((find(known[a][0]), find(known[b][0])))
                of[y] = x
    return {i: find(i) for i in of}


@pytest.mark.parametrize("radius", [0.03, 0.07, 0.2])
def test_near_clusters(spark, radius):
    rng = random.Random(int(radius * 100))
    points = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(400)]
    points += [(1000, None, 0.0), (1001, 0.5, 0.5), (1002, 0.5, 0.5), (1003, 0.5 + radius, 0.5), (1004, -3.0, 0.0), (1005, -3.0 + radius * 1.0001, 0.0)]
    got = {r.id: r for r in spatial.near_clusters(spark.createDataFrame(points, "id long, x double, y double").repartition(3), radius).collect()}
    want = brute_clusters(points, radius)
    assert {i: r.cluster for i, r in got.items()} == want
    sizes = [sum(c == r.cluster for c in want.values()) for r in got.values()]
    assert [r.members for r in got.values()] == sizes


def test_near_clusters_of_a_full_cell(spark):
    """1e5 points of one place and 1e5 around it take no pairs: the largest join between points is empty."""
    rng = spark.range(200_000).select("id", F.when(F.col("id") % 2 == 0, 0.5).otherwise(0.5 + F.rand(3) * 0.6).alias("x"), F.when(F.col("id") % 2 == 0, 0.5).otherwise(0.5 + F.rand(4) * 0.6).alias("y"))
    out = spatial.near_clusters(rng, 1.0)
    assert [tuple(r) for r in out.groupBy("cluster").agg(F.count("*"), F.max("members")).collect()] == [(0, 200_000, 200_000)]


def haversine(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1.0, h)))


def test_sphere_counts(spark):
    rng = random.Random(8)
    spots = [(0, 0), (179.9995, 12), (-179.9995, -60), (10, 89.9995), (200, -89.999), (-181, 40), (0, 90), (0, -90), (30, 60)]
    place = lambda: (lambda s: (s[0] + rng.uniform(-1, 1) * (180 if abs(s[1]) > 89 else 0.003), max(-90.0, min(90.0, s[1] + rng.uniform(-1, 1) * 0.002))))(rng.choice(spots))
    points, targets = [place() for _ in range(300)], [(*place(), rng.choice("ab")) for _ in range(300)]
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)] + [(999, None, 1.0)], "id long, lon double, lat double")
    t = spark.createDataFrame([(float(x), float(y), c) for x, y, c in targets] + [(None, 0.0, "a")], "lon double, lat double, category string")
    got = {r.id: r for r in spatial.sphere_counts(p, t, ["a", "b"], [50, 100, 200], 100, ["a", "b"]).collect()}
    assert len(got) == 301
    for i, x in enumerate(points):
        for c in "ab":
            for r in (50, 100, 200):
                assert got[i][f"{c}_{r}"] == sum(k == c and haversine(x, (u, v)) <= r for u, v, k in targets), (x, c, r)
    activity = [got[i].activity for i in got]
    for r in got.values():
        rank = (sum(a < r.activity for a in activity) + (sum(a == r.activity for a in activity) + 1) / 2) / len(activity)
        assert r.activity_rank == pytest.approx(rank)


def test_draws_are_whole(spark):
    rows = spark.createDataFrame([(f"c{i}", float(i)) for i in range(40)] + [(None, 9.0)], "c string, v double")
    draws = resample.cluster_draws(rows.where("c is not null"), "c", 25, "s")
    per = {r.rep: r.n for r in draws.groupBy("rep").agg(F.sum("times").alias("n")).collect()}
    assert per == {r: 40 for r in range(1, 26)}
    again = resample.cluster_draws(rows.where("c is not null").repartition(7), "c", 25, "s")
    assert draws.exceptAll(again).count() == 0
    out = resample.bootstrap(rows, "c", {"v": F.col("v"), "n": F.lit(1)}, {"mean": lambda s: s("v") / s("n"), "none": lambda s: F.try_divide(s("v"), s("n") - s("n"))}, 25, "s").collect()
    by = {r.statistic: r for r in out}
    assert by["mean"].estimate == 19.5 and by["mean"].low < 19.5 < by["mean"].high and by["none"].low is None


def test_structure_of_unseen_and_missing(spark, tmp_path):
    train = spark.createDataFrame([("x", 1.0, "2020-01-01"), ("x", 3.0, "2020-01-02"), ("y", None, "2020-01-03")], "k string, v double, d string")
    fitted = ml.fit_structure(train, ["k"], ["v"], "d", str(tmp_path / "s"))
    rows = spark.createDataFrame([(0, "x", 3.0), (1, "z", None), (2, None, 2.0), (3, "y", float("nan"))], "i long, k string, v double")
    got = {r.i: r for r in ml.apply_structure(fitted, rows, ["k"], ["v"]).withColumn("h", ml.one_hot(F.col("k_code"), F.col("k_width"))).collect()}
    assert [got[i].h for i in range(4)] == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 1, 0]]
    assert [(got[i].k_known, got[i].v_z, got[i].v_known) for i in range(4)] == [(1, 1.0, 1), (1, 0.0, 0), (0, 0.0, 1), (1, 0.0, 0)]
    assert fitted.select("first_date", "last_date").distinct().collect() == [("2020-01-01", "2020-01-03")]


def test_factorial_shapes(spark):
    rows = spark.createDataFrame([(a, b, float(v)) for b, vs in enumerate([(1, 2, 3), (3, 2, 1), (1, 3, 2), (5, 5, 5)]) for a, v in enumerate(vs)], "a long, b long, v double")
    got = {r.context: r.shape for r in reports.factorial_changes(rows, ["a", "b"], "v").where("factor = 'a'").collect()}
    assert got == {"b=0": "increasing", "b=1": "decreasing", "b=2": "mixed", "b=3": "flat"}


def test_counted_exclusions_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    for day in (1, 2, 3):
        spark.createDataFrame([(f"2024-01-0{day} 10:00:00", f"2024-01-0{day} 11:00:00"), (f"2024-01-0{day} 23:00:00", f"2024-01-0{day + 1} 00:10:00"), (f"2024-01-0{day} 10:00:00", None)],
                              "a string, b string").select(*[F.col(c).cast("timestamp") for c in "ab"]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("a timestamp, b timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    kept, counts = windows.same_day_counted(stream, "a", "b", "days")
    assert sorted(tuple(r)[:4] for r in counts.collect()) == [(3, 1, 1, 1)] * 3 and counts.select("batch").distinct().count() == 3
    assert kept.count() == 3 and kept.columns == ["a", "b"]


def test_places_of_much_repeated_values(spark):
    """A value of 1e12 rows stays one row."""
    at = spark.createDataFrame([(1.5, 2, 2), (2.5, 10**12, 10**12 + 2), (9.0, 1, 10**12 + 3)], "r double, n long, upto long")
    asked = spark.createDataFrame([(p,) for p in (0, 1, 2, 3, 10**12 + 1, 10**12 + 2, 3)] + [(None,)], "p long")
    got = {r.p: r.r for r in at_places(at, "r", asked, "p").collect()}
    assert got == {0: 1.5, 1: 1.5, 2: 2.5, 3: 2.5, 10**12 + 1: 2.5, 10**12 + 2: 9.0}


def test_quantiles_of_keys_without_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), (None, 7.0), ("b", None)], "k string, v double")
    stats = rows.groupBy("k").agg(F.count("v").alias("n"))
    got = {r.k: (r.n, r.m) for r in with_quantiles(stats, rows, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": (2, 2.5), None: (1, 7.0), "b": (0, None)}


def test_ambiguous_context_is_taken_from_no_row(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    dim = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, c string")
    assert sorted(tuple(r) for r in context.with_context(rows, dim, ["k"], []).select("k", "c", "context_state").collect()) == [(1, None, "ambiguous"), (2, "z", "ok")]


def test_five_dimensions_edges(spark):
    names = "trip long, at long, low_share double, stop_share double, speed_variation double, acceleration double, duration double, low_time double, stop_time double, angle double, node_degree double, curvature double, minor boolean, fragmentation double, end_degree double, excess double, activity double, observed boolean, movement_reliable boolean"
    full = (0.5, 0.1, 1.0, 3.0, 10.0, 20.0, 1.0, -90.0, 4.0, 90.0, True, 20.0, 2.0, 1.0, 2.0)
    rows = [(1, 1, *full, True, False), (1, 2, *full, True, False), (1, 3, *[None] * 15, True, None), (2, 1, *full, False, True), (3, 1, *full[:4], 0.0, *full[5:13], -0.5, 0.5, True, True), (4, 1, *[None] * 17)]
    got = {(r.trip, r.at): r for r in labels.five_dimensions(spark.createDataFrame(rows, names), "trip", "at").collect()}
    a = got[1, 2]
    assert got[1, 1].intersection is None and a.intersection is None  # neither is the trip's last
    assert (a.congestion, a.geometry, a.tail, a.place_activity, a.active_delay) == (pytest.approx((0.5 + 0.1 + 0.5 + 0.75) / 4), (0.5 + 1 + 1 + 0.25) / 4, 0.5, pytest.approx((0.4625 + 0.5) / 2), 1.0)
    b = got[1, 3]
    assert (b.congestion, b.intersection, b.geometry, b.tail, b.place_activity, b.active_delay) == (0, 0, 0, None, None, 0)
    c = got[2, 1]
    assert (c.congestion, c.intersection, c.tail, c.place_activity) == (None,) * 4 and c.geometry == a.geometry
    d = got[3, 1]
    assert (d.intersection, d.tail, d.place_activity, d.active_delay) == ((0.5 + 0.5) / 4, 0, pytest.approx(0.5 * 0.4625 / 2), 0)
    assert got[4, 1].congestion is None and got[4, 1].geometry == 0


def test_forests(spark, sf):
    scored = QUERIES["m1_forest_classifier"](spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("y", F.expr("cast(l_quantity * l_extendedprice > 800000 as double)"))
    means = ml.class_means(lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 = 1"), "l_quantity", "y")  # quantity alone tells of y here
    brier = lambda df, c: df.agg(F.avg(F.pow(F.col(c) - F.col("y"), 2))).first()[0]
    constant, best = brier(means, "constant"), brier(means, "class_mean")
    assert scored.count() == means.count() and scored.where("p between 0 and 1").count() == scored.count()
    assert constant - brier(scored, "p") >= 0.9 * (constant - best) > 0  # nearly all that can be told on lines it wasn't fitted on
    rows = spark.createDataFrame([(1.0, 1.5, 4.0), (3.0, 2.5, 2.0), (5.0, None, 5.0), (None, 1.0, 1.0), (2.0, float("nan"), 2.0)], "y double, a double, b double")
    got = {r.model: (r.n, r.mae, r.best) for r in ml.model_errors(rows, "y", ["a", "b"]).collect()}
    assert got == {"a": (2, 0.5, True), "b": (2, 2.0, False)}
    assert ml.model_errors(rows.limit(0), "y", ["a"]).count() == 0

