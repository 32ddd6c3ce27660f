"""Cases of the third review: speeds and durations of zero, crowds, copies and hot keys."""

import math
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import waymark.plan_queries  # noqa: F401
import waymark.score_queries  # noqa: F401
import waymark.study_queries  # noqa: F401
from tests.oracle import compare
from waymark.operators import context, history, joins, spatial, traces
from waymark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def still(sf, tmp_path_factory):
    """The tables, with events of which many stand still."""
    d = str(tmp_path_factory.mktemp("still"))
    for t in os.listdir(sf):
        if t != "events.parquet":
            os.symlink(f"{sf}/{t}", f"{d}/{t}")
    e = pq.read_table(f"{sf}/events.parquet")
    v = pa.array([0.0 if i % 3 == 0 else x for i, x in enumerate(e["value"].to_pylist())])
    pq.write_table(e.set_column(e.schema.get_field_index("value"), "value", v), f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["a1_visits", "p12_trip_labels", "m4_speed_posterior", "m4_speed_folds", "p1_direct_evidence"])
def test_zero_speeds_match_sql(spark, still, name):
    compare(spark, still, QUERIES[name], ORACLES[name])


def test_trailing_means_of_odd_values(spark):
    rng, day = random.Random(3), 1_700_000_000_000_000
    rows = [(i, rng.choice(["a", None]), day + rng.randrange(7_200_000_000) // 50_000_000 * 50_000_000 if i % 2 else day + rng.randrange(7_200_000_000), rng.choice([1.5, 2.25, None, 1e6])) for i in range(400)]
    rows += [(900, "a", day + 30_000_000, float("nan")), (901, "a", day - 1, float("inf"))]
    e = spark.createDataFrame(rows, "i long, k string, t long, v double").withColumn("ts", F.timestamp_micros("t"))
    got = {r.i: r for r in history.trailing_means(e, ["k"], "ts", "v", [1, 60]).collect()}
    assert len(got) == len(rows)
    for i, k, t, _ in rows:
        for m in (1, 60):
            known = [v for _, k2, t2, v in rows if k2 == k and t - m * 60_000_000 <= t2 < t and v is not None]
            assert got[i][f"n_{m}"] == len(known) and got[i][f"sum_{m}"] == pytest.approx(sum(known), nan_ok=True), (i, m)


def test_repeated_neighbours_count_once(spark):
    c = spark.createDataFrame([(1, 0, 1.0), (2, 0, 4.0), (3, 0, None)], "link long, b int, v double")
    a = spark.createDataFrame([(9, 1), (9, 1), (9, 2), (9, 3)], "link long, neighbour long")
    assert [tuple(r) for r in context.neighbour_means(c, a, "link", "b", "v").select("link", "b", "neighbour_mean", "neighbours").collect()] == [(9, 0, 2.5, 3)]


def test_nearest_in_crowds(spark):
    rng = random.Random(5)
    spot = lambda: rng.choice([(rng.uniform(-1, 1), rng.uniform(-1, 1)), (0.3 + rng.gauss(0, 1e-4), 0.3), (rng.gauss(0, 0.02), -0.5)])
    p, t = [(i, *spot()) for i in range(300)] + [(999, None, 0.0)], [(i, *spot()) for i in range(300)]
    got = {r.id: (r.target, r.distance) for r in joins.nearest(spark.createDataFrame(p, "id long, x double, y double"), spark.createDataFrame(t, "id long, x double, y double"), 0.05).collect()}
    want = {}
    for i, x, y in p[:-1]:
        d, j = min((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in t)
        if d <= 0.05:
            want[i] = (j, d)
    assert {i: j for i, (j, _) in got.items()} == {i: j for i, (j, _) in want.items()}


def test_nearest_of_copies(spark):
    """40,000 copies on each side of one place: the pairs, 1.6e9 of them, are never made."""
    n = spark.range(40_000).select("id", F.lit(0.01).alias("x"), F.lit(0.02).alias("y"))
    found = joins.nearest(n, n, 0.05)
    assert found.count() == 40_000 and [r.target for r in found.select("target").distinct().collect()] == [0]


def test_overlap_merge_sorts_no_copies(spark):
    m = context.overlap_merge(spark.createDataFrame([(1, 2.0), (1, 4.0), (1, None), (None, 1.0)], "k long, v double"), ["k"], ["v"])
    assert {r.k: (r.weight, r.v) for r in m.collect()} == {1: (1.0, 2.0), None: (1.0, 1.0)}
    assert "Window" not in m._jdf.queryExecution().toString()


def test_route_sequence_by_trip(spark):
    p = spark.createDataFrame([(1, i, x, 2.0, i == 0) for i, x in enumerate(["a", "b", "a", None, "c"])] + [(2, 0, "a", 1.0, None)], "trip long, n int, link string, len double, gap boolean")
    d = spark.createDataFrame([(1, 5.0), (2, 0.0)], "k long, driven double")
    got = {r.trip: r[1:] for r in traces.route_sequence(p, "trip", ["n"], "link", "len", F.col("gap"), d).select("trip", "interpolated_share", "repeated_share", "returns", "length_ratio").collect()}
    assert got == {1: (0.2, pytest.approx(0.4), 1, 2.0), 2: (None, 0.0, 0, None)}


def test_sphere_counts_of_copies(spark):
    """40,000 copies on each side of one place: the pairs, 1.6e9 of them, are never made."""
    p = spark.range(40_000).select("id", F.lit(10.0).alias("lon"), F.lit(20.0).alias("lat"), F.lit("a").alias("category"))
    out = spatial.sphere_counts(p, p, ["a", "b"], [50, 100], 100, ["a"])
    assert [tuple(r) for r in out.select("a_50", "a_100", "b_50").distinct().collect()] == [(40_000, 40_000, 0)] and out.count() == 40_000
