"""Hardest edges of the trip operators, on hand-made frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import exprs as X
from waymark.operators import causal, joins, labels, ml, quantiles, sampling, sequence
from waymark.plans.components import connected_components
from waymark.plans.scratch import materialize, release
from waymark.queries import QUERIES
from waymark.sources import io
from waymark.streaming import windows


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_nested_trip_opens_no_session(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 1000.0), ("a", 2, 10.0, 20.0), ("a", 3, 1100.0, 1200.0), ("a", 4, 1301.0, 1302.0)], "k string, id long, s double, e double")
    got = rows(sequence.sessionize(df, "k", "s", "e", "id", 100.0), "id", "session")
    assert got == [(1, 0), (2, 0), (3, 0), (4, 1)]  # a gap of exactly 100 does not split


def test_window_history_excludes_equal_times(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, t, 5.0), (1, t - dt.timedelta(seconds=10), 3.0), (1, t - dt.timedelta(seconds=11), None)], "k long, ts timestamp, v double")
    q = spark.createDataFrame([(1, t, 7), (2, t, 8)], "k long, ts timestamp, q long")
    assert rows(causal.window_history(ev, q, "k", "ts", "v", "q", 10), "q", "mean", "n") == [(7, 3.0, 1), (8, None, 0)]
    assert rows(causal.asof(ev, q, "k", "ts", "v", "q"), "q", "value") == [(7, 5.0), (8, None)]
    assert rows(causal.asof(ev, q, "k", "ts", "v", "q", inclusive=False), "q", "value") == [(7, 3.0), (8, None)]
    assert rows(causal.asof(ev, q, "k", "ts", "v", "q", inclusive=False, max_age_s=9), "q", "value") == [(7, None), (8, None)]


def test_allocation_conserves_totals(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 1.0), ("a", 2, 10.0, 2.0), ("b", 1, 9.0, 0.0), ("b", 2, 9.0, 0.0), ("b", 3, 9.0, 0.0)], "k string, i long, t double, w double")
    got = rows(sequence.allocate(df, ["k"], ["i"], "t", "w"), "k", "i", "allocated")
    assert sum(x for k, _, x in got if k == "a") == 10.0 and [x for k, _, x in got if k == "b"] == [3.0, 3.0, 3.0]


def test_chunk_weights_sum_to_one(spark):
    df = spark.range(8).select(F.lit("a").alias("k"), F.col("id").alias("s"))
    got = sequence.overlapping_chunks(df, ["k"], "s", 3, 2)
    assert rows(got.select("chunk_start").distinct(), "chunk_start") == [(0,), (2,), (4,), (5,)]
    assert all(w == pytest.approx(1) for _, w in rows(got.groupBy("s").agg(F.sum("weight").alias("w")), "s", "w"))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 10.0, 10.1, -0.1, float("nan"), None, 9.999)], "v double")
    got = {r["bin"]: r["n"] for r in quantiles.histogram(df.withColumn("k", F.lit(1)), ["k"], "v", 0.0, 10.0, 5).collect()}
    assert got == {0: 1, 4: 2, 5: 1, -1: 1, None: 2}


def test_leave_one_out_changes_support(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None)], "k string, v double")
    got = {(r["k"], r["v"]): (r["reference"], r["level"]) for r in labels.leave_one_out_reference(df, [["k"], []], "v", 1).collect()}
    assert got == {("a", 1.0): (3.0, "k"), ("a", 3.0): (1.0, "k"), ("b", 5.0): (2.0, "global"), ("b", None): (5.0, "k")}


def test_missing_is_not_zero(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0)], "a double, b double")
    got = df.select(X.utilization([F.col("a"), F.col("b")], [F.lit(1.0), F.lit(1.0)]).alias("u"), labels.tail_event(F.col("b"), 5.0).alias("t"), X.excess(F.col("b")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (4.0, False, 3.0)]


def test_expressions(spark):
    r = spark.range(1).select(
        X.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("m"), X.angle_difference(F.lit(350.0), F.lit(10.0)).alias("d"),
        X.turn_class(F.lit(-170.0)).alias("u"), X.grid_cell(F.lit(-0.1), F.lit(2.5), 1.0).alias("c"), X.right_closed_bucket(F.lit(5), [5, 10]).alias("b"),
        X.keyword_category(F.lit("City Hospital"), [("school", ["school"]), ("health", ["hospital"])]).alias("k"), X.nearest_of(F.lit(45.0), [40.0, 50.0]).alias("n"),
        X.hard_state(F.array(), F.array(F.lit("x"))).alias("s"), X.day_bin(F.lit(90_000), 1800).alias("day")).first()
    assert r["m"] == pytest.approx(6_371_000 * math.radians(1)) and (r["d"], r["u"], r["c"], r["b"], r["k"], r["n"], r["s"], r["day"]) == (20.0, "u_turn", "-1_2", 0, "health", 40.0, "UNKNOWN", 47)


def test_samples_ignore_order(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 2).alias("g"))
    a = rows(sampling.hash_sample(df, ["g"], "id", "s", 5), "g", "id", "rank")
    assert a == rows(sampling.hash_sample(df.repartition(7).orderBy(F.desc("id")), ["g"], "id", "s", 5), "g", "id", "rank") and len(a) == 10


def test_radius_and_overlap(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.99, 0.99)], "id long, x double, y double")
    t = spark.createDataFrame([(7, 1.0, 1.0), (6, 0.98, 0.98), (9, -1.0, 0.0)], "id long, x double, y double")
    assert rows(joins.within_radius(p, t, 1.0), "id", "target") == [(1, 9), (2, 6), (2, 7)]
    assert rows(joins.nearest(p, t, 1.0), "id", "target") in ([(1, 9), (2, 6)], [(1, 9), (2, 7)])
    s = spark.createDataFrame([(0.0, 10.0), (5.0, 20.0), (3.0, 3.0)], "s double, e double")
    assert rows(joins.overlap_bins(s, "s", "e", 10), "s", "bin", "overlap_s") == [(0.0, 0, 10.0), (5.0, 0, 5.0), (5.0, 10, 10.0)]


def test_components_of_a_long_chain(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (None, 3)], "src long, dst long").repartition(5)
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert connected_components(e.limit(0)).count() == 0


def test_scratch_is_shared_and_released(spark):
    df = materialize(spark.range(5))
    assert df.count() == 5
    release(df)
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        df.count()


def test_scan_and_publish(spark, tmp_path):
    df = spark.createDataFrame([("20240101", 1), ("20240102", 2)], "date string, v long")
    io.publish(df, str(tmp_path / "p"), ["date"])
    io.publish(df.where("v = 2").withColumn("v", F.lit(9).cast("long")), str(tmp_path / "p"), ["date"])
    back = io.scan_product(spark, str(tmp_path / "p"), ["v"], ["20240101", "20240102"])
    assert rows(back, "v") == [(1,), (9,)]
    with pytest.raises(ValueError, match="missing columns"):
        io.scan_product(spark, str(tmp_path / "p"), ["w"])
    with pytest.raises(ValueError, match="undeclared"):
        io.check_schema(df, df.select("v").schema)
    (tmp_path / "g.csv").write_text("d,o,1.5,x,30\n")
    assert io.scan_points(spark, str(tmp_path / "g.csv")).first()["lon"] is None
    (tmp_path / "poi.csv").write_text("Longitude,Latitude,kind\n114,30,a\n114,30,a\n999,1,b\n")
    assert io.scan_pois(spark, str(tmp_path / "poi.csv"), {"lon": ["lon"], "lat": ["lat"], "category": ["kind"]}).count() == 1


def test_boundary_event_goes_to_the_next_window(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10, 30)
    later = t + dt.timedelta(days=2)  # closes the windows of the others
    df = spark.createDataFrame([(t, "a", 1.0), (t - dt.timedelta(seconds=1), "a", None), (t, "a", 1.0), (later, "a", 1.0)], "ts timestamp, k string, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    cells = windows.run_to_files(windows.state_cells(stream, "ts", ["k"], "v"), "cells_test")
    assert [(r["window_start"].minute, r["n"], r["valid"]) for r in sorted(cells.collect())] == [(0, 1, 0), (30, 2, 2)]
    once = windows.run_to_files(windows.deduplicate(stream, "ts", ["ts", "k"]), "once_test")
    assert once.count() == 3


def test_models(spark, sf):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "g string, y double")
    got = ml.class_means(train, spark.createDataFrame([("a",), ("z",)], "g string"), "g", "y")
    assert rows(got, "g", "class_mean") == [("a", 2.0), ("z", 2.0)]
    scored = QUERIES["m2_calibration"](spark, sf)
    assert scored.where("calibrated between 0 and 1").count() == scored.count() > 0
    assert QUERIES["m1_boosted_trees"](spark, sf).where("prediction is not null").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hash_sample_is_whole(spark):
    """Few keys, hot keys and null groups give the n smallest hashes too."""
    df = spark.range(10_000, numPartitions=5).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, "a").alias("g"), "id")
    for seed in ("s1", "s2", "s3"):
        got = sampling.hash_sample(df, ["g"], "k", seed, 20).select(X.seeded_hash(seed, F.col("k")).alias("h"), "*").collect()
        for g in ("a", None):
            mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(1, 21)) and {r["probability"] for r in mine} == {20 / 5000}
            assert {r["h"] for r in mine} == {min(r[0] for r in df.select(X.seeded_hash(seed, F.col("k"))).distinct().collect())}
    few = sampling.hash_sample(df.where("id < 10"), ["g"], "id", "s1", 20)
    assert few.columns == ["g", "k", "id", "rank", "probability", "design_weight"]
    assert few.count() == 10 and {r["design_weight"] for r in few.collect()} == {1.0}
