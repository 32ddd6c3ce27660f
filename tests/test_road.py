"""Edges of the trace, rule, context and report operators, on hand-made frames and against plain Python."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import road as R
from waymark.operators import context, evaluate, history, ledgers, quantiles, ranks, reports, scores, sequence, traces


def one(df):
    return df.collect()[0]


def test_traces_mark_and_keep(spark):
    """A spike is marked and cut on both sides, not dropped; an exact repeat goes; equal times at other places stay."""
    step = 0.0001  # some 10 m of longitude at the equator
    pts = [("a", i, 10.0 * i, step * i, 0.0) for i in range(5)] + [("a", 5, 50.0, step * 60, 0.0), ("a", 6, 60.0, step * 6, 0.0), ("a", 7, 70.0, step * 7, 0.0)]
    pts += [("a", 8, 70.0, step * 7, 0.0), ("a", 9, 70.0, step * 8, 0.0), ("a", 10, 80.0, step * 8, 0.0), ("a", 11, 500.0, step * 9, 0.0), ("a", 12, None, 0.0, 0.0), ("a", 13, 510.0, 999.0, 0.0), ("b", 1, 5.0, 0.0, 0.0)]
    got = {(r["trip"], r["seq"]): r for r in traces.clean_trace(spark.createDataFrame(pts, "trip string, seq long, t double, lon double, lat double"), max_gap_s=60.0, max_speed=60.0).collect()}
    assert set(got) == {("a", i) for i in (0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11)} | {("b", 1)}
    assert got["a", 5]["outlier"] == "out_and_back" or got["a", 5]["outlier"] == "speed_peak"
    assert got["a", 5]["break_reason"] == "outlier" and got["a", 6]["break_reason"] == "outlier"
    assert got["a", 9]["break_reason"] == "no_time" and got["a", 11]["break_reason"] == "gap" and got["a", 0]["break_reason"] is None
    assert got["b", 1]["subtrace"] == 0 and not got["b", 1]["usable"]


def test_visits_conserve_time(spark):
    pts = [("a", i, float(t), link) for i, (t, link) in enumerate([(0, "x"), (10, "x"), (14, "y"), (20, "y"), (26, None), (30, "x")])]
    v = traces.link_traversals(spark.createDataFrame(pts, "trip string, seq long, t double, link string"), "trip", ["t", "seq"], "t", "link")
    got = {r["visit"]: (r["link"], r["time_s"]) for r in v.collect()}
    assert got == {0: ("x", 12.0), 1: ("y", 11.0), 2: (None, 5.0), 3: ("x", 2.0)} and sum(t for _, t in got.values()) == 30.0


def test_rules(spark):
    df = spark.createDataFrame([('"a"=>"1", "b\\"c"=>"x=>y", "a"=>"2"',), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(R.parse_tags(F.col("t"))).collect()] == [{'b"c': "x=>y", "a": "2"}, None, {}]
    speeds = {None: ("missing", []), "30": ("numeric", [30.0]), "50 km/h": ("kmh_unit", [50.0]), "30 mph": ("mph", [30 * 1.609344]), "50;60": ("multi_numeric", [50.0, 60.0]), "walk": ("named_or_non_numeric", []), "50 @ (Mo)": ("conditional", [])}
    s = R.parse_speed(F.col("t"))
    got = spark.createDataFrame([(t,) for t in speeds], "t string").select("t", s["format"].alias("f"), s["values"].alias("v")).collect()
    assert {r["t"]: (r["f"], r["v"]) for r in got} == speeds
    assert one(spark.range(1).select(R.normal_oneway(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))))[0] == "both"


def test_running_sums_match(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 2.5, 7.0]), rng.randint(1, 5)) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, v double, w long").repartition(4)
    for r in ranks.running(df, ["k"], "v", {"upto": "w"}).distinct().collect():
        low = [w for k, v, w in data if k == r["k"] and (v is None or (r["v"] is not None and v <= r["v"]))]
        assert r["upto"] == sum(low)
    for r in sequence.average_rank(df.where("k is not null"), ["k"], "v").collect():
        mine = [v for k, v, _ in data if k == r["k"]]
        key = lambda v: -1 if v is None else v
        below, same = sum(key(v) < key(r["v"]) for v in mine), sum(v == r["v"] for v in mine)
        assert r["avg_rank"] == below + (same + 1) / 2
    assert ranks.running(df.limit(0), ["k"], "v", {"upto": "w"}).count() == 0
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", 0.5).count() == 0


def test_top_fraction_ties(spark):
    df = spark.createDataFrame([(i, float(i % 3), i % 2) for i in range(30)] + [(99, None, 1)], "id long, s double, y int")
    got = one(evaluate.top_fraction(df, "y", "s", "id", 0.4))
    ids = sorted(range(30), key=lambda i: (-(i % 3), i))[:13]
    assert got["k"] == 13 and got["precision"] == pytest.approx(sum(i % 2 for i in ids) / 13)


def test_sequence_overlap_is_lcs(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for _ in range(60)]

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1] / len(b) if a and b else None

    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", reports.sequence_overlap(F.col("a"), F.col("b")).alias("o")).collect():
        assert r["o"] == (pytest.approx(lcs(r["a"], r["b"])) if lcs(r["a"], r["b"]) is not None else None)


def test_cluster_bootstrap_matches(spark):
    """Draws, means and interval against plain Python over the same hashes."""
    data = [(k, float(k * 3 % 7 + i)) for k in range(12) for i in range(k % 4 + 1)]
    got = one(reports.cluster_bootstrap(spark.createDataFrame(data, "k long, v double"), "k", "v", 40, "boot"))

    def times(rep, k):
        u = int(hashlib.sha256(f"boot|{rep}|{k}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, c = 0, 0.36787944117144233, 0.36787944117144233
        for i in range(1, 10):
            n += u >= c
            p /= i
            c += p
        return n

    means = []
    for rep in range(1, 41):
        drawn = [(times(rep, k), v) for k, v in data]
        if n := sum(t for t, _ in drawn):
            means.append(sum(t * v for t, v in drawn) / n)
    means.sort()
    at = lambda q: (lambda x: means[int(x)] + (x - int(x)) * (means[min(int(x) + 1, len(means) - 1)] - means[int(x)]))(q * (len(means) - 1))
    assert (got["low"], got["high"]) == (pytest.approx(at(.025)), pytest.approx(at(.975)))


def test_context_states(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a")], "k long, own string")
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (3, "a")], "k long, theirs string")
    assert {r["k"]: r["context_state"] for r in context.with_context(rows, dim, ["k"], [("own", "theirs")]).collect()} == {1: "ok", 2: "mismatch", 3: "ambiguous", 4: "no_context"}
    t = dt.datetime(2024, 1, 1)
    pairs = spark.createDataFrame([(1, 2, t, t), (1, 2, t - dt.timedelta(seconds=1), t), (1, 1, t - dt.timedelta(seconds=1), t)], "a long, b long, av timestamp, de timestamp")
    assert context.causal_pairs(pairs, "a", "b", "av", "de").count() == 1
    with pytest.raises(Exception, match="a time is missing"):
        context.causal_pairs(spark.createDataFrame([(1, 2, None, t)], "a long, b long, av timestamp, de timestamp"), "a", "b", "av", "de").collect()
    assert [r["weight"] for r in context.overlap_merge(spark.createDataFrame([(1, 2.0), (1, 4.0)], "k long, v double"), ["k"], ["v"]).collect()] == [1.0]


def test_entry_times_use_the_second_slot(spark):
    tokens = spark.createDataFrame([("t", 0, 0.0, 10.0, "x"), ("t", 1, 0.0, 10.0, "y"), ("t", 2, 0.0, 10.0, "z")], "trip string, seq long, start double, len double, link string")
    pace = spark.createDataFrame([("x", 0, 10.0), ("y", 0, 1.0), ("y", 1, 5.0)], "link string, slot long, pace double")
    got = {r["seq"]: (r["entry_1"], r["entry_2"]) for r in history.entry_times(tokens, pace, "trip", "seq", "start", "len", "link", 100, 2.0).collect()}
    assert got == {0: (0.0, 0.0), 1: (100.0, 100.0), 2: (110.0, 150.0)}


def test_reports_on_no_rows(spark):
    empty = spark.createDataFrame([], "k long, s string, v double, w double, t double")
    assert one(ledgers.coverage_summary(empty, "k", F.col("v") > 0))["trips"] == 0
    assert ledgers.threshold_table(empty, ["k"], "v", [1.0]).count() == 0
    assert one(scores.screening(empty, "k", "v", "w", 0.1))["k"] == 0
    assert history.remaining_time(empty, empty, "v", "k", "w", "t").count() == 0
    assert scores.top_cells(empty, "k", "v", 0.1).count() == 0


def test_calibration_lowers_the_loss(spark):
    from waymark.operators.ml import calibrate

    rng = random.Random(9)
    data = [(i, s, int(rng.random() < s * s)) for i, s in ((i, rng.random()) for i in range(600))]
    df = spark.createDataFrame(data, "id long, s double, y int").withColumn("y", F.col("y").cast("double"))
    out = calibrate(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "y", "s")
    loss = one(out.agg(*[F.avg(F.pow(F.col(c) - F.col("y"), 2)).alias(c) for c in ("s", "calibrated", "platt", "isotonic")]))
    assert loss["calibrated"] < loss["s"] and loss["calibrated"] in (loss["platt"], loss["isotonic"])
    rows = out.orderBy("s").collect()
    assert all(a["isotonic"] <= b["isotonic"] + 1e-12 and a["platt"] <= b["platt"] + 1e-12 for a, b in zip(rows, rows[1:]))


def test_trees_beat_the_mean(spark):
    from waymark.operators.ml import class_means, fit_trees

    rng = random.Random(4)
    data = [(i, rng.choice("ab"), rng.random()) for i in range(800)]
    df = spark.createDataFrame([(i, g, x, (3.0 if g == "a" else 1.0) * x + .05 * rng.random()) for i, g, x in data], "id long, g string, x double, y double")
    train, test = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    loss = one(fit_trees(train, ["g"], ["x"], "y").transform(class_means(train, test, "g", "y")).agg(
        *[F.sqrt(F.avg(F.pow(F.col(c) - F.col("y"), 2))).alias(c) for c in ("prediction", "class_mean", "constant")]))
    assert loss["prediction"] < .3 * loss["class_mean"] < .3 * loss["constant"]
