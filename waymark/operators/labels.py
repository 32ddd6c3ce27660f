"""Interval, visit and trip labels: how freely traffic moved, compared with a cohort reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.exprs import excess, bounded, first_reason, mean_present


def label_intervals(rows: DataFrame, key: list[str], order: list[str], speed: str, duration: str, stop: float, low: float,
                    max_acceleration: float) -> DataFrame:
    """Disjoint stop and crawl flags, and acceleration to the previous interval by midpoint gap."""
    w = Window.partitionBy(*key).orderBy(*order)
    gap = (F.col(duration) + F.lag(duration).over(w)) / 2
    return (rows.withColumn("stopped", F.col(speed) <= stop).withColumn("crawling", (F.col(speed) > stop) & (F.col(speed) < low))
            .withColumn("gap_s", gap).withColumn("acceleration", F.try_divide(F.col(speed) - F.lag(speed).over(w), gap))
            .withColumn("acceleration_ok", F.abs("acceleration") <= max_acceleration))


def visits(intervals: DataFrame, key: list[str], speed: str, duration: str, least_rows: int, least_s: float) -> DataFrame:
    """Per visit: time-weighted speed mean and CV, stop and crawl shares, acceleration RMS, availability reason."""
    t, v = F.col(duration), F.col(speed)
    ok = F.col("acceleration_ok") & (F.col("gap_s") > 0)
    out = intervals.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum(t).alias("time_s"), F.sum(v * t).alias("_vt"), F.sum(v * v * t).alias("_vvt"),
        F.sum(F.when(F.col("stopped"), t).otherwise(0.0)).alias("_stop"), F.sum(F.when(F.col("crawling"), t).otherwise(0.0)).alias("_crawl"),
        F.sum(F.when(ok, F.col("gap_s") * F.pow("acceleration", 2))).alias("_aa"), F.sum(F.when(ok, F.col("gap_s"))).alias("_a"))
    mean = F.try_divide(F.col("_vt"), F.col("time_s"))
    out = (out.withColumn("speed_mean", mean)
           .withColumn("speed_cv", F.try_divide(F.sqrt(F.greatest(F.try_divide(F.col("_vvt"), F.col("time_s")) - mean * mean, F.lit(0.0))), mean))
           .withColumn("stop_share", F.try_divide(F.col("_stop"), F.col("time_s"))).withColumn("crawl_share", F.try_divide(F.col("_crawl"), F.col("time_s")))
           .withColumn("acceleration_rms", F.sqrt(F.try_divide(F.col("_aa"), F.col("_a"))))
           .withColumn("reason", first_reason([("few_intervals", F.col("n") < least_rows), ("short_time", F.col("time_s") < least_s), ("no_speed", F.col("speed_cv").isNull())])))
    return out.drop("_vt", "_vvt", "_stop", "_crawl", "_aa", "_a")


def leave_one_out_reference(rows: DataFrame, levels: list[list[str]], value: str, least: int) -> DataFrame:
    """Mean of the cohort without the row itself, at the first level with ``least`` other rows; the global level needs one."""
    out, reference, level = rows, F.lit(None), F.lit(None)
    for i, keys in enumerate(levels):
        stat = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(value).alias(f"_s{i}"), F.count(value).alias(f"_n{i}"))
        out = out.join(stat, keys, "left") if keys else out.crossJoin(stat)  # one row
    for i, keys in reversed(list(enumerate(levels))):
        own = F.col(value).isNotNull().cast("int")
        n = F.col(f"_n{i}") - own
        ok = F.coalesce(n >= (least if keys else 1), F.lit(False))
        reference = F.when(ok, (F.col(f"_s{i}") - F.coalesce(F.col(value), F.lit(0.0))) / n).otherwise(reference)
        level = F.when(ok, F.lit("_".join(keys) or "global")).otherwise(level)
    return out.withColumn("reference", reference).withColumn("level", level).drop(*[f"_{c}{i}" for i in range(len(levels)) for c in "sn"])


def excess_label(rows: DataFrame, pace: str) -> DataFrame:
    """e = max(pace / reference - 1, 0) and e / (1 + e), null without a reference."""
    e = excess(F.try_divide(F.col(pace), F.col("reference")))
    return rows.withColumn("excess", e).withColumn("slow_label", bounded(e, 1.0)).withColumn(
        "reason", F.coalesce(F.col("reason"), F.when(F.col("reference").isNull(), "no_reference")))


def tail_event(value, threshold: float):
    """Three states: true, false, or null where the value is missing."""
    return F.when(value.isNotNull(), value >= threshold)


def trip_summary(rows: DataFrame, key: list[str], label: str, weight: str, tail: float, least_coverage: float) -> DataFrame:
    """Weighted mean, maximum, mean above the tail, weight share above it, and coverage; null below the least coverage."""
    known = F.col(label).isNotNull()
    w, x = F.col(weight), F.col(label)
    high = known & (x >= tail)
    out = rows.groupBy(*key).agg(
        F.sum(w).alias("weight"), F.sum(F.when(known, w)).alias("_w"), F.sum(F.when(known, w * x)).alias("_wx"), F.max(label).alias("_max"),
        F.sum(F.when(high, w)).alias("_hw"), F.sum(F.when(high, w * x)).alias("_hwx"))
    coverage = F.coalesce(F.try_divide(F.col("_w"), F.col("weight")), F.lit(0.0))
    show = lambda c: F.when(coverage >= least_coverage, c)
    return out.select(*key, coverage.alias("coverage"), show(F.try_divide(F.col("_wx"), F.col("_w"))).alias("mean"), show(F.col("_max")).alias("max"),
                      show(F.try_divide(F.col("_hwx"), F.col("_hw"))).alias("tail_mean"),
                      show(F.coalesce(F.try_divide(F.col("_hw"), F.col("_w")), F.lit(0.0))).alias("tail_share"))


def order_labels(base: DataFrame, parts: DataFrame, key: str, dimensions: list[str], weight: str, direct: Column, least_coverage: float) -> DataFrame:
    """Every order of ``base`` with its labels (A5): per dimension the weighted mean of its parts, the share of weight that has it, and why it is missing; and a signature of what the score is composed of.

    ``coverage``: share of weight with ``direct`` evidence. Below ``least_coverage`` no dimension is given. Reasons: NO_PARTS, COVERAGE_BELOW_THRESHOLD,
    NO_AVAILABLE_PARTS, or empty. ``signature``: the given dimensions in order, joined by +, or none. ``composite``: their mean.
    """
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0)
    known = lambda d: F.col(d).isNotNull() & ~F.isnan(d)
    sums = [F.count("*").alias("_rows"), F.sum(w).alias("_w"), F.sum(F.when(F.coalesce(direct, F.lit(False)), w).otherwise(0.0)).alias("_direct")]
    for d in dimensions:
        sums += [F.sum(F.when(known(d), w).otherwise(0.0)).alias(f"_w_{d}"), F.sum(F.when(known(d), w * F.col(d))).alias(f"_x_{d}")]
    out = base.join(parts.groupBy(key).agg(*sums), key, "left")
    coverage = F.coalesce(F.try_divide(F.col("_direct"), F.col("_w")), F.lit(0.0))
    passed, columns = coverage >= least_coverage, [*base.columns, coverage.alias("coverage")]
    for d in dimensions:
        there = F.coalesce(passed & (F.col(f"_w_{d}") > 0), F.lit(False))
        reason = F.when(there, "").when(F.col("_rows").isNull(), "NO_PARTS").when(~passed, "COVERAGE_BELOW_THRESHOLD").otherwise("NO_AVAILABLE_PARTS")
        columns += [F.when(there, F.col(f"_x_{d}") / F.col(f"_w_{d}")).alias(d), F.coalesce(F.try_divide(F.col(f"_w_{d}"), F.col("_w")), F.lit(0.0)).alias(f"{d}_coverage"), reason.alias(f"{d}_reason")]
    out = out.select(*columns)
    names = F.concat_ws("+", *[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dimensions])
    count = sum((F.col(d).isNotNull().cast("int") for d in dimensions[1:]), F.col(dimensions[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(d, F.lit(0.0)) for d in dimensions[1:]), F.coalesce(dimensions[0], F.lit(0.0)))
    return out.withColumns({"signature": F.when(names == "", "none").otherwise(names), "composite": F.when(count > 0, total / count)})


def five_dimensions(rows: DataFrame, trip: str, position: str) -> DataFrame:
    """``rows`` with five raw labels between 0 and 1 per traversed link, and the delay on links of much activity.

    Columns read: low_share, stop_share, speed_variation, acceleration (congestion); duration, low_time, stop_time, angle, node_degree
    (intersection); curvature, minor, fragmentation, end_degree (geometry); excess (tail); activity; observed and movement_reliable (booleans).
    A missing share, angle, node degree, minor flag or activity is evidence of nothing and counts as 0; any other missing part is left out of its mean.
    Links that weren't observed have geometry alone. A link whose movement isn't reliable has no intersection label, but for a trip's last, which has no movement to come.
    """
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))  # noqa: E731  (null without a value)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    known = lambda c: F.when(c.isNotNull(), clip(c))  # noqa: E731  (greatest and least skip nulls)
    up = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.col(c)))
    share = lambda c: zero(known(F.try_divide(F.col(c), F.col("duration"))))
    observed = F.coalesce("observed", F.lit(False))
    last = F.col(position) == F.max(position).over(Window.partitionBy(trip))
    late = up("excess")
    congestion = clip(mean_present([zero(F.col("low_share")), zero(F.col("stop_share")), bounded(up("speed_variation"), 1.0), bounded(up("acceleration"), 1.0)]))
    intersection = mean_present([share("low_time"), share("stop_time"), zero(known(F.abs("angle") / 180)), zero(known(F.col("node_degree") / 8))])
    geometry = mean_present([bounded(up("curvature"), 90.0), zero(F.col("minor").cast("double")), known(F.col("fragmentation") / 10), known(F.col("end_degree") / 8)])
    tail = bounded(late, 1.0)
    activity = clip(zero(F.col("activity")))
    return rows.withColumns({
        "congestion": F.when(observed, congestion), "intersection": F.when(observed & (F.coalesce("movement_reliable", F.lit(True)) | last), intersection), "geometry": geometry,
        "tail": F.when(observed, tail), "place_activity": F.when(observed & late.isNotNull(), activity * (congestion + tail) / 2),
        "active_delay": F.when(zero(F.col("activity")) >= 0.75, late).otherwise(0.0)})
