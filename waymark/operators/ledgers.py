"""Trip and scenario reports: states, ledgers, exposure, caps, profiles, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composite(rows: DataFrame, key: list[str], dims: list[str], threshold: float) -> DataFrame:
    """Per key: mean and share at or above the threshold of each dimension, and the mean over the available ones."""
    out = rows.groupBy(*key).agg(*[F.avg(d).alias(d) for d in dims], *[F.avg((F.col(d) >= threshold).cast("int")).alias(f"{d}_tail") for d in dims])
    known = F.array_compact(F.array(*[F.col(d) for d in dims]))
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    return out.withColumn("composite", mean).withColumn("available", F.size(known).cast("long"))


def reduce_states(rows: DataFrame, key: list[str], state: str, precedence: list[str]) -> DataFrame:
    """The state of highest precedence (A34). ``precedence``: lowest first; an unlisted state counts as none."""
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col(state))
    return rows.groupBy(*key).agg(F.get(F.array(*map(F.lit, precedence)), (F.max(rank) - 1).cast("int")).alias("state"))


def reason_sets(rows: DataFrame, key: list[str], code: str, known: Column) -> DataFrame:
    """Sorted distinct known and unknown codes and their numbers (A35). There are few codes."""
    codes = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(code))))
    out = rows.groupBy(*key).agg(codes(known).alias("k"), codes(~known).alias("u"))
    return out.select(*key, F.array_join("k", "|").alias("known"), F.array_join("u", "|").alias("unknown"), F.size("k").cast("long").alias("n_known"), F.size("u").cast("long").alias("n_unknown"))


def funnel(rows: DataFrame, stratum: list[str], stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows of each stratum that pass the stages so far, and whether every row is accounted for."""
    passed, counts, lost = F.lit(True), [], F.lit(0)
    for name, ok in stages:
        now = passed & F.coalesce(ok, F.lit(False))
        counts.append(F.count_if(now).alias(name))
        lost = lost + F.count_if(passed & ~now)
        passed = now
    return rows.groupBy(*stratum).agg(F.count("*").alias("rows"), *counts, (lost + F.count_if(passed) == F.count("*")).alias("reconciles"))


def ledger(orders: DataFrame, order: str, served: Column, fare: Column, cost: Column, fixed: float, lost: float) -> DataFrame:
    """One row per served order, one of the scenario's fixed cost and one of lost demand, and how far net and contributions are apart."""
    rows = orders.where(served).select(F.lit("order").alias("kind"), F.col(order).cast("string").alias("id"), fare.alias("revenue"), cost.alias("cost"))
    missed = orders.agg(F.lit("lost_demand").alias("kind"), F.lit("all").alias("id"), F.lit(0.0).alias("revenue"), (F.count_if(~served) * F.lit(lost)).alias("cost"))
    once = orders.sparkSession.range(1).select(F.lit("scenario").alias("kind"), F.lit("all").alias("id"), F.lit(0.0).alias("revenue"), F.lit(fixed).alias("cost"))
    return rows.unionByName(missed).unionByName(once).withColumn("contribution", F.col("revenue") - F.col("cost"))


def ledger_audit(book: DataFrame, tolerance: float) -> DataFrame:
    """Totals, and whether the contributions sum to revenue less cost."""
    t = book.agg(F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"), F.sum("contribution").alias("net"), F.count_if(F.col("kind") == "order").alias("orders"))
    return t.withColumn("balanced", F.abs(F.col("revenue") - F.col("cost") - F.col("net")) <= tolerance)


def coverage_summary(rows: DataFrame, trip: str, resolved: Column) -> DataFrame:
    """Rows, resolved rows and share, trips, and trips resolved throughout."""
    t = rows.withColumn("_r", resolved).groupBy(trip).agg(F.count("*").alias("n"), F.count_if("_r").alias("r"))
    return t.agg(F.sum("n").alias("rows"), F.sum("r").alias("resolved"), (F.sum("r") / F.sum("n")).alias("share"), F.count("*").alias("trips"), F.count_if(F.col("n") == F.col("r")).alias("whole_trips"))


def exposure_over_time(rows: DataFrame, scenario: list[str], order: list[str], exposure: str, cap: float, tolerance: float) -> DataFrame:
    """Largest running mean of exposure, least slack to the cap and how often it binds."""
    w = Window.partitionBy(*scenario).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_m", F.avg(exposure).over(w))
    return r.groupBy(*scenario).agg(F.max("_m").alias("max_mean"), F.max(exposure).alias("max_exposure"), F.min(cap - F.col("_m")).alias("min_slack"), F.count_if(F.abs(cap - F.col("_m")) <= tolerance).alias("binding"))


def cap_exceedance(rows: DataFrame, key: list[str], value: str, caps: dict[str, float]) -> DataFrame:
    """Share above each profile's cap, and whether a stricter cap passes no more."""
    order = sorted(caps, key=caps.get)
    out = rows.groupBy(*key).agg(*[F.avg((F.col(value) > caps[p]).cast("int")).alias(p) for p in order])
    nested = F.lit(True)
    for a, b in zip(order, order[1:]):
        nested = nested & (F.col(a) >= F.col(b))
    return out.withColumn("nested", nested)


def cell_errors(rows: DataFrame, cell: list[str], group: str, error: str) -> DataFrame:
    """Mean error per cell, then the mean over a group's cells, each counting once."""
    each = rows.groupBy(*cell, group).agg(F.avg(error).alias("m"), F.count("*").alias("n"))
    return each.groupBy(group).agg(F.avg("m").alias("cell_mean"), F.count("*").alias("cells"), F.sum("n").alias("rows"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("row_mean"))


def profile_margins(rows: DataFrame, key: str, dims: dict[str, float], profiles: DataFrame) -> DataFrame:
    """Each row against each profile: mean use of the available dimensions, violated ones, and the tightest with its margin.

    ``profiles``: (profile, and a cap per dimension), a handful of rows. ``dims``: weight per dimension.
    """
    both = rows.crossJoin(F.broadcast(profiles))  # profiles are a fixed, small table
    use = {d: F.try_divide(F.col(d), F.col(f"cap_{d}")) for d in dims}
    weight = sum((F.when(u.isNotNull(), F.lit(dims[d])).otherwise(0.0) for d, u in use.items()), F.lit(0.0))
    total = sum((F.coalesce(u * dims[d], F.lit(0.0)) for d, u in use.items()), F.lit(0.0))
    broken = F.array_compact(F.array(*[F.when(u > 1, d) for d, u in use.items()]))
    margins = F.array_compact(F.array(*[F.when(u.isNotNull(), F.struct((1 - u).alias("margin"), F.lit(d).alias("dim"))) for d, u in use.items()]))
    least = F.array_min(margins)
    return both.select(key, "profile", F.try_divide(total, weight).alias("stress"), F.array_join(broken, "|").alias("violations"), least["dim"].alias("binding"), least["margin"].alias("margin"))


def cap_tail(rows: DataFrame, key: list[str], value: str, cap: float) -> DataFrame:
    """How many keys exceed the cap by their largest but not by their mean value, and by both."""
    t = rows.groupBy(*key).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.avg((F.col(value) > cap).cast("int")).alias("tail"))
    return t.agg(F.count("*").alias("n"), F.count_if((F.col("max") > cap) & (F.col("mean") <= cap)).alias("max_only"), F.count_if(F.col("mean") > cap).alias("both"), F.avg("tail").alias("mean_tail"))


def wide(rows: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One row per key, one column per name."""
    return rows.groupBy(*key).pivot(name, names).agg(F.first(value))


def threshold_table(rows: DataFrame, key: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """Share and mean of the rows at or above each threshold."""
    each = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return each.groupBy(*key, "threshold").agg(F.avg((F.col(value) >= F.col("threshold")).cast("int")).alias("share"), F.avg(F.when(F.col(value) >= F.col("threshold"), F.col(value))).alias("mean"))


def hourly_exposure(rows: DataFrame, hour: Column, exposures: list[str], value: str) -> DataFrame:
    """Per category and hour, sum, count and mean where a row is exposed to the category."""
    each = rows.select(hour.alias("hour"), value, F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("on")) for c in exposures])).alias("e"))
    return each.where("e.on").groupBy("e.category", "hour").agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias("mean"))


def segments(rows: DataFrame, key: list[str], position: str, value: str, weight: str, tail: float) -> DataFrame:
    """Per trip: mean, q90, q95, maximum, std, means of the early, middle and late third, and tail share."""
    v, p = F.col(value), F.col(position)
    third = lambda a, b: F.avg(F.when((p >= a) & (p < b), v))
    return rows.groupBy(*key).agg(
        F.avg(v).alias("mean"), F.percentile(value, F.lit(0.9)).alias("q90"), F.percentile(value, F.lit(0.95)).alias("q95"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"),
        third(0.0, 1 / 3).alias("early"), third(1 / 3, 2 / 3).alias("middle"), third(2 / 3, 2.0).alias("late"), F.try_divide(F.sum(F.when(v >= tail, F.col(weight)).otherwise(0.0)), F.sum(weight)).alias("tail_share"))


def route_conditions(rows: DataFrame, key: list[str], position: str, value: str, weight: str, high: float, least_coverage: float) -> DataFrame:
    """Weighted mean, P90, high share, first and last fifth, the five worst values, coverage and status.

    ``rows`` are a trip's tokens, so the list of worst values is short before it is cut to five.
    """
    known, v, w, p = F.col(value).isNotNull(), F.col(value), F.col(weight), F.col(position)
    up = Window.partitionBy(*key).orderBy(F.col(value).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_kw", F.when(known, w).otherwise(0.0)).withColumn("_cum", F.sum("_kw").over(up)).withColumn("_all", F.sum("_kw").over(Window.partitionBy(*key)))
    mean = lambda c: F.try_divide(F.sum(F.when(c & known, w * v)), F.sum(F.when(c & known, w)))
    out = run.groupBy(*key).agg(
        F.coalesce(F.try_divide(F.sum("_kw"), F.sum(w)), F.lit(0.0)).alias("coverage"), mean(F.lit(True)).alias("mean"),
        F.min(F.when(known & (F.col("_cum") >= 0.9 * F.col("_all") - 1e-9), v)).alias("p90"), F.try_divide(F.sum(F.when(v >= high, w).otherwise(0.0)), F.sum("_kw")).alias("high_share"),
        mean(p <= 0.2).alias("first"), mean(p >= 0.8).alias("last"), F.slice(F.sort_array(F.collect_list(v), asc=False), 1, 5).alias("worst"))
    status = F.when(F.col("coverage") == 0, "missing").when(F.col("coverage") < least_coverage, "partial").otherwise("complete")
    return out.withColumn("status", status)


def scenario_summary(rows: DataFrame, scenario: str, baseline: str, value: str) -> DataFrame:
    """Rows, mean and total per scenario, and change of the mean against the baseline."""
    s = rows.groupBy(scenario).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    base = s.where(F.col(scenario) == baseline).select(F.col("mean").alias("_b"))
    return s.crossJoin(F.broadcast(base)).withColumn("change", F.try_divide(F.col("mean") - F.col("_b"), F.col("_b"))).drop("_b")  # one row


def best_feasible(rows: DataFrame, key: list[str], feasible: Column, order: list[str], distance: str, original: str, longest: float) -> DataFrame:
    """The first feasible candidate in order that is not longer than ``longest`` times the original."""
    ok = rows.where(feasible & (F.col(distance) <= longest * F.col(original)))
    pick = F.min(F.struct(*order)).alias("best")
    return rows.select(*key).distinct().join(ok.groupBy(*key).agg(pick), key, "left").select(*key, *[F.col(f"best.{c}").alias(c) for c in order])
