"""Histograms, quantiles and distribution functions, by key. All shuffles are on (key, bin) with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.ranks import counted, running, same
from waymark.plans.scratch import materialize


def histogram(rows: DataFrame, key: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per key and bin: 0..bins-1, -1 under, ``bins`` over, null invalid; the top edge is in the last bin."""
    x = F.col(value)
    index = (F.when(x.isNull() | F.isnan(x), None).when(x < low, -1).when(x > high, bins)
             .otherwise(F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))))
    return rows.withColumn("bin", index.cast("long")).groupBy(*key, "bin").agg(F.count("*").alias("n"))


def multi_level(rows: DataFrame, levels: dict[str, Column], value: str, low: float, high: float, bins: int) -> DataFrame:
    """The histogram at several key levels in one pass."""
    each = rows.withColumn("_l", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), c.alias("key")) for n, c in levels.items()])))
    return histogram(each.select("_l.level", "_l.key", value), ["level", "key"], value, low, high, bins)


def histogram_quantile(hist: DataFrame, key: list[str], q: float, low: float, high: float, bins: int) -> DataFrame:
    """Quantile at q (n - 1) with interpolation inside the bin (A10)."""
    inside = hist.where(F.col("bin").between(0, bins - 1))
    w = Window.partitionBy(*key)
    run = inside.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    run = run.withColumn("target", q * (F.col("total") - 1)).where(F.col("upto") > F.col("target"))
    first = run.groupBy(*key).agg(F.min_by(F.struct("bin", "n", "upto", "target", "total"), "bin").alias("b"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("b.target") - (F.col("b.upto") - F.col("b.n")) + 0.5) / F.col("b.n")))
    return first.select(*key, (low + (F.col("b.bin") + part) * ((high - low) / bins)).alias("quantile"), F.col("b.total").alias("support"))


def midrank_cdf(hist: DataFrame, key: list[str]) -> DataFrame:
    """(cumulative - n / 2) / total at each occupied bin."""
    w = Window.partitionBy(*key)
    return hist.withColumn("cdf", (F.sum("n").over(w.orderBy("bin")) - F.col("n") / 2) / F.sum("n").over(w))


def interpolated_cdf(train: DataFrame, rows: DataFrame, levels: dict[str, Column], value: str, low: float, high: float, bins: int, least: int) -> DataFrame:
    """Midrank CDF of each row's value in its first cohort level with ``least`` training values, with that level and its support.

    In an occupied bin it is the bin's midrank; in an empty one it is interpolated between the centres of the
    occupied bins before and after, and outside them 0 or 1. A missing value has none. ``levels``: name to cohort key, most special first.

    The histograms are the whole training state. Bins that rows ask for and bins that are occupied meet in one
    union, where two running windows a cohort, over at most 2 (bins + 2) rows, bring both neighbours.
    """
    width = (high - low) / bins
    hist = multi_level(train, levels, value, low, high, bins).where(F.col("bin").between(0, bins - 1))
    hist = materialize(midrank_cdf(hist, ["level", "key"]).withColumn("support", F.sum("n").over(Window.partitionBy("level", "key"))), "cohorts")
    total = hist.select("level", "key", "support").distinct().where(F.col("support") >= least)
    names = [c for c in rows.columns]
    out, chosen = rows, F.lit(None)
    for i, (name, key) in reversed(list(enumerate(levels.items()))):
        one = total.where(F.col("level") == name).select(F.col("key").alias(f"_k{i}"), F.col("support").alias(f"_n{i}"))
        mine = out.withColumn(f"_own{i}", key)
        out = mine.join(one, mine[f"_own{i}"].eqNullSafe(one[f"_k{i}"]), "left")
        chosen = F.when(F.col(f"_n{i}").isNotNull(), F.struct(F.lit(name).alias("level"), F.col(f"_own{i}").alias("key"), F.col(f"_n{i}").alias("support"))).otherwise(chosen)
    x = F.col(value)
    spot = F.when(x < low, -1).when(x > high, bins).otherwise(F.least(F.floor((x - low) / width), F.lit(bins - 1))).cast("long")
    out = materialize(out.select(*names, chosen.alias("_at"), F.when(x.isNotNull() & ~F.isnan(x), spot).alias("_bin")), "asked")
    asked = out.where("_at is not null and _bin is not null").select("_at.level", "_at.key", F.col("_bin").alias("bin")).distinct()
    none = F.lit(None).cast("struct<bin:bigint,cdf:double>")
    both = hist.select("level", "key", "bin", F.struct("bin", "cdf").alias("here"), F.lit(False).alias("query")).unionByName(
        asked.select("level", "key", "bin", none.alias("here"), F.lit(True).alias("query")))
    order = Window.partitionBy("level", "key").orderBy("bin")
    both = both.withColumn("before", F.last("here", True).over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("here", True).over(order.rangeBetween(0, Window.unboundedFollowing)))
    found = both.where("query").select(F.struct("level", "key").alias("_of"), F.col("bin").alias("_b"), "before", "after")
    j = out.join(found, F.struct("_at.level", "_at.key").eqNullSafe(F.col("_of")) & (F.col("_bin") == F.col("_b")), "left")
    centre = lambda b: low + (F.col(b) + 0.5) * width
    part = (x - centre("before.bin")) / (centre("after.bin") - centre("before.bin"))
    cdf = (F.when(F.col("_bin").isNull() | F.col("_at").isNull(), None).when(F.col("before").isNull(), 0.0).when(F.col("after").isNull(), 1.0)
           .when(F.col("before.bin") == F.col("after.bin"), F.col("before.cdf")).otherwise(F.col("before.cdf") + part * (F.col("after.cdf") - F.col("before.cdf"))))
    return j.select(*names, cdf.cast("double").alias("cdf"), F.col("_at.level").alias("level"), F.col("_at.support").alias("support"))


def ecdf(train: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """Share of the key's training values at or below each row's value, null without training values."""
    both = train.select(F.col(key), F.col(value), F.lit(1).alias("_t")).unionByName(rows.select(key, value, F.lit(0).alias("_t")))
    at = both.groupBy(key, value).agg(F.sum("_t").alias("_t"))
    total = at.groupBy(key).agg(F.sum("_t").alias("_n"))
    run = running(at, [key], value, {"_upto": "_t"})
    out = rows.join(run, same(rows, run, [key, value])).select(rows["*"], "_upto")
    return out.join(total, same(out, total, [key])).select(*[out[c] for c in rows.columns], F.try_divide(F.col("_upto"), F.col("_n")).alias("ecdf"), F.col("_n").alias("support"))


def ecdf_with_fallback(train: DataFrame, rows: DataFrame, levels: list[str], value: str, least: int) -> DataFrame:
    """The share at the first level of key with ``least`` training values, and that level."""
    out, found = rows, []
    for i, key in enumerate(levels):
        out = ecdf(train, out, key, value).withColumnRenamed("ecdf", f"_e{i}").withColumnRenamed("support", f"_n{i}")
        found.append((key, F.col(f"_e{i}"), F.col(f"_n{i}") >= least))
    share, level = F.lit(None), F.lit(None)
    for key, e, ok in reversed(found):
        share, level = F.when(ok, e).otherwise(share), F.when(ok, F.lit(key)).otherwise(level)
    return out.select(*rows.columns, share.alias("ecdf"), level.alias("level"))


def weighted_quantile(rows: DataFrame, key: list[str], value: str, weight: str, q: float) -> DataFrame:
    """The smallest value whose cumulative weight reaches q of the total."""
    at = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*key, value).agg(F.sum(weight).alias("_w"))
    run, total = running(at, key, value, {"_c": "_w"}), at.groupBy(*key).agg(F.sum("_w").alias("_t"))
    both = run.join(total, same(run, total, key)).select(run["*"], "_t")
    return both.groupBy(*key).agg(F.min(F.when(F.col("_c") >= q * F.col("_t") - 1e-9, F.col(value))).alias("weighted_q"))


def weighted_mid_cdf(rows: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """(weight below + half the weight at the value) / total, per distinct value, over ranges of the order."""
    at = rows.groupBy(*key, value).agg(F.sum(weight).alias("w"))
    run, total = running(at, key, value, {"_c": "w"}), at.groupBy(*key).agg(F.sum("w").alias("_t"))
    return run.join(total, same(run, total, key)).select(*[run[c] for c in at.columns], ((F.col("_c") - F.col("w") / 2) / F.col("_t")).alias("mid_cdf"))


def exact_quantiles(rows: DataFrame, key: list[str], value: str, q: float) -> DataFrame:
    """linear, inverted_cdf, higher and nearest of one quantile, and the median (A16), from counts by distinct value."""
    at = counted(rows.where(F.col(value).isNotNull()), key, value)
    place = F.round(q * (F.col("total") - 1), 9)
    half = (F.col("total") - 1) / 2
    pick = lambda i: F.min(F.when(F.col("upto") > i, F.col(value)))
    out = at.groupBy(*key).agg(
        pick(F.floor(place)).alias("_lo"), pick(F.ceil(place)).alias("higher"), F.max(place - F.floor(place)).alias("_part"),
        F.min(F.when(F.col("upto") / F.col("total") >= q - 1e-12, F.col(value))).alias("inverted_cdf"),
        pick(F.bround(q * (F.col("total") - 1), 0)).alias("nearest"), ((pick(F.floor(half)) + pick(F.ceil(half))) / 2).alias("median"))
    return out.select(*key, (F.col("_lo") + F.col("_part") * (F.col("higher") - F.col("_lo"))).alias("linear"), "inverted_cdf", "higher", "nearest", "median")


def mode_with_fallback(train: DataFrame, rows: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """The most frequent training value, the smallest of equals, at the first level of keys that has one, and that level."""
    out, mode, level = rows, F.lit(None), F.lit(None)
    for i, keys in reversed(list(enumerate(levels))):
        n = train.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
        most = n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(f"_m{i}"))
        out = out.join(most, keys, "left") if keys else out.crossJoin(F.broadcast(most))  # one row
        here = F.col(f"_m{i}").isNotNull()
        mode, level = F.when(here, F.col(f"_m{i}")).otherwise(mode), F.when(here, F.lit("_".join(keys) or "global")).otherwise(level)
    return out.withColumns({"mode": mode, "mode_level": level}).drop(*[f"_m{i}" for i in range(len(levels))])
