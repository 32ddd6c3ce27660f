"""History as of a decision time: nothing at or after it is ever seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.exprs import micros


def _together(events: DataFrame, queries: DataFrame, key: str, ts: str, value: str, qid: str) -> DataFrame:
    e = events.select(F.col(key), micros(F.col(ts)).alias("_t"), F.col(value).alias("_v"), F.lit(None).cast("long").alias(qid), F.lit(0).alias("_q"))
    q = queries.select(F.col(key), micros(F.col(ts)).alias("_t"), F.lit(None).cast("double").alias("_v"), F.col(qid), F.lit(1).alias("_q"))
    return e.unionByName(q)


def asof(events: DataFrame, queries: DataFrame, key: str, ts: str, value: str, qid: str, inclusive: bool = True,
         max_age_s: float | None = None) -> DataFrame:
    """Latest value of the key at (or strictly before) each query's time, and its age; null beyond ``max_age_s``.

    One shuffle on the key: events and queries are united and the last value is carried on.
    """
    both = _together(events, queries, key, ts, value, qid)
    w = Window.partitionBy(key).orderBy("_t", "_q" if inclusive else F.desc("_q"), "_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v")), ignorenulls=True).over(w)
    out = both.withColumn("_l", last).where("_q = 1").withColumn("age_s", (F.col("_t") - F.col("_l._t")) / 1e6)
    fresh = F.lit(True) if max_age_s is None else F.col("age_s") <= max_age_s
    return out.select(qid, F.when(fresh, F.col("_l._v")).alias("value"), F.when(fresh, F.col("age_s")).alias("age_s"))


def window_history(events: DataFrame, queries: DataFrame, key: str, ts: str, value: str, qid: str, window_s: int | None) -> DataFrame:
    """Mean, population std, count and last age of the key's events in [t - window, t) (J8); all past if None."""
    both = _together(events, queries, key, ts, value, qid)
    low = Window.unboundedPreceding if window_s is None else -window_s * 1_000_000
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(low, -1)
    seen = F.when(F.col("_v").isNotNull(), F.col("_t"))
    return (both.select(qid, "_q", F.avg("_v").over(w).alias("mean"), F.stddev_pop("_v").over(w).alias("std"), F.count("_v").over(w).alias("n"),
                        ((F.col("_t") - F.max(seen).over(w)) / 1e6).alias("last_age_s")).where("_q = 1").drop("_q"))


def fallback(levels: list[tuple[str, Column, Column]], least: int) -> tuple[Column, Column]:
    """(value, level) of the first level with enough support; levels: (name, value, support)."""
    value, level = F.lit(None), F.lit(None)
    for name, v, n in reversed(levels):
        ok = F.coalesce(n >= least, F.lit(False))
        value, level = F.when(ok, v).otherwise(value), F.when(ok, F.lit(name)).otherwise(level)
    return value, level


def hierarchical_lookup(train: DataFrame, rows: DataFrame, levels: list[list[str]], value: str, least: int) -> DataFrame:
    """Mean of ``value`` at the first level of keys with ``least`` training rows; an empty key list is global."""
    out, found = rows, []
    for i, keys in enumerate(levels):
        stat = train.groupBy(*keys).agg(F.avg(value).alias(f"_m{i}"), F.count(value).alias(f"_n{i}"))
        out = out.join(stat, keys, "left") if keys else out.crossJoin(stat)  # the global level is one row
        found.append(("_".join(keys) or "global", F.col(f"_m{i}"), F.col(f"_n{i}")))
    v, level = fallback(found, least)
    return out.withColumn("reference", v).withColumn("level", level).drop(*[f"_{c}{i}" for i in range(len(levels)) for c in "mn"])


def previous_days(rows: DataFrame, key: list[str], date: str, value: str, k: int) -> DataFrame:
    """Per key and date: mean, sample std and count over the k previous available dates."""
    daily = rows.groupBy(*key, date).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"), F.count(value).alias("c"))
    w = Window.partitionBy(*key).orderBy(date).rowsBetween(-k, -1)
    d = daily.select(*key, date, *[F.sum(c).over(w).alias(c) for c in ("s", "ss", "c")])
    mean = F.try_divide(F.col("s"), F.col("c"))
    var = F.try_divide(F.greatest(F.col("ss") - F.col("c") * mean * mean, F.lit(0.0)), F.col("c") - 1)
    return d.select(*key, date, mean.alias("mean"), F.sqrt(var).alias("std"), F.coalesce("c", F.lit(0)).alias("n"))
