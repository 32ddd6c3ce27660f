"""Running sums over a global order without one task: ranges of the order are summed apart, then within."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.scratch import materialize


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equal in all ``columns``, nulls being equal."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns], F.lit(True))


def running(rows: DataFrame, key: list[str], order: str, sums: dict[str, str], descending: bool = False, largest: bool = False) -> DataFrame:
    """``rows`` with, per entry out = column of ``sums``, the sum over the key's rows up to and with this value of ``order``, or the ``largest`` value in place of the sum.

    Rows are range-partitioned by key and order, so a key of any size is spread. The table is written once, as
    ranges are drawn from a sample and must not change between the two steps.
    """
    by = [*key, F.desc(order) if descending else F.col(order)]
    placed = materialize(rows.repartitionByRange(*by).withColumn("_slot", F.spark_partition_id()), "ranges")
    add = F.max if largest else F.sum
    ranges = placed.groupBy(*key, "_slot").agg(*[add(c).alias(f"_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = ranges.select(*key, "_slot", *[add(f"_{o}").over(before).alias(f"_{o}") for o in sums])
    inside = Window.partitionBy(*key, "_slot").orderBy(by[-1]).rangeBetween(Window.unboundedPreceding, 0)
    out = placed.select("*", *[add(c).over(inside).alias(o) for o, c in sums.items()])
    joined = out.join(ranges, same(out, ranges, [*key, "_slot"]))
    both = lambda o: F.greatest(out[o], ranges[f"_{o}"]) if largest else out[o] + F.coalesce(ranges[f"_{o}"], F.lit(0))
    return joined.select(*[out[c] for c in rows.columns], *[both(o).alias(o) for o in sums])


def counted(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """``(key, value, n, upto, total)`` per distinct value: its rows, those up to it, and all of the key."""
    at = rows.groupBy(*key, value).agg(F.count("*").alias("n"))
    total = at.groupBy(*key).agg(F.sum("n").alias("total"))
    run = running(at, key, value, {"upto": "n"})
    return run.join(total, same(run, total, key)).select(run["*"], "total")


def pick(values: DataFrame, key: list[str], value: str, place: Column) -> Column:
    """Aggregate over ``counted`` rows: the value at a place (from 0) of the sorted rows."""
    return F.min(F.when(F.col("upto") > place, F.col(value)))


def linear_quantiles(rows: DataFrame, key: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Per key the named quantiles with linear interpolation, from counts by distinct value over ranges, so that no key's values meet in one buffer."""
    at = counted(rows.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("_x")), key, "_x")
    place = lambda q: F.round(F.lit(q) * (F.col("total") - 1), 9)
    found = lambda i: F.min(F.when(F.col("upto") > i, F.col("_x")))

    def one(q: float) -> Column:
        low = found(F.floor(place(q)))
        return low + F.max(place(q) - F.floor(place(q))) * (found(F.ceil(place(q))) - low)

    return at.groupBy(*key).agg(*[one(q).alias(name) for name, q in quantiles.items()])


def with_quantiles(stats: DataFrame, rows: DataFrame, key: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """``stats``, a row per key, with the keys' quantiles; null where a key has no values."""
    found = linear_quantiles(rows, key, value, quantiles)
    if not key:
        return stats.crossJoin(found)  # one row each
    return stats.join(found, same(stats, found, key), "left").select(stats["*"], *quantiles)


def at_places(values: DataFrame, value: str, asked: DataFrame, place: str) -> DataFrame:
    """``(place, value)`` for each distinct whole place asked for, counted from 0 in the sorted rows behind ``values`` (value, n, upto as by ``counted``).

    A value that many rows share stays one row: places and values meet in one order, where the last value that begins at or
    before a place, the largest so far, is the one at it. Places beyond the rows hold the last value.
    """
    begins = values.select((F.col("upto") - F.col("n")).alias("_p"), F.col(value).alias("_v"), F.lit(False).alias("_asked"))
    asks = asked.select(F.col(place).cast("long").alias("_p")).where("_p is not null").distinct().select("_p", F.lit(None).cast(values.schema[value].dataType).alias("_v"), F.lit(True).alias("_asked"))
    run = running(begins.unionByName(asks), [], "_p", {"_found": "_v"}, largest=True)
    return run.where("_asked").select(F.col("_p").alias(place), F.col("_found").alias(value))
