"""Ordered work within a trip or user: gaps, sessions, islands, positions and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.exprs import micros
from waymark.operators.ranks import counted, same


def next_intervals(rows: DataFrame, key: list[str], ts: str, tie: str) -> DataFrame:
    """Each row with ``duration_s`` to the next one of its key; the last has none."""
    w = Window.partitionBy(*key).orderBy(ts, tie)
    return rows.withColumn("duration_s", (micros(F.lead(ts).over(w)) - micros(F.col(ts))) / 1e6)


def running_end(rows: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """``previous_end``: latest end of any earlier row of the key; overlaps where the start is before it."""
    w = Window.partitionBy(key).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous_end", F.max(end).over(w)).withColumn("overlaps", F.coalesce(F.col(start) < F.col("previous_end"), F.lit(False)))


def sessionize(rows: DataFrame, key: str, start: str, end: str, tie: str, gap_s: float) -> DataFrame:
    """``session`` numbers from 0: a new one begins more than ``gap_s`` after the latest end so far.

    start, end: epoch seconds. A trip nested in an earlier one never opens a session.
    """
    marked = running_end(rows, key, start, end, tie)
    opens = F.when(F.col(start) - F.col("previous_end") > gap_s, 1).otherwise(0)
    return marked.withColumn("session", F.sum(opens).over(Window.partitionBy(key).orderBy(start, tie)).cast("long"))


def exclusive_sum(rows: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Sum of the earlier rows, 0 for the first."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def positions(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """sequence from 0, link_count, and position ratio sequence / max(count - 1, 1)."""
    w = Window.partitionBy(*key)
    return (rows.withColumn("sequence", (F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
            .withColumn("link_count", F.count("*").over(w))
            .withColumn("position_ratio", F.col("sequence") / F.greatest(F.col("link_count") - 1, F.lit(1))))


def remaining_ratio(rows: DataFrame, key: list[str], order: list[str], length: str) -> DataFrame:
    """``remaining_ratio``: share of the route's length from this part's start to the destination; null for a route without length."""
    w = Window.partitionBy(*key)
    total = F.sum(length).over(w)
    before = F.coalesce(F.sum(length).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("remaining_ratio", F.when(total > 0, (total - before) / total))


def islands(rows: DataFrame, key: list[str], order: list[str], flag: Column) -> DataFrame:
    """``island``: number of the run of equal flags within the key."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = F.coalesce((flag != F.lag(flag).over(w)).cast("int"), F.lit(1))
    return rows.withColumn("flag", flag).withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(w)).drop("_changed")


def longest_run(rows: DataFrame, key: list[str], order: list[str], flag: Column, weight: str) -> DataFrame:
    """Per key: weight and rows of the heaviest run with the flag set, nulls if none."""
    runs = islands(rows, key, order, flag).groupBy(*key, "island", "flag").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    best = F.max(F.when(F.col("flag"), F.struct("w", "n")))
    return runs.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.w").alias("run_weight"), F.col("b.n").alias("run_rows"))


def centred_median(rows: DataFrame, key: list[str], order: list[str], value: str, half: int = 2, least: int = 3) -> DataFrame:
    """Median of the 2 * half + 1 rows around, null on fewer than ``least`` values."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-half, half)
    return rows.withColumn("local_median", F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))


def share_of_total(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """x / sum of x over the key."""
    return rows.withColumn("share", F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*key))))


def average_rank(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rank from 1 with ties averaged, and percent rank (W9), from counts by distinct value."""
    at = counted(rows, key, value)
    out = rows.join(at, same(rows, at, [*key, value]))
    rank = F.col("upto") - (F.col("n") - 1) / 2
    return out.select(*[rows[c] for c in rows.columns], rank.alias("avg_rank"), (rank / F.col("total")).alias("pct_rank"))


def largest_remainder(rows: DataFrame, group: list[str], share: str, total: int, tie: str) -> DataFrame:
    """Integer ``quota`` per row that sums to ``total`` in each group: floors, then the largest fractions."""
    w = Window.partitionBy(*group)
    exact = F.col(share) * total / F.sum(share).over(w)
    out = rows.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    turn = F.row_number().over(w.orderBy(F.round("_rest", 9).desc(), tie))
    return out.withColumn("quota", (F.col("_floor") + (turn <= total - F.sum("_floor").over(w)).cast("int")).cast("long")).drop("_floor", "_rest")


def allocate(rows: DataFrame, key: list[str], order: list[str], total: str, weight: str) -> DataFrame:
    """Split ``total`` by weight, the last row taking the exact remainder; equal parts if no weight."""
    w = Window.partitionBy(*key)
    run = w.orderBy(*order)
    sum_w = F.sum(weight).over(w)
    part = F.when(sum_w > 0, F.col(total) * F.col(weight) / sum_w).otherwise(F.col(total) / F.count("*").over(w))
    out = rows.withColumn("_part", part).withColumn("_last", F.row_number().over(run) == F.count("*").over(w))
    before = F.coalesce(F.sum("_part").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return out.withColumn("allocated", F.when(F.col("_last"), F.col(total) - before).otherwise(F.col("_part"))).drop("_part", "_last")


def overlapping_chunks(rows: DataFrame, key: list[str], sequence: str, length: int, step: int) -> DataFrame:
    """Rows dealt to fixed-length windows, the last one flush with the end; weight = 1 / windows that hold the row."""
    place = F.col(sequence).cast("long")
    last = F.greatest(F.max(sequence).over(Window.partitionBy(*key)) + 1 - length, F.lit(0)).cast("long")
    first, until = F.greatest(F.ceil((place - length + 1) / step), F.lit(0)).cast("long"), F.floor(place / step).cast("long")
    regular = F.when(first <= until, F.transform(F.sequence(first, until), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))  # at most length / step + 1
    own = F.filter(F.array_union(F.filter(regular, lambda s: s <= F.col("_last")), F.array("_last")), lambda s: (s <= place) & (place < s + length))
    out = rows.withColumn("_last", last).withColumn("chunk_start", F.explode(own))
    return out.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(*key, sequence))).drop("_last")


def idle_chains(rows: DataFrame, key: str, trip: str, start: str, end: str, longest_s: float) -> DataFrame:
    """Each trip with the one before it: gap, and whether they overlap or lie far apart (G11). start, end: epoch seconds."""
    w = Window.partitionBy(key).orderBy(start, trip)
    out = rows.withColumn("previous", F.lag(trip).over(w)).withColumn("gap_s", F.col(start) - F.lag(end).over(w)).where("previous is not null")
    return out.withColumn("overlaps", F.col("gap_s") < 0).withColumn("long", F.col("gap_s") > longest_s)
