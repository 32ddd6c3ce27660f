"""Samples by seeded hashes: the same rows whatever the order and partitioning of the input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.exprs import hash_modulo, hash_uniform, seeded_hash
from waymark.operators.ranks import running, same


def hash_sample(rows: DataFrame, group: list[str], key: str, seed: str, n: int) -> DataFrame:
    """The n smallest hashes per group, with probability and design weight (T1). A null group is a group.

    Each input partition ranks its own rows first, and the n smallest of every group there are
    ranked together, so that a hot group or key is never sorted whole.
    """
    hashed = rows.withColumn("_h", seeded_hash(seed, F.col(key))).withColumn("_slot", F.spark_partition_id())

    def least(found: DataFrame, by: list[str], rank: str) -> DataFrame:
        return found.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))).where(F.col(rank) <= n)

    out = least(least(hashed, [*group, "_slot"], "_r").drop("_r", "_slot"), group, "rank")
    size = rows.groupBy(*group).agg(F.count("*").alias("_n")).toDF(*[f"_g{i}" for i in range(len(group))], "_n")
    out = out.join(size, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.lit(True)))
    p = F.least(F.lit(1.0), n / F.col("_n"))
    return out.select(*group, *[c for c in rows.columns if c not in group], "rank", p.alias("probability"), (1 / p).alias("design_weight"))


def thin(rows: DataFrame, key: str, seed: str, rate: float) -> DataFrame:
    """Whole keys whose draw is below the rate."""
    return rows.where(hash_uniform(seed, F.col(key)) < rate)


def proportional_sample(rows: DataFrame, stratum: list[str], key: str, seed: str, ratio: float) -> DataFrame:
    """Per stratum floor(n x ratio + 0.5) rows by seeded hash, over ranges of the order."""
    each = rows.withColumns({"_one": F.lit(1), "_o": F.struct(seeded_hash(seed, F.col(key)).alias("h"), key)})
    ranked, n = running(each, stratum, "_o", {"_r": "_one"}), rows.groupBy(*stratum).agg(F.count("*").alias("_n"))
    return ranked.join(n, same(ranked, n, stratum)).where(F.col("_r") <= F.floor(F.col("_n") * ratio + 0.5)).select(*[ranked[c] for c in rows.columns])


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group (T4)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def folds(rows: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """``fold`` by the full hash of a grouping key."""
    return rows.withColumn("fold", hash_modulo(seed, F.col(key), k))
