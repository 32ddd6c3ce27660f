"""Cluster bootstrap with replacement, several statistics from one set of draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.exprs import hash_uniform
from waymark.operators.ranks import running
from waymark.plans.scratch import materialize


def cluster_draws(clusters: DataFrame, cluster: str, repeats: int, seed: str) -> DataFrame:
    """``(rep, cluster, times)``: in each repeat as many clusters are drawn as there are, with replacement.

    Draw k of a repeat is the cluster at place floor(u n) in key order, u being the hashed (seed, repeat, k). The places are a distributed index, and
    draws meet it by an equi-join; every cluster deals the draws of its own place, so nothing is dealt in one task.
    """
    keyed = clusters.select(cluster).distinct().withColumn("_one", F.lit(1))
    index = materialize(running(keyed, [], cluster, {"_place": "_one"}).select(cluster, (F.col("_place") - 1).alias("_place")), "index")
    n = index.agg(F.count("*").alias("_n"))
    draws = index.select(F.col("_place").alias("_k")).crossJoin(n).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))  # one row
    draws = draws.select("rep", F.floor(hash_uniform(seed, F.col("rep"), F.col("_k")) * F.col("_n")).cast("long").alias("_place"))
    return draws.groupBy("rep", "_place").agg(F.count("*").alias("times")).join(index, "_place").select("rep", cluster, "times")


def bootstrap(rows: DataFrame, cluster: str, sums: dict[str, Column], statistics: dict[str, Callable[[Callable[[str], Column]], Column]],
              repeats: int, seed: str, level: float = 0.95) -> DataFrame:
    """Per statistic its value on the data, mean over the repeats, and percentile interval.

    ``sums``: what is added up per cluster, by name. ``statistics``: a function of the resampled sums each, so a mean is
    ``lambda s: s("error") / s("n")``, a paired difference ``lambda s: (s("error_a") - s("error_b")) / s("n")`` and a rate ratio
    ``lambda s: (s("hits_a") / s("rows_a")) / (s("hits_b") / s("rows_b"))``. A statistic over nothing is null and stays out of the interval.
    """
    each = materialize(rows.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(*[F.sum(c).cast("double").alias(f"_{n}") for n, c in sums.items()]), "sums")
    drawn = cluster_draws(each, cluster, repeats, seed).join(each, cluster)
    totals = drawn.groupBy("rep").agg(*[F.sum(F.col("times") * F.col(f"_{n}")).alias(f"_{n}") for n in sums])
    whole = each.agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums]).withColumn("rep", F.lit(0))
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), f(lambda c: F.col(f"_{c}")).alias("v")) for n, f in statistics.items()]))
    long = totals.unionByName(whole).select("rep", values.alias("s")).select("rep", "s.*")
    resampled = F.when(F.col("rep") > 0, F.col("v"))
    ends = [F.percentile(resampled, F.lit(q)) for q in ((1 - level) / 2, (1 + level) / 2)]  # as many values as repeats
    return long.groupBy("statistic").agg(F.max(F.when(F.col("rep") == 0, F.col("v"))).alias("estimate"), F.avg(resampled).alias("mean"), ends[0].alias("low"), ends[1].alias("high"))
