"""Evaluation: errors, ranking, calibration, drift and intervals, by slice. Ties are exact, never binned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.ranks import counted, running
from waymark.operators.sequence import average_rank


def regression(rows: DataFrame, key: list[str], truth: str, prediction: str) -> DataFrame:
    """n, MAE, RMSE, bias, Pearson."""
    e = F.col(prediction) - F.col(truth)
    return rows.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull()).groupBy(*key).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.corr(truth, prediction).alias("pearson"))


def regression_slices(rows: DataFrame, slices: list[str], truth: str, prediction: str) -> DataFrame:
    """The errors of ``regression`` per value of each slice and over all rows, in one pass; ``slice`` names the column, or overall (E5)."""
    e = F.col(prediction) - F.col(truth)
    each = F.explode(F.array(F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("level")), *[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("level")) for s in slices]))
    known = rows.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull()).select(truth, prediction, each.alias("_s")).select(truth, prediction, "_s.*")
    return known.groupBy("slice", "level").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.corr(truth, prediction).alias("pearson"))


def spearman(rows: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Correlation of tie-averaged ranks, null for a constant."""
    ra = average_rank(rows, key, a).withColumnRenamed("avg_rank", "ra").drop("pct_rank")
    rb = average_rank(ra, key, b)
    return rb.groupBy(*key).agg(F.corr("ra", "avg_rank").alias("spearman"))


def binary(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """n, positives, ROC-AUC, average precision, Brier (E2). Sums by distinct score first, so equal scores count half."""
    at = rows.groupBy(score).agg(F.sum(F.col(truth)).alias("p"), F.count("*").alias("c"), F.sum(F.pow(F.col(score) - F.col(truth), 2)).alias("b"))
    run = running(at, [], score, {"tp": "p", "seen": "c"}, descending=True).withColumn("neg", F.col("c") - F.col("p"))
    total = run.agg(F.sum("p").alias("P"), F.sum("neg").alias("N"), F.sum("b").alias("B"),
                    F.sum(F.col("neg") * (F.col("tp") - F.col("p") / 2)).alias("wins"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("prec"))
    return total.select((F.col("P") + F.col("N")).alias("n"), F.col("P").alias("positives"), F.try_divide(F.col("wins"), F.col("P") * F.col("N")).alias("auc"),
                        F.try_divide(F.col("prec"), F.col("P")).alias("average_precision"), F.try_divide(F.col("B"), F.col("P") + F.col("N")).alias("brier"))


def reliability(rows: DataFrame, truth: str, score: str, bins: int = 15) -> DataFrame:
    """Per equal-width bin: n, mean score, mean truth."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("mean_truth"))


def calibration_error(rows: DataFrame, truth: str, score: str, bins: int = 15) -> DataFrame:
    """Sum over bins of share x |mean score - mean truth|."""
    r = reliability(rows, truth, score, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_truth"))) / F.sum("n")).alias("ece"))


def cohort_calibration_error(rows: DataFrame, cohort: list[str], truth: str, score: str, bins: int = 15) -> DataFrame:
    """``calibration_error`` per cohort, with its rows."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    r = rows.groupBy(*cohort, b.alias("_bin")).agg(F.count("*").alias("_n"), F.avg(score).alias("_s"), F.avg(truth).alias("_t"))
    return r.groupBy(*cohort).agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.abs(F.col("_s") - F.col("_t"))) / F.sum("_n")).alias("ece"))


def distribution_distance(a: DataFrame, b: DataFrame, cell: str) -> DataFrame:
    """Total variation, Jensen-Shannon (natural log), shared mass and Jaccard of two samples over the union of cells."""
    p = a.groupBy(cell).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")
    q = b.groupBy(cell).agg(F.count("*").alias("n")).withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")
    both = p.join(q, cell, "full_outer").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)
    return both.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"), (F.sum(kl("p") + kl("q")) / 2).alias("jensen_shannon"),
                    F.sum(F.least("p", "q")).alias("shared_mass"), (F.count_if((F.col("p") > 0) & (F.col("q") > 0)) / F.count("*")).alias("jaccard"))


def ks_distance(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Largest distance of two empirical distribution functions (E8), on sums by distinct value."""
    both = a.select(value, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(value, F.lit(0).alias("x"), F.lit(1).alias("y")))
    at = both.groupBy(value).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    run = running(at, [], value, {"cx": "x", "cy": "y"})
    return run.crossJoin(run.agg(F.max("cx").alias("nx"), F.max("cy").alias("ny"))).agg(F.max(F.abs(F.col("cx") / F.col("nx") - F.col("cy") / F.col("ny"))).alias("ks"))


def variance_shares(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Between and within sums of squares, and ICC with unequal group sizes."""
    g = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("v")).alias("within_ss"),
              F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("tt"))
    between = F.col("tt") - F.col("t") * F.col("t") / F.col("N")
    msb, msw = F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within_ss"), F.col("N") - F.col("k"))
    n0 = F.try_divide(F.col("N") - F.col("nn") / F.col("N"), F.col("k") - 1)
    return s.select(between.alias("between_ss"), "within_ss", F.try_divide(msb - msw, msb + (n0 - 1) * msw).alias("icc"))


def split_conformal(calibration: DataFrame, rows: DataFrame, truth: str, prediction: str, level: float = 0.9) -> DataFrame:
    """Band of the ``level`` quantile (method higher) of absolute calibration residuals: q, coverage, mean width."""
    r = calibration.select(F.abs(F.col(truth) - F.col(prediction)).alias("r"))
    # the higher quantile is the smallest residual with at least ceil(level (n - 1)) residuals below it
    at = counted(r.where("r is not null"), [], "r")
    q = at.where(F.col("upto") >= F.ceil(F.round(level * (F.col("total") - 1), 9)) + 1).agg(F.min("r").alias("q"))
    low = F.greatest(F.col(prediction) - F.col("q"), F.lit(0.0))
    return rows.crossJoin(q).agg(F.max("q").alias("q"), F.avg(F.col(truth).between(low, F.col(prediction) + F.col("q")).cast("int")).alias("coverage"),
                                 F.avg(F.col(prediction) + F.col("q") - low).alias("width"))


def top_fraction(rows: DataFrame, truth: str, score: str, tie: str, share: float) -> DataFrame:
    """Precision, recall and lift of the top ceil(n x share) rows by score."""
    n = rows.agg(F.count("*").alias("n"), F.sum(truth).alias("P")).first()
    k = -(-n["n"] * int(round(share * 1_000_000)) // 1_000_000)
    # scores above the cut are in; rows of the score at the cut, nulls last, are taken by the tie
    at = running(rows.groupBy(score).agg(F.count("*").alias("c"), F.sum(truth).alias("p")), [], score, {"seen": "c"}, descending=True)
    cut = at.where(F.col("seen") >= k).agg(F.max_by(F.struct(score, (F.col("seen") - F.col("c")).alias("above")), F.struct(-F.col("seen"))).alias("cut"))
    whole = at.where(F.col("seen") < k).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"))
    edge = rows.join(F.broadcast(cut), F.col(score).eqNullSafe(F.col(f"cut.{score}")))  # one row
    ranked = running(edge.groupBy(tie, "cut.above").agg(F.count("*").alias("one"), F.sum(truth).alias("p")), [], tie, {"place": "one"})
    part = ranked.where(F.col("place") + F.col("above") <= k).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("q"))
    top = whole.crossJoin(part).select((F.col("p") + F.col("q")).alias("hits"))
    return top.select(F.lit(k).cast("long").alias("k"), (F.col("hits") / k).alias("precision"), (F.col("hits") / n["P"]).alias("recall"), (F.col("hits") / k / (n["P"] / n["n"])).alias("lift"))


def inverse_propensity(rows: DataFrame, observed: str, probability: str, floor: float, cap: float) -> DataFrame:
    """Stabilised weights prevalence / max(p, floor), capped: effective sample size, largest weight, clipped rows."""
    prevalence = rows.agg(F.avg(F.col(observed).cast("int")).alias("prevalence"))
    w = rows.crossJoin(prevalence).where(observed).withColumn("raw", F.col("prevalence") / F.greatest(F.col(probability), F.lit(floor))).withColumn("w", F.least("raw", F.lit(cap)))
    return w.agg((F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.max("w").alias("max_weight"), F.count_if(F.col("raw") > cap).alias("clipped"))
