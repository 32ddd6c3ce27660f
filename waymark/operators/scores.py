"""Model reports: oracles, improvement, scenarios, leakage, stability, ensembles, blends and class posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.exprs import hash_uniform
from waymark.operators.causal import fallback
from waymark.operators.ranks import counted, with_quantiles
from waymark.plans.scratch import materialize


def profile_oracle(train: DataFrame, test: DataFrame, levels: list[list[str]], truth: str, least: int) -> DataFrame:
    """Training means of the first supported profile level as predictions for test rows, scored per level."""
    out, found = test, []
    for i, keys in enumerate(levels):
        stat = train.groupBy(*keys).agg(F.avg(truth).alias(f"_m{i}"), F.count(truth).alias(f"_n{i}"))
        out = out.join(stat, keys, "left")
        found.append(("_".join(keys), F.col(f"_m{i}"), F.col(f"_n{i}")))
    v, level = fallback(found, least)
    e = F.col("_p") - F.col(truth)
    return out.withColumn("_p", v).withColumn("level", level).groupBy("level").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def improvement(rows: DataFrame, key: list[str], truth: str, baseline: str, candidate: str, least_gain: float) -> DataFrame:
    """Paired absolute errors of two models on the same rows, relative gain, and whether it suffices."""
    err = lambda p: F.sum(F.abs(F.col(p) - F.col(truth)))
    out = rows.where(F.col(truth).isNotNull() & F.col(baseline).isNotNull() & F.col(candidate).isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), err(baseline).alias("b"), err(candidate).alias("c"))
    gain = F.try_divide(F.col("b") - F.col("c"), F.col("b"))
    return out.select(*key, "n", gain.alias("gain"), F.coalesce(gain >= least_gain, F.lit(False)).alias("adopt"))


def error_by_support(rows: DataFrame, support: str, error: str, edges: list[float]) -> DataFrame:
    """n, MAE, median and P90 of absolute errors by support bucket."""
    from waymark.functions.exprs import right_closed_bucket

    long = rows.select(right_closed_bucket(F.col(support), edges).alias("bucket"), F.abs(F.col(error)).alias("_a"))
    return with_quantiles(long.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("_a").alias("mae")), long, ["bucket"], "_a", {"median": 0.5, "p90": 0.9})


def selection_effect(rows: DataFrame, stratum: str, chosen: Column, rank: str, most_ratio: float, least_gap: float) -> DataFrame:
    """Selection rate and mean rank per stratum against all rows; material where the rate is far lower."""
    one = lambda df, keys: df.groupBy(*keys).agg(F.avg(chosen.cast("int")).alias("rate"), F.avg(rank).alias("mean_rank"), F.count("*").alias("n"))
    total = one(rows, []).select(F.col("rate").alias("_all"))
    out = one(rows, [stratum]).crossJoin(F.broadcast(total))  # one row
    return out.withColumn("ratio", F.try_divide(F.col("rate"), F.col("_all"))).withColumn("material", (F.col("ratio") <= most_ratio) & (F.col("_all") - F.col("rate") >= least_gap)).drop("_all")


def quantile_scenarios(parts: DataFrame, route: str, part: str, p50: str, p90: str, length: str, scenarios: int, seed: str, shared: float, limit: float) -> DataFrame:
    """Route times under ``scenarios`` draws: mean, P50, P90, P95, mean beyond P90 (CVaR) and share above ``limit``.

    A draw is a route's own uniform number with weight ``shared`` and the part's with the rest; a part's pace is linear through
    (0, p50 / 2), (0.5, p50), (0.9, p90) and bounded at 1.5 x p90.
    """
    each = parts.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(scenarios))))
    u = shared * hash_uniform(seed, F.col(route), F.col("s")) + (1 - shared) * hash_uniform(seed, F.col(route), F.col("s"), F.col(part))
    a, b = F.col(p50), F.col(p90)
    pace = F.when(u < 0.5, a / 2 + u * a).when(u < 0.9, a + (u - 0.5) / 0.4 * (b - a)).otherwise(F.least(1.5 * b, b + (u - 0.9) / 0.1 * (b - a)))
    runs = each.groupBy(route, "s").agg(F.sum(pace * F.col(length)).alias("t"))
    q = runs.groupBy(route).agg(F.avg("t").alias("mean"), F.percentile("t", F.lit(0.5)).alias("p50"), F.percentile("t", F.lit(0.9)).alias("p90"), F.percentile("t", F.lit(0.95)).alias("p95"), F.avg((F.col("t") > limit).cast("int")).alias("timeout"))
    tail = runs.join(q.select(route, F.col("p90").alias("_q")), route).where(F.col("t") >= F.col("_q")).groupBy(route).agg(F.avg("t").alias("cvar"))
    return q.join(tail, route)


def leakage(rows: DataFrame, feature_time: str, cutoff: str, columns: list[str], forbidden: list[str]) -> DataFrame:
    """Rows with a feature at or after its cutoff, and forbidden columns among the features."""
    found = sorted(set(columns) & set(forbidden))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(feature_time) >= F.col(cutoff)).alias("late"), F.count_if(F.col(feature_time).isNull()).alias("untimed")).withColumn("forbidden", F.lit("|".join(found)))


def stability(rows: DataFrame, key: list[str], truth: str, prediction: str, thresholds: list[float]) -> DataFrame:
    """Counts above thresholds, crossings of a lower and an upper value, and the largest single row's share of MAE and RMSE."""
    e = F.abs(F.col(prediction) - F.col(truth))
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(prediction) > t).alias(f"above_{t:g}") for t in thresholds],
        F.count_if(F.col(prediction) < F.col(truth)).alias("crossed"), F.try_divide(F.max(e), F.sum(e)).alias("mae_share"), F.try_divide(F.max(e * e), F.sum(e * e)).alias("rmse_share"))


def label_review(rows: DataFrame, key: list[str], label: str, reason: str) -> DataFrame:
    """Rows, availability, mean, std, extremes, most frequent reason and the change of the mean from the key's previous value (E22). key: group, then time."""
    base = rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg(F.col(label).isNotNull().cast("int")).alias("available"), F.avg(label).alias("mean"), F.stddev_samp(label).alias("std"), F.min(label).alias("low"), F.max(label).alias("high"))
    modes = rows.where(F.col(reason).isNotNull()).groupBy(*key, reason).agg(F.count("*").alias("c")).groupBy(*key).agg(F.min(F.struct(-F.col("c"), reason)).alias("m")).select(*key, F.col(f"m.{reason}").alias("reason"))
    w = Window.partitionBy(*key[:-1]).orderBy(key[-1])
    return base.join(modes, key, "left").withColumn("drift", F.col("mean") - F.lag("mean").over(w))


def top_cells(shares: DataFrame, cell: str, share: str, fraction: float) -> DataFrame:
    """The ceil(fraction x n) cells of the largest share, ties by cell."""
    from waymark.operators.ranks import running

    each = shares.withColumn("_one", F.lit(1)).withColumn("_o", F.struct((-F.col(share)).alias("s"), F.col(cell).alias("c")))
    n = shares.agg(F.count("*").alias("_n"))
    return running(each, [], "_o", {"_i": "_one"}).crossJoin(n).where(F.col("_i") <= F.ceil(fraction * F.col("_n"))).select(*shares.columns)  # one row


def representativeness(left: DataFrame, right: DataFrame, cell: str) -> DataFrame:
    """Total variation, Spearman of shares over the union of cells, and Jaccard of the top tenths of two grids."""
    from waymark.operators.evaluate import distribution_distance, spearman

    def shares(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy(cell).agg(F.count("*").alias("n"))
        return counts.select(cell, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))  # a row per cell

    p, q = shares(left, "p"), shares(right, "q")
    both = p.join(q, cell, "full_outer").na.fill(0.0, ["p", "q"])
    a, b = top_cells(p, cell, "p", 0.1).select(cell, F.lit(1).alias("_a")), top_cells(q, cell, "q", 0.1).select(cell, F.lit(1).alias("_b"))
    top = a.join(b, cell, "full_outer").agg((F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count("*")).alias("top_jaccard"))
    return distribution_distance(left, right, cell).select("total_variation", "jensen_shannon").crossJoin(spearman(both, [], "p", "q")).crossJoin(top)  # one row each


def ensemble_band(calibration: DataFrame, rows: DataFrame, key: list[str], truth: str, prediction: str, floor: float, level: float) -> DataFrame:
    """Bands of ensemble mean +- q x (std + floor), q being the conformal quantile of scaled errors: q, coverage, mean width.

    Rows of one key are runs of the ensemble. The quantile is the ceil((n + 1) level)-th smallest scaled error.
    """
    def merged(df: DataFrame) -> DataFrame:
        return df.groupBy(*key).agg(F.avg(prediction).alias("m"), (F.coalesce(F.stddev_samp(prediction), F.lit(0.0)) + floor).alias("s"), F.max(truth).alias("y"))

    scaled = counted(merged(calibration).select((F.abs(F.col("y") - F.col("m")) / F.col("s")).alias("e")).where("e is not null"), [], "e")
    q = scaled.where(F.col("upto") >= F.least(F.col("total"), F.ceil(F.round((F.col("total") + 1) * level, 9)))).agg(F.min("e").alias("q"))
    low = F.greatest(F.col("m") - F.col("q") * F.col("s"), F.lit(0.0))
    high = F.col("m") + F.col("q") * F.col("s")
    return merged(rows).crossJoin(q).agg(F.max("q").alias("q"), F.avg(F.col("y").between(low, high).cast("int")).alias("coverage"), F.avg(high - low).alias("width"))


def blend(validation: DataFrame, test: DataFrame, truth: str, a: str, b: str, steps: int = 20) -> DataFrame:
    """The weight of ``a`` on a grid with the least validation MAE (the smaller on a tie), and the test MAE with it."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps))
    mae = F.avg(F.abs(F.col("alpha") * F.col(a) + (1 - F.col("alpha")) * F.col(b) - F.col(truth)))
    best = validation.withColumn("alpha", grid).groupBy("alpha").agg(mae.alias("m")).agg(F.min(F.struct(F.round("m", 9).alias("m"), "alpha")).alias("best")).select("best.alpha", F.col("best.m").alias("validation_mae"))
    return test.crossJoin(F.broadcast(best)).groupBy("alpha", "validation_mae").agg(mae.alias("test_mae"))  # one row


def monotonicity(rows: DataFrame, label: str, indicator: str) -> DataFrame:
    """Mean of an indicator per fixed decile of a label in [0, 1], and the correlation of both orders."""
    d = rows.where(F.col(label).isNotNull()).groupBy((F.least(F.floor(F.col(label) * 10), F.lit(9)) + 1).cast("long").alias("decile")).agg(F.count("*").alias("n"), F.avg(indicator).alias("mean"))
    rank = lambda c: F.rank().over(Window.orderBy(c))  # noqa: E731  (ten rows)
    return d.withColumn("_a", rank("decile")).withColumn("_b", rank("mean")).withColumn("rank_correlation", F.corr("_a", "_b").over(Window.partitionBy())).drop("_a", "_b")


def screening(rows: DataFrame, trip: str, truth: str, score: str, share: float) -> DataFrame:
    """Trips by mean score: precision, recall and lift of the top share at catching trips of above-average truth, and the truth they hold."""
    from waymark.operators.ranks import running

    t = rows.groupBy(trip).agg(F.avg(truth).alias("y"), F.avg(score).alias("s"))
    mean = t.agg(F.avg("y").alias("_m"), F.count("*").alias("_n"))
    t = t.crossJoin(F.broadcast(mean)).withColumn("hit", (F.col("y") > F.col("_m")).cast("int")).withColumn("_one", F.lit(1)).withColumn("_o", F.struct((-F.col("s")).alias("s"), F.col(trip).alias("k")))  # one row
    r = running(t, [], "_o", {"_i": "_one"}).withColumn("_top", F.col("_i") <= F.ceil(share * F.col("_n")))
    top = lambda c: F.sum(F.when(F.col("_top"), F.col(c)).otherwise(0))
    k = F.count_if("_top")
    return r.agg(k.alias("k"), (top("hit") / k).alias("precision"), F.try_divide(top("hit"), F.sum("hit")).alias("recall"), F.try_divide(top("hit") / k, F.avg("hit")).alias("lift"), F.try_divide(top("y"), F.sum("y")).alias("captured"))


def _log_ratio(speed: Column, limit: Column) -> Column:
    """Null for a speed that isn't a positive number."""
    return F.when((speed > 0) & ~F.isnan(speed), F.log(speed / limit))


def speed_posterior(train: DataFrame, rows: DataFrame, kind: str, speed: str, limit: str, grid: list[float], spread: float, key: str) -> DataFrame:
    """The limit on a grid of the largest posterior: log of (class count + 1), and a Gaussian of log(speed / limit) around the training mean (M4).

    A speed that isn't positive has no logarithm: it is left out of the mean, and its row is judged by the class counts alone.
    """
    prior = train.groupBy(kind, limit).agg(F.count("*").alias("_c"))
    ratio = train.agg(F.avg(_log_ratio(F.col(speed), F.col(limit))).alias("_mu"))
    each = rows.withColumn("candidate", F.explode(F.array(*map(F.lit, grid))))
    j = each.join(prior.withColumnRenamed(limit, "candidate"), [kind, "candidate"], "left").crossJoin(F.broadcast(ratio))  # one row
    score = F.log(F.coalesce("_c", F.lit(0)) + 1.0) - F.coalesce(F.pow(_log_ratio(F.col(speed), F.col("candidate")) - F.col("_mu"), 2) / (2 * spread * spread), F.lit(0.0))
    return j.withColumn("_s", F.round(score, 9)).groupBy(key).agg(F.min(F.struct(-F.col("_s"), "candidate")).alias("b")).select(key, F.col("b.candidate").alias("limit"))


def speed_folds(rows: DataFrame, kind: str, speed: str, limit: str, group: str, grid: list[float], spread: float, key: str, folds: int, seed: str) -> DataFrame:
    """``speed_posterior`` held against known limits, each row by the training of the folds without its group: per fold and over all (null), n and accuracies (M4).

    Class counts and the mean log ratio of all folds are one aggregate; a fold's training is the whole less the fold's own, so the rows are
    read twice whatever the number of folds, and none is trained apart. ``compatible``: share of agreement on both sides of 60, 80 and 120.
    """
    from waymark.functions.exprs import hash_modulo

    ratio = _log_ratio(F.col(speed), F.col(limit))
    each = materialize(rows.withColumn("fold", hash_modulo(seed, F.col(group), folds).cast("int")), "folds")
    part = each.groupBy("fold", kind, limit).agg(F.count("*").alias("c"), F.sum(ratio).alias("s"), F.count(ratio).alias("n"))
    part = materialize(part, "counts")
    whole = part.groupBy(kind, limit).agg(F.sum("c").alias("all"))
    names = part.select("fold").distinct()
    own = part.select("fold", kind, limit, "c")
    without = (names.crossJoin(whole)  # folds x classes x limits, the size of the fitted table
               .join(own, ["fold", kind, limit], "left").select("fold", kind, F.col(limit).alias("candidate"), (F.col("all") - F.coalesce("c", F.lit(0))).alias("_c")))
    sums = part.agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    means = part.groupBy("fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).crossJoin(sums)  # one row
    means = means.select("fold", F.try_divide(F.col("_s") - F.col("s"), F.col("_n") - F.col("n")).alias("_mu"))
    j = each.withColumn("candidate", F.explode(F.array(*map(F.lit, grid)))).join(without, ["fold", kind, "candidate"], "left").join(means, "fold", "left")
    score = F.log(F.coalesce("_c", F.lit(0)) + 1.0) - F.coalesce(F.pow(_log_ratio(F.col(speed), F.col("candidate")) - F.col("_mu"), 2) / (2 * spread * spread), F.lit(0.0))
    best = j.withColumn("_s", F.round(score, 9)).groupBy(key, "fold", limit).agg(F.min_by("candidate", F.struct(-F.col("_s"), "candidate")).alias("found"))
    t, f = F.col(limit), F.col("found")
    agree = sum(((t <= cap) == (f <= cap)).cast("double") for cap in (60, 80, 120)) / 3
    return best.groupingSets([[F.col("fold")], []], "fold").agg(
        F.count("*").alias("n"), F.avg((t == f).cast("double")).alias("exact"), F.avg((F.abs(t - f) <= 10).cast("double")).alias("within_10"),
        F.avg(agree).alias("compatible"), F.avg(F.abs(t - f)).alias("mae")).select("fold", "n", "exact", "within_10", "compatible", "mae")


def moments(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """n, mean, std, quartiles and extremes per key, the quartiles from counts by distinct value."""
    known = rows.where(F.col(value).isNotNull())
    at = counted(known, key, value)
    place = lambda q: F.round(q * (F.col("total") - 1), 9)
    pick = lambda i: F.min(F.when(F.col("upto") > i, F.col(value)))

    def quantile(q: float) -> Column:
        low, part = pick(F.floor(place(q))), F.max(place(q) - F.floor(place(q)))
        return low + part * (pick(F.ceil(place(q))) - low)

    quartiles = at.groupBy(*key).agg(quantile(0.25).alias("q25"), quantile(0.75).alias("q75"))
    return known.groupBy(*key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high")).join(quartiles, key)
