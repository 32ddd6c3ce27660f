"""Multi-level tables, contrasts and audits for scenario and label reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.ranks import at_places, linear_quantiles, running, with_quantiles


def traffic_state(pace_ratio: Column, slow_share: Column, support: Column, least: int) -> Column:
    """UNKNOWN without support, else SEVERE, CONGESTED, NON or MIXED by pace ratio and share of slow time."""
    return (F.when(support.isNull() | (support < least) | pace_ratio.isNull() | slow_share.isNull(), "UNKNOWN")
            .when((pace_ratio >= 2.0) & (slow_share >= 0.5), "SEVERE").when((pace_ratio >= 1.3) & (slow_share >= 0.3), "CONGESTED")
            .when((pace_ratio < 1.3) & (slow_share < 0.3), "NON").otherwise("MIXED"))


def residual_quantiles(rows: DataFrame, levels: list[list[str]], residual: str, q: float) -> DataFrame:
    """Quantile and count of residuals at each level, all levels in one pass; absent keys are null."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    absent = lambda level: sum(1 << len(keys) - 1 - i for i, k in enumerate(keys) if k not in level)
    types = dict(rows.select(*keys).dtypes)
    each = F.explode(F.array(*[F.struct(F.lit(absent(level)).cast("long").alias("gid"), *[(F.col(k) if k in level else F.lit(None).cast(types[k])).alias(k) for k in keys]) for level in levels]))
    long = rows.select(F.col(residual).alias("_r"), each.alias("_l")).select("_r", "_l.*")
    return with_quantiles(long.groupBy("gid", *keys).agg(F.count("_r").alias("n")), long, ["gid", *keys], "_r", {"q": q}).select(*keys, "gid", "q", "n")


def support_groups(rows: DataFrame, support: str) -> DataFrame:
    """``support_group``: unseen, low, medium or high by the quartiles of positive support."""
    edge = linear_quantiles(rows.where(F.col(support) > 0), [], support, {"_q25": 0.25, "_q75": 0.75})
    x = F.col(support)
    group = F.when(F.coalesce(x, F.lit(0)) <= 0, "unseen").when(x <= F.col("_q25"), "low").when(x <= F.col("_q75"), "medium").otherwise("high")
    return rows.crossJoin(edge).withColumn("support_group", group).drop("_q25", "_q75")  # one row


def conservation(parts: DataFrame, totals: DataFrame, key: list[str], part: str, total: str, tolerance: float) -> DataFrame:
    """Keys, violations and the largest absolute difference of part sums from totals."""
    sums = parts.groupBy(*key).agg(F.sum(part).alias("_p"))
    d = F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce(total, F.lit(0.0)))
    return sums.join(totals, key, "full_outer").agg(F.count("*").alias("keys"), F.count_if(d > tolerance).alias("violations"), F.max(d).alias("largest"))


def duration_audit(rows: DataFrame, pairs: dict[str, tuple[Column, Column]], over_s: float) -> DataFrame:
    """Per named pair of epoch seconds: n, negative, zero, over the bound, median."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (b - a).cast("double").alias("d")) for n, (a, b) in pairs.items()]))
    long = rows.select(each.alias("x")).select("x.*").where("d is not null")
    stats = long.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("d") < 0).alias("negative"), F.count_if(F.col("d") == 0).alias("zero"), F.count_if(F.col("d") > over_s).alias("over"))
    return with_quantiles(stats, long, ["name"], "d", {"median": 0.5})


def against_baseline(rows: DataFrame, scenario: str, baseline: str, values: list[str]) -> DataFrame:
    """Each scenario's values and relative changes against the baseline scenario's single row."""
    base = rows.where(F.col(scenario) == baseline).select(*[F.col(v).alias(f"_{v}") for v in values])
    out = rows.crossJoin(base)  # one row
    return out.select(scenario, *values, *[(F.try_divide(F.col(v), F.col(f"_{v}")) - 1).alias(f"{v}_change") for v in values])


def waterfall(rows: DataFrame, key: str, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """Keys left after each successive join, and the loss at each."""
    out = rows.select(key).distinct()
    kept = F.lit(True)
    counts = [F.count("*").alias("start")]
    for name, other in steps:
        out = out.join(other.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
        kept = kept & F.col(f"_{name}").isNotNull()
        counts.append(F.count_if(kept).alias(name))
    return out.agg(*counts)


def failure_decomposition(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Per condition: failures, failures as the only cause, joint failures; and rows that pass all."""
    failed = {n: F.coalesce((~c).cast("int"), F.lit(1)) for n, c in conditions.items()}
    marked = rows.select(*[f.alias(n) for n, f in failed.items()]).withColumn("_n", sum((F.col(n) for n in failed), F.lit(0)))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(n).alias("f")) for n in failed]))
    return marked.select("_n", each.alias("x")).groupBy("x.condition").agg(
        F.sum("x.f").alias("failures"), F.count_if((F.col("x.f") == 1) & (F.col("_n") == 1)).alias("only_cause"),
        F.count_if((F.col("x.f") == 1) & (F.col("_n") > 1)).alias("joint"), F.count_if(F.col("_n") == 0).alias("pass_all"))


def two_part(rows: DataFrame, key: list[str], truth: str, prediction: str) -> DataFrame:
    """Zero-inflated errors: share of positives, error on positives, expected-value error and that of predicting zero."""
    t, p = F.col(truth), F.col(prediction)
    return rows.groupBy(*key).agg(F.avg((t > 0).cast("int")).alias("positive_share"), F.avg(F.when(t > 0, F.abs(p - t))).alias("positive_mae"),
                                  F.avg(F.abs(p - t)).alias("mae"), F.avg(F.abs(t)).alias("zero_mae"))


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, repeats: int, seed: str, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval over resampled clusters.

    Clusters are summed first; each then meets every repeat with a Poisson(1) count drawn from a hash, which
    is the large-sample form of drawing clusters with replacement and needs no second pass.
    """
    from waymark.functions.exprs import hash_uniform

    sums = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    each = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    u = hash_uniform(seed, F.col("rep"), F.col(cluster))
    times, p, c = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 10):
        times = times + F.when(u >= c, 1).otherwise(0)
        p = p / k
        c += p
    means = each.withColumn("t", times).groupBy("rep").agg(F.try_divide(F.sum(F.col("t") * F.col("s")), F.sum(F.col("t") * F.col("n"))).alias("m"))
    ends = means.agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    mean = sums.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return mean.crossJoin(ends).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # one row each


def crps(samples: DataFrame, key: list[str], sample: str, truth: str) -> DataFrame:
    """Sample CRPS per key by the sorted form: E|X - y| - E|X - X'| / 2, and coverage of the 5-95 % range."""
    w = Window.partitionBy(*key)
    r = samples.withColumn("_i", F.row_number().over(w.orderBy(sample))).withColumn("_n", F.count("*").over(w))
    spread = F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col(sample)) / F.max(F.col("_n") * F.col("_n"))
    return r.groupBy(*key).agg((F.avg(F.abs(F.col(sample) - F.col(truth))) - spread).alias("crps"),
                               F.max(truth).between(F.percentile(sample, F.lit(0.05)), F.percentile(sample, F.lit(0.95))).alias("covered"))


def quantile_map(rows: DataFrame, reference: DataFrame, key: str, value: str, target: str) -> DataFrame:
    """Each value's percent rank (0..1) read off the reference sample with linear interpolation.

    Ranks are dense row numbers by value and key; reference values are looked up by range, so a value that many rows share stays one row.
    """
    n = rows.agg(F.count("*").alias("_n"))
    m = reference.agg(F.count("*").alias("_m"))
    ref = running(reference.select(F.col(target).alias("r")).groupBy("r").agg(F.count("*").alias("n")), [], "r", {"upto": "n"})
    each = rows.withColumn("_one", F.lit(1)).withColumn("_o", F.struct(value, key))
    x = running(each, [], "_o", {"_i": "_one"}).withColumn("_i", F.col("_i") - 1).crossJoin(n).crossJoin(m)  # one row each
    at = F.try_divide(F.col("_i"), F.col("_n") - 1) * (F.col("_m") - 1)
    x = x.withColumn("_at", F.coalesce(at, F.lit(0.0))).withColumn("_lo", F.floor("_at")).withColumn("_hi", F.ceil("_at"))
    places = at_places(ref, "r", x.where("_m > 0").select(F.explode(F.array("_lo", "_hi")).alias("j")), "j")
    lo, hi = places.select(F.col("j").alias("_lo"), F.col("r").alias("_a")), places.select(F.col("j").alias("_hi"), F.col("r").alias("_b"))
    return x.join(lo, "_lo").join(hi, "_hi").select(key, value, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_lo"))).alias("mapped"))


def did(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Cell means of a two-by-two design and the difference of differences."""
    m = rows.groupBy(a, b).agg(F.avg(value).alias("m"))
    cell = lambda i, j: F.max(F.when((F.col(a) == i) & (F.col(b) == j), F.col("m")))
    return m.agg(*[cell(i, j).alias(f"m{i}{j}") for i in (0, 1) for j in (0, 1)]).withColumn("did", (F.col("m11") - F.col("m10")) - (F.col("m01") - F.col("m00")))


def factorial_cells(rows: DataFrame, factors: list[str], value: str) -> DataFrame:
    """Mean and count per combination of levels and, by grouping sets in the same pass, per level of each factor over all others.

    ``factor`` is null for whole combinations, else names the one whose level the marginal mean is for; the other factors are null there.
    """
    sets = [[F.col(f) for f in factors], *[[F.col(f)] for f in factors]]
    out = rows.groupingSets(sets, *[F.col(f) for f in factors]).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("_g"))
    full = (1 << len(factors)) - 1
    which = F.lit(None).cast("string")
    for i, f in enumerate(factors):
        which = F.when(F.col("_g") == full - (1 << len(factors) - 1 - i), f).otherwise(which)
    return out.select(*factors, F.when(F.col("_g") != 0, which).alias("factor"), "mean", "n")


def factorial_changes(rows: DataFrame, factors: list[str], value: str) -> DataFrame:
    """Per factor and combination of the others: the number of levels, changes from the lowest to the highest, rises and falls between neighbours, and a class.

    ``shape``: increasing, decreasing, flat, mixed, or single for one level. ``context``: the other factors' levels, as name=level.
    """
    cells = factorial_cells(rows, factors, value).where("factor is null")
    out = None
    for f in factors:
        others = [o for o in factors if o != f]
        context = F.concat_ws(",", *[F.concat(F.lit(f"{o}="), F.coalesce(F.col(o).cast("string"), F.lit("null"))) for o in others]) if others else F.lit("")
        w = Window.partitionBy(*others).orderBy(f)  # a row per level
        step = cells.withColumn("_step", F.col("mean") - F.lag("mean").over(w))
        one = step.groupBy(context.alias("context")).agg(
            F.count("*").alias("levels"), (F.max_by("mean", f) - F.min_by("mean", f)).alias("total_change"), F.max("_step").alias("largest_step"),
            F.count_if(F.col("_step") > 0).alias("rises"), F.count_if(F.col("_step") < 0).alias("falls")).withColumn("factor", F.lit(f))
        out = one if out is None else out.unionByName(one)
    shape = (F.when(F.col("levels") == 1, "single").when((F.col("rises") > 0) & (F.col("falls") > 0), "mixed").when(F.col("rises") > 0, "increasing").when(F.col("falls") > 0, "decreasing").otherwise("flat"))
    return out.withColumn("shape", shape).select("factor", "context", "levels", "total_change", "largest_step", "rises", "falls", "shape")


def sequence_overlap(a: Column, b: Column, most: int = 200_000) -> Column:
    """Longest common subsequence length over b's length, null if one is empty or the product of lengths exceeds ``most``.

    One dynamic-programming row is carried through an aggregate, so it stays in the JVM; its running maximum is taken by doubling
    steps, as many as b's length has binary digits.
    """
    from waymark.functions.exprs import let

    first = F.array_repeat(F.lit(0), F.size(b) + 1)

    def widest(row: Column, reach: int) -> Column:
        """Each place the largest of the last 2 ``reach`` ones, given that it is so over ``reach``."""
        wider = lambda r: F.transform(r, lambda x, j: F.when(j >= reach, F.greatest(x, F.get(r, j - reach))).otherwise(x))
        return let(row, lambda r: F.when(F.size(r) > reach, wider(r)).otherwise(r))

    def step(row: Column, x: Column) -> Column:
        """The best end at a column is the diagonal's plus a match, or the one above; then the running maximum."""
        best = F.transform(row, lambda up, j: F.when((j > 0) & (F.get(b, j - 1) == x), F.greatest(up, F.get(row, j - 1) + 1)).otherwise(up))
        reach = 1
        while reach <= most:
            best = widest(best, reach)
            reach *= 2
        return best

    length = F.element_at(F.aggregate(a, first, step), -1)
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (F.size(a).cast("long") * F.size(b) <= most), length / F.size(b))
