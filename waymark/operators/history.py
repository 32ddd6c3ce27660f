"""Support, caps, references and estimates from earlier trips, with fallback levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.exprs import micros
from waymark.operators.causal import fallback, window_history
from waymark.operators.ranks import at_places, counted, running, same, with_quantiles


def session_gap(gaps: DataFrame, gap: str, usual: float, longer: float) -> DataFrame:
    """One row: ``longer`` if the 90th percentile of the gaps exceeds ``usual``, else ``usual``."""
    q = gaps.agg(F.percentile_approx(gap, F.lit(0.9), F.lit(1_000_000)).alias("p90"))
    return q.select("p90", F.when(F.col("p90") > usual, longer).otherwise(usual).alias("gap_limit"))


def trailing_means(rows: DataFrame, key: list[str], ts: str, value: str, minutes: list[int]) -> DataFrame:
    """Per row and window: sum and count of the key's earlier values in [t - w, t), and their mean.

    Time is cut into sixtieths of a window. A window is then the end of one of them, 59 whole ones and the beginning of another, and each end and
    beginning is a running sum within its sixtieth: rows are added up once each way, whatever a window holds, and never subtracted, so that NaN
    and infinite values stay in their windows. Whole sixtieths are one row each. A row without a time has no earlier values.
    """
    each = rows.withColumn("_t", micros(F.col(ts)))
    at = each.where("_t is not null").groupBy(*key, "_t").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    found = None
    for m in minutes:
        width, size = m * 60_000_000, m * 1_000_000
        begin = lambda c: c - F.pmod(c, F.lit(size))  # noqa: B023, E731
        none = lambda *names: [F.lit(None).cast("double" if n in ("_s", "_ms") else "long").alias(n) for n in names]
        here = at.select(*key, begin(F.col("_t")).alias("_b"), F.col("_t").alias("_at"), "_t", F.lit(True).alias("_here"), "_s", "_n", *none("_ms", "_mn"))
        ago = at.select(*key, begin(F.col("_t") - width).alias("_b"), (F.col("_t") - width).alias("_at"), "_t", F.lit(False).alias("_here"), *none("_s", "_n", "_ms", "_mn"))
        w = Window.partitionBy(*key).orderBy("_b").rangeBetween(size - width, -size)
        whole = at.groupBy(*key, begin(F.col("_t")).alias("_b")).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))  # bounded by the span of time, not by rows
        whole = whole.select(*key, "_b", F.col("_b").alias("_at"), *none("_t"), F.lit(None).cast("boolean").alias("_here"), *none("_s", "_n"), F.sum("_s").over(w).alias("_ms"), F.sum("_n").over(w).alias("_mn"))
        part = Window.partitionBy(*key, "_b")
        before = part.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
        since = part.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
        sums = here.unionByName(ago).unionByName(whole).select(*key, "_t", *[
            x for c in "sn" for x in (F.sum(f"_{c}").over(before).alias(f"_h{c}"), F.sum(f"_{c}").over(since).alias(f"_a{c}"), F.sum(f"_m{c}").over(part).alias(f"_m{c}"))], "_here").where("_t is not null")
        zero = lambda c: F.coalesce(c, F.lit(0))
        sums = sums.select(*key, "_t", *[F.when(F.col("_here"), zero(F.col(f"_m{c}")) + zero(F.col(f"_h{c}"))).otherwise(zero(F.col(f"_a{c}"))).alias(f"{name}_{m}") for c, name in (("s", "sum"), ("n", "n"))])
        found = sums if found is None else found.unionByName(sums, allowMissingColumns=True)
    names = [f"{n}_{m}" for m in minutes for n in ("sum", "n")]
    found = found.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)], F.col("_t").alias("_at")).agg(*[F.sum(c).alias(c) for c in names])
    alike = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(key)]
    out = each.join(found, reduce(lambda a, b: a & b, alike, F.col("_t") == F.col("_at")), "left")
    out = out.select(*rows.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    for m in minutes:
        out = out.withColumn(f"mean_{m}", F.try_divide(F.col(f"sum_{m}"), F.col(f"n_{m}")))
    return out


def entry_times(tokens: DataFrame, pace: DataFrame, trip: str, sequence: str, start: str, length: str, link: str, width_s: int, overall: float, spread: str | None = None,
                support: str | None = None) -> DataFrame:
    """Estimated entry time of each token in two rounds (W6): offsets from the pace at departure, then from the pace at the first estimate.

    ``pace``: (link, slot, pace), slot being an epoch time over ``width_s``. A link without pace in a slot takes ``overall``.
    ``spread`` and ``support`` name pace's standard deviation and count: the second round then adds up ``entry_variance`` over the
    tokens before. A link without pace has half its travel time as deviation, one of a single observation a quarter at least.
    """
    w = Window.partitionBy(trip).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    looked = [F.col("pace").alias("_p"), *([F.col(spread).alias("_sd"), F.col(support).alias("_n")] if spread else [])]
    at, out = F.col(start), tokens
    for turn in (1, 2):
        out = out.withColumn("slot", F.floor(at / width_s).cast("long")).join(pace.select(link, "slot", *looked), [link, "slot"], "left")
        out = out.withColumn("_used", F.coalesce("_p", F.lit(overall))).withColumn(f"entry_{turn}", F.col(start) + F.coalesce(F.sum(F.col(length) * F.col("_used")).over(w), F.lit(0.0)))
        if spread and turn == 2:
            time = F.col(length) * F.col("_used")
            sd = F.coalesce(F.col(length) * F.greatest(F.col("_sd"), F.lit(0.0)), F.lit(0.0))
            sd = F.when(F.col("_p").isNull(), 0.5 * time).when(F.col("_n") <= 1, F.greatest(sd, 0.25 * time)).otherwise(sd)
            out = out.withColumn("entry_variance", F.coalesce(F.sum(sd * sd).over(w), F.lit(0.0)))
        out = out.drop("_p", "_sd", "_n", "slot")
        at = F.col(f"entry_{turn}")
    return out.withColumnRenamed("_used", "pace")


def deciles(rows: DataFrame, value: str, tie: str, groups: int = 10) -> DataFrame:
    """``decile`` 1.. by value with ties broken by ``tie``, in equal groups."""
    each = rows.withColumn("_one", F.lit(1)).withColumn("_o", F.struct(value, tie))
    n = rows.agg(F.count("*").alias("_n"))
    r = running(each, [], "_o", {"_i": "_one"}).crossJoin(n)  # one row
    # as NTILE deals them: the first n % groups get one more
    big, extra = F.floor(F.col("_n") / groups) + 1, F.col("_n") % groups
    edge = extra * big
    return r.withColumn("decile", F.when(F.col("_i") <= edge, F.floor((F.col("_i") - 1) / big) + 1).otherwise(
        extra + F.floor((F.col("_i") - edge - 1) / F.greatest(big - 1, F.lit(1))) + 1).cast("long")).drop("_one", "_o", "_i", "_n")


def selection_rank(rows: DataFrame, day: list[str], draw: Column, tie: str) -> DataFrame:
    """(i + 0.5) / n by hash and id within the day, over ranges of the order."""
    each = rows.withColumns({"_one": F.lit(1), "_o": F.struct(draw.alias("h"), tie)})
    ranked = running(each, day, "_o", {"_i": "_one"})
    n = rows.groupBy(*day).agg(F.count("*").alias("_n"))
    return ranked.join(n, same(ranked, n, day)).select(*[ranked[c] for c in rows.columns], ((F.col("_i") - 0.5) / F.col("_n")).alias("selection_rank"))


def caps(rows: DataFrame, dims: list[str], anchors: list[float]) -> DataFrame:
    """Per dimension and anchor the quantile by method higher, as a cap."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("x")) for d in dims])).alias("e")).select("e.*").where("x is not null")
    at = counted(long, ["dim"], "x")
    each = at.withColumn("anchor", F.explode(F.array(*map(F.lit, anchors))))
    return each.groupBy("dim", "anchor").agg(F.min(F.when(F.col("upto") > F.ceil(F.round(F.col("anchor") * (F.col("total") - 1), 9)), F.col("x"))).alias("cap"))


def support_levels(train: DataFrame, rows: DataFrame, edge: str, kind: str, nodes: list[str], hour: str, least_edge: int, least: int) -> DataFrame:
    """Counts at edge-hour, class-hour, either end's node-hour and hour, and the first level with enough of them."""
    count = lambda keys, name: train.groupBy(*keys).agg(F.count("*").alias(name))
    ends = train.select(edge, hour, F.explode(F.array(*nodes)).alias("_node")).groupBy("_node", hour).agg(F.count("*").alias("_c"))
    out = rows.join(count([edge, hour], "edge_hour"), [edge, hour], "left").join(count([kind, hour], "kind_hour"), [kind, hour], "left")
    for i, n in enumerate(nodes):
        out = out.join(ends.select(F.col("_node").alias(n), hour, F.col("_c").alias(f"_n{i}")), [n, hour], "left")
    out = out.join(count([hour], "all_hour"), [hour], "left").na.fill(0, ["edge_hour", "kind_hour", "all_hour", *[f"_n{i}" for i in range(len(nodes))]])
    out = out.withColumn("neighbour_hour", F.greatest(*[F.col(f"_n{i}") for i in range(len(nodes))]) if len(nodes) > 1 else F.col("_n0"))
    level = (F.when(F.col("edge_hour") >= least_edge, "edge_hour").when(F.col("kind_hour") >= least, "kind_hour").when(F.col("neighbour_hour") >= least, "neighbour")
             .when(F.col("all_hour") >= least, "all_hour").otherwise("unavailable"))
    return out.withColumn("level", level).drop(*[f"_n{i}" for i in range(len(nodes))])


def reference_pace(rows: DataFrame, key: list[str], value: str, day: str) -> DataFrame:
    """20 % quantile, median, count and distinct days per key."""
    return with_quantiles(rows.groupBy(*key).agg(F.count(value).alias("n"), F.count_distinct(day).alias("days")), rows, key, value, {"q20": 0.2, "median": 0.5})


def frozen_threshold(hist: DataFrame, key: list[str], share: float, low: float, width: float) -> DataFrame:
    """Centre of the bin in which the cumulative count reaches ``share``."""
    w = Window.partitionBy(*key)
    run = hist.withColumn("_u", F.sum("n").over(w.orderBy("bin"))).withColumn("_t", F.sum("n").over(w))
    return run.where(F.col("_u") >= share * F.col("_t")).groupBy(*key).agg((low + (F.min("bin") + 0.5) * width).alias("threshold"))


def median_levels(train: DataFrame, rows: DataFrame, levels: list[list[str]], value: str, least: int) -> DataFrame:
    """Median at the first level of keys with ``least`` training rows, and that level."""
    out, found = rows, []
    for i, keys in enumerate(levels):
        stat = with_quantiles(train.groupBy(*keys).agg(F.count(value).alias(f"_n{i}")), train, keys, value, {f"_m{i}": 0.5})
        out = out.join(stat, keys, "left") if keys else out.crossJoin(F.broadcast(stat))  # one row
        found.append(("_".join(keys) or "global", F.col(f"_m{i}"), F.col(f"_n{i}")))
    v, level = fallback(found[:-1], least) if not levels[-1] else fallback(found, least)
    if not levels[-1]:
        v, level = F.coalesce(v, found[-1][1]), F.coalesce(level, F.lit("global"))
    return out.withColumn("estimate", v).withColumn("level", level).drop(*[f"_{c}{i}" for i in range(len(levels)) for c in "mn"])


def history_with_fallback(events: DataFrame, queries: DataFrame, levels: list[str], ts: str, value: str, qid: str, least: int) -> DataFrame:
    """All-past mean, count and level: the first level of key with ``least`` events before the query."""
    out, found = queries.select(qid), []
    for i, key in enumerate(levels):
        h = window_history(events, queries, key, ts, value, qid, None).select(qid, F.col("mean").alias(f"_m{i}"), F.col("n").alias(f"_n{i}"))
        out = out.join(h, qid)
        found.append((key, F.col(f"_m{i}"), F.col(f"_n{i}")))
    v, level = fallback(found, least)
    n, _ = fallback([(k, c, c) for k, _, c in found], least)
    return out.select(qid, v.alias("mean"), n.alias("n"), level.alias("level"))


def leave_one_out_quantile(rows: DataFrame, key: list[str], value: str, q: float, low: float, high: float, bins: int, least: int) -> DataFrame:
    """Histogram quantile of the row's cohort without the row, null below ``least`` other rows.

    Every (cohort, bin) needs one quantile only, as equal bins leave the same rest.
    """
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("long")
    binned = rows.where(F.col(value).between(low, high)).withColumn("bin", b)
    hist = binned.groupBy(*key, "bin").agg(F.count("*").alias("n"))
    own = hist.select(*key, F.col("bin").alias("own"))
    rest = hist.join(own, key).withColumn("n", F.col("n") - (F.col("bin") == F.col("own")).cast("int")).where("n > 0")
    w = Window.partitionBy(*key, "own")
    run = rest.withColumn("_u", F.sum("n").over(w.orderBy("bin"))).withColumn("_t", F.sum("n").over(w))
    run = run.withColumn("_g", q * (F.col("_t") - 1)).where((F.col("_u") > F.col("_g")) & (F.col("_t") >= least))
    first = run.groupBy(*key, "own").agg(F.min(F.struct("bin", "n", "_u", "_g")).alias("f"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("f._g") - (F.col("f._u") - F.col("f.n")) + 0.5) / F.col("f.n")))
    quantile = first.select(*[F.col(k).alias(f"_{k}") for k in key], "own", (low + (F.col("f.bin") + part) * width).alias("reference"))
    match = F.col("bin") == F.col("own")
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return binned.join(quantile, match, "left").select(*rows.columns, "reference")


def remaining_time(ratios: DataFrame, jobs: DataFrame, ratio: str, key: str, predicted: str, elapsed: str) -> DataFrame:
    """Predicted time x median of the training ratios above elapsed / predicted, less elapsed; null beyond them (M5).

    Ratios above a limit are a tail of the sorted ratios, so its median is one place; jobs are joined to places, not to ratios.
    """
    at = counted(ratios.select(F.col(ratio).alias("r")), [], "r")
    both = at.select("r", "n", "total", F.lit(None).cast("long").alias(key), F.lit(0).alias("_q")).unionByName(
        jobs.select((F.col(elapsed) / F.col(predicted)).alias("r"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("total"), F.col(key), F.lit(1).alias("_q")))
    run = running(both.groupBy("r", key, "_q").agg(F.sum("n").alias("n")), [], "r", {"upto": "n"})
    total = ratios.where(F.col(ratio).isNotNull()).agg(F.count("*").alias("_t"))
    first = run.where("_q = 1").crossJoin(total).withColumn("support", F.col("_t") - F.col("upto"))  # one row
    place = F.col("upto") + (F.col("support") - 1) / 2
    first = first.select(key, "support", F.floor(place).alias("lo"), F.ceil(place).alias("hi"))
    spots = at_places(at, "r", first.where("support > 0").select(F.explode(F.array("lo", "hi")).alias("spot")), "spot")
    out = jobs.join(first, key).join(spots.select(F.col("r").alias("_lo"), F.col("spot").alias("lo")), "lo", "left").join(spots.select(F.col("r").alias("_hi"), F.col("spot").alias("hi")), "hi", "left")
    return out.select(key, F.when(F.col("support") > 0, F.col(predicted) * (F.col("_lo") + F.col("_hi")) / 2 - F.col(elapsed)).alias("remaining"), "support")
