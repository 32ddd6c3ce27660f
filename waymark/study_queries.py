"""Queries of interpolated distributions, chained streams, clusters, spheres, resampling, folds and frozen encodings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import exprs as X
from waymark.operators import context, evaluate, history, joins, labels, ml, quantiles, reports, resample, scores, sequence, spatial, traces
from waymark.operators.sequence import positions
from waymark.plans.scratch import new_path
from waymark.queries import event_stream, events, query, r6, show, table
from waymark.streaming import windows

_LEVELS = [("type_hour", "event_type || ':' || hour(ts)"), ("type", "event_type"), ("all", "'all'")]
_CDF_BIN = "case when value < 5 then -1 when value > 125 then 40 else least(floor((value - 5) / 3.0), 39) end"
_CDF = " union all ".join(f"select '{name}' as level, {i} as rank, {key} as k, {_CDF_BIN} as bin, count(*) n from events where day(ts) <= 8 group by all" for i, (name, key) in enumerate(_LEVELS))


@query("a12_interpolated_cdf", f"""with h0 as ({_CDF}), h as (select *, (sum(n) over (partition by level, k order by bin) - n / 2) / sum(n) over (partition by level, k) cdf, sum(n) over (partition by level, k) support from h0 where bin between 0 and 39),
    q as (select event_id, value, {_CDF_BIN} as bin, {", ".join(f"{key} k{i}" for i, (_, key) in enumerate(_LEVELS))} from events),
    c as (select q.event_id, arg_min({{'level': h.level, 'k': h.k, 'support': h.support}}, h.rank) pick from q join h on h.support >= 16 and ({" or ".join(f"(h.rank = {i} and h.k = q.k{i})" for i in range(3))}) group by 1),
    a as (select q.event_id, q.value, q.bin, c.pick, max(case when h.bin <= q.bin then h.bin end) lo, min(case when h.bin >= q.bin then h.bin end) hi from q join c using (event_id) left join h on h.level = c.pick.level and h.k = c.pick.k group by all)
    select event_id, round(case when lo is null then 0 when hi is null then 1 when lo = hi then l.cdf else l.cdf + (value - (5 + (lo + 0.5) * 3.0)) / ((hi - lo) * 3.0) * (u.cdf - l.cdf) end, 8) cdf, pick.level as level, cast(pick.support as bigint) support
    from a left join h l on l.level = pick.level and l.k = pick.k and l.bin = lo left join h u on u.level = pick.level and u.k = pick.k and u.bin = hi""")
def _(spark, sf):
    e = events(spark, sf)
    levels = {"type_hour": F.concat_ws(":", "event_type", F.hour("ts").cast("string")), "type": F.col("event_type"), "all": F.lit("all")}
    out = quantiles.interpolated_cdf(e.where(F.day("ts") <= 8), e, levels, "value", 5.0, 125.0, 40, 16)
    return out.select("event_id", "level", "support", F.round("cdf", 8).alias("cdf"))


@query("r1_two_stage_means", """with a as (select user_id, event_type, time_bucket(interval 30 minute, ts) w, avg(value) m, count(*) n from events group by all)
    select event_type, epoch_us(w) // 1000000 window_start, round(avg(m), 6) mean, count(*) trips, cast(sum(n) as bigint) n from a where w + interval 30 minute <= (select max(ts) from events) - interval 1 hour group by all""")
def _(spark, sf):
    """Both means in one stream: the cells of the batch query that the watermark has closed."""
    cells = windows.run_to_files(windows.two_stage_means(event_stream(spark, sf), "ts", "user_id", ["event_type"], "value", late="1 hour"), "two-stage")
    return cells.select("event_type", F.unix_seconds("window_start").alias("window_start"), r6("mean").alias("mean"), "trips", "n")


@query("r2_counted_exclusions", """with e as (select cast(ts as date) = cast(ts + to_microseconds(cast(floor(value * 60 * 1000000) as bigint)) as date) same from events)
    select count(*) as read, count(*) filter (same) kept, count(*) filter (not same) cross_day, count(*) filter (same is null) no_time, count(*) filter (same) written from e""")
def _(spark, sf):
    ends = F.timestamp_micros(X.micros(F.col("ts")) + F.floor(F.col("value") * 60 * 1_000_000))
    kept, counts = windows.same_day_counted(event_stream(spark, sf).withColumn("ends", ends), "ts", "ends", "counted")
    total = counts.agg(*[F.sum(c).alias(c) for c in ("read", "kept", "cross_day", "no_time")])
    return total.crossJoin(kept.agg(F.count("*").alias("written")))  # one row each


@query("j17_near_clusters", """with recursive p as (select vec_id id, embedding[1]::double x, embedding[2]::double y from embeddings),
    e as (select a.id s, b.id d from p a join p b on a.id <> b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02),
    r(node, c) as (select id, id from p union select e.d, r.c from r join e on e.s = r.node), m as (select node id, min(c) as cluster from r group by 1)
    select id, m.cluster, count(*) over (partition by m.cluster) members, round(avg(x) over (partition by m.cluster), 6) cx, round(avg(y) over (partition by m.cluster), 6) cy from m join p using (id)""")
def _(spark, sf):
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return show(spatial.near_clusters(p, 0.02), "id", "cluster", "members", cx="cx", cy="cy")


#: Places that straddle the seam and lie around both poles, besides usual ones: longitude, latitude, spread of longitude in degrees.
_SPOTS = [(116.4, 39.9, 0.004), (180.0, 10.0, 0.003), (-179.9999, -45.0, 0.004), (0.0, 89.9990, 360.0), (40.0, -89.9985, 360.0), (0.0, 0.0, 0.003), (25.0, 70.0, 0.01)]


@query("j15_sphere_exposure", f"""with spots as (select row_number() over () - 1 s, * from (values {", ".join(map(str, _SPOTS))}) v(lon0, lat0, spread)),
    p as (select c_custkey id, lon0 + spread * ((c_custkey * 37 % 101) / 100.0 - 0.5)::double lon, greatest(-90.0, least(90.0, lat0 + 0.003 * ((c_custkey * 53 % 89) / 88.0 - 0.5)))::double lat, 'c' || (c_custkey % 3) category from customer join spots on c_custkey % 7 = s),
    d as (select a.id, b.category, 2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) d from p a join p b on b.id % 2 = 1 and a.id % 2 = 0 and a.id % 7 = b.id % 7),
    n as (select p.id, {", ".join(f"count(*) filter (d.category = 'c{c}' and d <= {r}) c{c}_{r}" for c in range(3) for r in (50, 100, 200))} from p left join d using (id) where p.id % 2 = 0 group by 1),
    a as (select *, (c0_100 + c1_100 + c2_100) / (pi() * 0.01) density, ln(1 + c0_100) + ln(1 + c1_100) activity from (select id, {", ".join(f"c{c}_{r}" for c in range(3) for r in (50, 100, 200))} from n))
    select id, {", ".join(f"c{c}_{r}" for c in range(3) for r in (50, 100, 200))}, round(density, 4) density, round(activity, 6) activity,
        round((rank() over (order by round(activity, 9)) + (count(*) over (partition by round(activity, 9)) - 1) / 2) / count(*) over (), 6) activity_rank from a""")
def _(spark, sf):
    spot = F.element_at(F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("lon", "lat", "spread"), s, strict=True)]) for s in _SPOTS]), (F.col("c_custkey") % 7 + 1).cast("int"))
    p = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (spot["lon"] + spot["spread"] * (F.col("c_custkey") * 37 % 101 / 100 - 0.5)).alias("lon"),
        F.greatest(F.lit(-90.0), F.least(F.lit(90.0), spot["lat"] + 0.003 * (F.col("c_custkey") * 53 % 89 / 88 - 0.5))).alias("lat"), F.concat(F.lit("c"), F.col("c_custkey") % 3).alias("category"))
    out = spatial.sphere_counts(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["c0", "c1", "c2"], [50, 100, 200], 100, ["c0", "c1"])
    counts = [f"c{c}_{r}" for c in range(3) for r in (50, 100, 200)]
    return out.select("id", *counts, F.round("density", 4).alias("density"), r6("activity").alias("activity"), r6("activity_rank").alias("activity_rank"))


_DRAW = "cast(floor((('0x' || substr(sha256('boot|' || rep || '|' || k), 1, 13))::bigint / 4503599627370496.0) * n) as bigint)"


@query("e6_paired_bootstrap", f"""with s as (select user_id, sum(abs(value - 40)) ea, sum(abs(value - 20)) eb, count(value) n, count(*) filter (value > 60 and day(ts) <= 15) ha, count(*) filter (day(ts) <= 15) ra, count(*) filter (value > 60 and day(ts) > 15) hb, count(*) filter (day(ts) > 15) rb from events group by 1),
    i as (select *, row_number() over (order by user_id) - 1 place, count(*) over () m from s),
    d as (select rep, {_DRAW.replace("* n)", "* m)")} place from (select place k, m, unnest(range(1, 61)) rep from i)),
    t as (select rep, sum(ea) ea, sum(eb) eb, sum(n) n, sum(ha) ha, sum(ra) ra, sum(hb) hb, sum(rb) rb from d join i using (place) group by 1 union all select 0, sum(ea), sum(eb), sum(n), sum(ha), sum(ra), sum(hb), sum(rb) from s),
    v as (select rep, 'mae' as statistic, ea / n v from t union all select rep, 'paired_difference', (ea - eb) / n from t union all select rep, 'rate_ratio', (ha / ra) / (hb / rb) from t)
    select statistic, round(max(v) filter (rep = 0), 6) estimate, round(avg(v) filter (rep > 0), 6) mean, round(quantile_cont(v, 0.025) filter (rep > 0), 6) low, round(quantile_cont(v, 0.975) filter (rep > 0), 6) high from v group by 1""")
def _(spark, sf):
    e, early, hit = events(spark, sf), F.day("ts") <= 15, F.col("value") > 60
    one = lambda c: F.when(c, 1).otherwise(0)
    sums = {"ea": F.abs(F.col("value") - 40), "eb": F.abs(F.col("value") - 20), "n": one(F.col("value").isNotNull()), "ha": one(hit & early), "ra": one(early), "hb": one(hit & ~early), "rb": one(~early)}
    found = resample.bootstrap(e, "user_id", sums, {
        "mae": lambda s: s("ea") / s("n"), "paired_difference": lambda s: (s("ea") - s("eb")) / s("n"), "rate_ratio": lambda s: F.try_divide(F.try_divide(s("ha"), s("ra")), F.try_divide(s("hb"), s("rb")))}, 60, "boot")
    return show(found, "statistic", estimate="estimate", mean="mean", low="low", high="high")


@query("m6_chosen_tau", """with u as (select user_id, avg(value) m, count(*) n from events where day(ts) <= 12 group by 1), g as (select avg(value) g from events where day(ts) <= 12),
    c as (select unnest([0.25, 0.5, 0.75])::double candidate), t as (select 0.25::double candidate, quantile_cont(n, 0.25)::double tau from u union all select 0.5, quantile_cont(n, 0.5) from u union all select 0.75, quantile_cont(n, 0.75) from u),
    e as (select candidate, tau, sqrt(avg((value - (coalesce(n, 0) / (coalesce(n, 0) + tau) * coalesce(m, g) + (1 - coalesce(n, 0) / (coalesce(n, 0) + tau)) * g)) ** 2)) rmse from (select * from events where day(ts) > 12) v left join u using (user_id), g, t group by all)
    select candidate, tau, round(rmse, 6) rmse, row_number() over (order by round(rmse, 9), candidate) = 1 chosen from e""")
def _(spark, sf):
    e = events(spark, sf)
    return show(ml.choose_tau(e.where(F.day("ts") <= 12), e.where(F.day("ts") > 12), "user_id", "value"), "candidate", "tau", "chosen", rmse="rmse")


_HEX = [f"('0x' || substr(h, {i}, 8))::bigint" for i in range(1, 65, 8)]
_FOLD = "0"
for _h in _HEX:
    _FOLD = f"(({_FOLD}) * 4294967296 + {_h}) % 5"


@query("m4_speed_folds", f"""with e as (select event_id, event_type k, value v, [10.0::double, 30.0, 60.0, 120.0][user_id % 4 + 1] l, sha256('fold|' || user_id) h from events),
    t as (select *, {_FOLD} as fold from e), f as (select distinct fold from t),
    pr as (select f.fold, k, l, count(*) c from f join t on t.fold <> f.fold group by all), mu as (select f.fold, avg(ln(v / l)) mu from f join t on t.fold <> f.fold where v > 0 group by 1),
    s as (select event_id, t.fold, t.l, g, round(ln(coalesce(c, 0) + 1) - coalesce((case when v > 0 then ln(v / g) end - mu) ** 2 / (2 * 0.25), 0), 9) s from t left join mu using (fold) cross join unnest([10.0::double, 30.0, 60.0, 120.0]) u(g) left join pr on pr.fold = t.fold and pr.k = t.k and pr.l = g),
    b as (select * from s qualify row_number() over (partition by event_id order by s desc, g) = 1)
    select cast(fold as int) fold, count(*) n, round(avg((l = g)::int), 6) exact, round(avg((abs(l - g) <= 10)::int), 6) within_10,
        round(avg((((l <= 60) = (g <= 60))::int + ((l <= 80) = (g <= 80))::int + ((l <= 120) = (g <= 120))::int) / 3), 6) compatible, round(avg(abs(l - g)), 6) mae from b group by grouping sets ((fold), ())""")
def _(spark, sf):
    grid = [10.0, 30.0, 60.0, 120.0]
    e = events(spark, sf).withColumn("l", F.element_at(F.array(*map(F.lit, grid)), (F.col("user_id") % 4 + 1).cast("int")))
    found = scores.speed_folds(e, "event_type", "value", "l", "user_id", grid, 0.5, "event_id", 5, "fold")
    return show(found, "fold", "n", exact="exact", within_10="within_10", compatible="compatible", mae="mae")


def _structure_sql(field: str) -> str:
    return f"(select {field} v, row_number() over (order by count(*) desc, {field}) - 1 i from t where {field} is not null group by 1)"


@query("m3_encoding", f"""with p as (select p_partkey, nullif(p_type, 'PROMO') kind, p_brand, case when p_size % 7 <> 0 then p_size end size, date '2020-01-01' + cast(p_partkey % 50 as int) d from part),
    t as (select * from p where p_partkey % 4 = 0 and coalesce(size, 0) < 20), a as {_structure_sql("kind")}, b as {_structure_sql("p_brand")}, z as (select avg(size) c, stddev_pop(size) s from t), n as (select (select count(*) from a) na, (select count(*) from b) nb)
    select p_partkey, case when kind is not null then coalesce(a.i, na) end kind_code, (kind is not null)::int kind_known, coalesce(b.i, nb) brand_code, array_to_string(list_transform(range(na + 1), lambda x: (kind is not null and x = coalesce(a.i, na))::int), '') kind_one_hot,
        round(coalesce((size - c) / s, 0), 6) size_z, (size is not null)::int size_known, (select min(d) from t)::varchar first_date, (select max(d) from t)::varchar last_date
    from p left join a on a.v = kind left join b on b.v = p_brand, n, z""")
def _(spark, sf):
    """Codes, one-hot vectors, centred numbers and masks by a frozen table of the training vocabulary."""
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("kind"), "p_brand", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"),
                                        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 50).cast("int")).alias("d"))
    train = p.where((F.col("p_partkey") % 4 == 0) & (F.coalesce("size", F.lit(0)) < 20))
    fitted = ml.fit_structure(train, ["kind", "p_brand"], ["size"], "d", new_path(spark, "structure"))
    out = ml.apply_structure(fitted, p, ["kind", "p_brand"], ["size"]).crossJoin(fitted.agg(F.min("first_date").alias("a"), F.max("last_date").alias("b")))  # one row
    return out.select("p_partkey", "kind_code", "kind_known", F.col("p_brand_code").alias("brand_code"), F.array_join(ml.one_hot(F.col("kind_code"), F.col("kind_width")), "").alias("kind_one_hot"),
                      r6("size_z").alias("size_z"), "size_known", F.col("a").cast("string").alias("first_date"), F.col("b").cast("string").alias("last_date"))


_FACTORS = "(select l_returnflag a, l_linestatus b, l_linenumber c, l_quantity v from lineitem)"


@query("e14_marginal_means", f"""select a, b, c, case when grouping(a, b, c) = 3 then 'a' when grouping(a, b, c) = 5 then 'b' when grouping(a, b, c) = 6 then 'c' end factor, round(avg(v), 6) mean, count(v) n
    from {_FACTORS} group by grouping sets ((a, b, c), (a), (b), (c))""")
def _(spark, sf):
    return show(reports.factorial_cells(_factors(spark, sf), ["a", "b", "c"], "v"), "a", "b", "c", "factor", "n", mean="mean")


def _factors(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_linenumber").alias("c"), F.col("l_quantity").alias("v"))


def _change_sql(f: str, x: str, y: str) -> str:
    return f"""select '{f}' as factor, '{x}=' || {x} || ',{y}=' || {y} context, count(*) levels, arg_max(m, {f}) - arg_min(m, {f}) total_change, max(step) largest_step, count(*) filter (step > 0) rises, count(*) filter (step < 0) falls
        from (select *, m - lag(m) over (partition by {x}, {y} order by {f}) step from m) group by {x}, {y}"""


@query("e14_level_changes", f"""with m as (select a, b, c, avg(v) m from {_FACTORS} group by all), u as ({_change_sql("a", "b", "c")} union all {_change_sql("b", "a", "c")} union all {_change_sql("c", "a", "b")})
    select factor, context, levels, round(total_change, 6) total_change, round(largest_step, 6) largest_step, rises, falls,
        case when levels = 1 then 'single' when rises > 0 and falls > 0 then 'mixed' when rises > 0 then 'increasing' when falls > 0 then 'decreasing' else 'flat' end shape from u""")
def _(spark, sf):
    out = reports.factorial_changes(_factors(spark, sf), ["a", "b", "c"], "v")
    return show(out, "factor", "context", "levels", "rises", "falls", "shape", total_change="total_change", largest_step="largest_step")


_ROUTE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"
_BEFORE = "over (partition by l_orderkey order by q rows between unbounded preceding and 1 preceding)"


@query("w6_entry_variance", f"""with t as (select l.*, epoch_us(o_orderdate) / 1e6 s, row_number() over (partition by l_orderkey order by {_ROUTE}) - 1 q from lineitem l join orders on o_orderkey = l_orderkey),
    p as (select l_suppkey, cast(floor(epoch_us(l_shipdate) / 1e6 / 864000) as bigint) slot, avg(l_discount) * 1e6 pace, stddev_pop(l_discount) * 1e6 sd, count(*) n from lineitem group by all),
    e1 as (select t.*, s + coalesce(sum(l_quantity * coalesce(pace, 5e4)) {_BEFORE}, 0) entry_1 from t left join p on p.l_suppkey = t.l_suppkey and slot = cast(floor(s / 864000) as bigint)),
    e2 as (select e1.*, l_quantity * coalesce(pace, 5e4) time, case when pace is null then 0.5 * l_quantity * 5e4 when n <= 1 then greatest(l_quantity * sd, 0.25 * l_quantity * pace) else l_quantity * sd end dev from e1 left join p on p.l_suppkey = e1.l_suppkey and p.slot = cast(floor(entry_1 / 864000) as bigint))
    select l_orderkey, q as sequence, round(s + coalesce(sum(time) {_BEFORE}, 0), 1) entry_2, round(sqrt(coalesce(sum(dev * dev) {_BEFORE}, 0)), 1) deviation from e2""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", (X.micros(F.col("o_orderdate")) / 1e6).alias("s"))
    rows = positions(lines, ["l_orderkey"], _ROUTE.split(", ")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    pace = lines.groupBy("l_suppkey", F.floor(X.micros(F.col("l_shipdate")) / 1e6 / 864_000).cast("long").alias("slot")).agg(
        (F.avg("l_discount") * 1e6).alias("pace"), (F.stddev_pop("l_discount") * 1e6).alias("sd"), F.count("*").alias("n"))
    e = history.entry_times(rows, pace, "l_orderkey", "sequence", "s", "l_quantity", "l_suppkey", 864_000, 5e4, "sd", "n")
    return e.select("l_orderkey", "sequence", F.round("entry_2", 1).alias("entry_2"), F.round(F.sqrt("entry_variance"), 1).alias("deviation"))


@query("w13_remaining", f"""select l_orderkey, row_number() over w - 1 as sequence, round((sum(l_quantity) over (partition by l_orderkey) - coalesce(sum(l_quantity) over (w rows between unbounded preceding and 1 preceding), 0)) / sum(l_quantity) over (partition by l_orderkey), 6) remaining_ratio
    from lineitem window w as (partition by l_orderkey order by {_ROUTE})""")
def _(spark, sf):
    order = _ROUTE.split(", ")
    rows = sequence.remaining_ratio(positions(table(spark, sf, "lineitem"), ["l_orderkey"], order), ["l_orderkey"], order, "l_quantity")
    return show(rows, "l_orderkey", "sequence", remaining_ratio="remaining_ratio")


@query("a33_mode_fallback", """with t as (select user_id, event_type, cast(floor(value / 10) as bigint) v from events where day(ts) <= 6), a as (select user_id, event_type, arg_min(v, {'n': -n, 'v': v}) m from (select user_id, event_type, v, count(*) n from t group by all) group by all),
    b as (select event_type, arg_min(v, {'n': -n, 'v': v}) m from (select event_type, v, count(*) n from t where event_type <> 'click' group by all) group by all), g as (select arg_min(v, {'n': -n, 'v': v}) m from (select v, count(*) n from t group by all))
    select event_id, coalesce(a.m, b.m, g.m) as mode, case when a.m is not null then 'user_id_event_type' when b.m is not null then 'event_type' else 'global' end mode_level from events left join a using (user_id, event_type) left join b using (event_type), g where event_type <> 'click'
    union all select event_id, coalesce(a.m, c.m) as mode, case when a.m is not null then 'user_id_event_type' else 'event_type' end from events left join a using (user_id, event_type), (select arg_min(v, {'n': -n, 'v': v}) m from (select v, count(*) n from t where event_type = 'click' group by all)) c where event_type = 'click'""")
def _(spark, sf):
    e = events(spark, sf).withColumn("v", F.floor(F.col("value") / 10).cast("long"))
    out = quantiles.mode_with_fallback(e.where(F.day("ts") <= 6), e, [["user_id", "event_type"], ["event_type"], []], "v")
    return out.select("event_id", "mode", "mode_level")


@query("j20_transitions", """with u as (select user_id, day(ts) <= 3 early, avg(value) v, case when avg(value) > 60 then 'late' when count(*) < 3 then 'short' else 'done' end o from events where day(ts) <= 6 group by all), a as (select * from u where early), b as (select * from u where not early),
    c as (select coalesce(a.o, 'absent') outcome_a, coalesce(b.o, 'absent') outcome_b, count(*) n, avg(b.v - a.v) d from a full join b using (user_id) group by all)
    select outcome_a, outcome_b, n, round(d, 6) mean_delta, round(n / sum(n) over (partition by outcome_a), 6) as share from c""")
def _(spark, sf):
    def run(early: bool):
        e = events(spark, sf).where(F.day("ts") <= 3 if early else F.day("ts").between(4, 6)).groupBy("user_id").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
        return e.withColumn("o", F.when(F.col("v") > 60, "late").when(F.col("n") < 3, "short").otherwise("done"))

    return show(joins.outcome_transitions(run(True), run(False), "user_id", "o", "v"), "outcome_a", "outcome_b", "n", mean_delta="mean_delta", share="share")


_SCORED = "(select doc_id, quality y, least(n_chars / 20000.0::double, 1) s, source from labels join documents using (doc_id))"


@query("e3_cohort_calibration", f"""with r as (select source, least(floor(s * 15), 14) b, count(*) n, avg(s) ms, avg(y) mt from {_SCORED} group by all) select source, cast(sum(n) as bigint) n, round(sum(n * abs(ms - mt)) / sum(n) + 1e-9, 6) ece from r group by 1""")
def _(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    d = d.select(F.col("quality").alias("y"), F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("s"), "source")
    return evaluate.cohort_calibration_error(d, ["source"], "y", "s").select("source", "n", r6(F.col("ece") + 1e-9).alias("ece"))


@query("e5_slices", """with p as (select l_returnflag, l_linestatus, l_extendedprice t, l_quantity * p_retailprice x from lineitem join part on p_partkey = l_partkey),
    e as (select 'overall' as slice, 'all' as level, t, x from p union all select 'l_returnflag', l_returnflag, t, x from p union all select 'l_linestatus', l_linestatus, t, x from p)
    select slice, level, count(*) n, round(avg(abs(x - t)), 4) mae, round(sqrt(avg((x - t) ** 2)), 4) rmse, round(avg(x - t), 4) bias, round(corr(t, x), 6) pearson from e group by all""")
def _(spark, sf):
    p = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_retailprice"), F.col("p_partkey") == F.col("l_partkey"))
    m = evaluate.regression_slices(p.withColumn("x", F.col("l_quantity") * F.col("p_retailprice")), ["l_returnflag", "l_linestatus"], "l_extendedprice", "x")
    return m.select("slice", "level", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias")], r6("pearson").alias("pearson"))


@query("g3_route_movements", f"""with s as (select l_orderkey, row_number() over w - 1 movement, l_suppkey i, lead(l_suppkey) over w o, row_number() over w = count(*) over (partition by l_orderkey) z from lineitem window w as (partition by l_orderkey order by {_ROUTE})),
    lv as (select s_suppkey k, case when s_suppkey % 5 > 0 then s_suppkey % 3 end lev from supplier),
    m as (select a.k i, b.k o, case when a.lev is null or b.lev is null then 'unknown' when a.lev = b.lev then 'same' when b.lev > a.lev then 'up' else 'down' end turn, case when (a.k + b.k) % 7 = 0 then 'prohibited' else 'allowed' end state from (select distinct i, o from s where o is not null) p join lv a on a.k = p.i join lv b on b.k = p.o where (p.i * 3 + p.o) % 4 > 0)
    select l_orderkey, movement, s.i in_edge, s.o out_edge, turn, coalesce(state, 'unlisted') state from s left join m on m.i = s.i and m.o = s.o where not z""")
def _(spark, sf):
    """Turn here is the class of the change of level, over the pairs of suppliers that follow each other."""
    lines, order = table(spark, sf, "lineitem"), _ROUTE.split(", ")
    pairs = lines.select(F.col("l_suppkey").alias("in_edge"), F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("out_edge")).where("out_edge is not null").distinct()
    lev = lambda c: F.when(F.col(c) % 5 > 0, F.col(c) % 3)
    m = pairs.where((F.col("in_edge") * 3 + F.col("out_edge")) % 4 > 0).select(
        "in_edge", "out_edge", context.level_transition(lev("in_edge"), lev("out_edge")).alias("turn"), F.when((F.col("in_edge") + F.col("out_edge")) % 7 == 0, "prohibited").otherwise("allowed").alias("state"))
    return context.route_movements(lines, "l_orderkey", order, "l_suppkey", m)


@query("a54_visit_stops", """with p as (select *, epoch_us(ts) / 1e6 t, value < 40 halt from events), q as (select *, lag(event_type) over w is distinct from event_type nl, coalesce(lag(halt) over w, false) ph, row_number() over w rn from p window w as (partition by user_id order by ts, event_id)),
    v as (select *, sum(case when rn > 1 and nl then 1 else 0 end) over w visit, sum(case when (rn > 1 and nl) or halt <> ph then 1 else 0 end) over w run from q window w as (partition by user_id order by ts, event_id)),
    r as (select user_id, visit, event_type, run, bool_or(halt) halt, max(t) - min(t) s from v group by all)
    select user_id, cast(visit as bigint) visit, event_type, count(*) filter (halt and s >= 1800) stops, round(coalesce(sum(s) filter (halt and s >= 1800), 0), 3) stop_s, round(coalesce(max(s) filter (halt and s >= 1800), 0), 3) longest_stop_s from r group by all""")
def _(spark, sf):
    e = events(spark, sf).withColumn("t", X.micros(F.col("ts")) / 1e6)
    v = traces.visit_stops(e, "user_id", ["ts", "event_id"], "t", "event_type", F.col("value") < 40, 1800.0)
    return v.select("user_id", "visit", "event_type", "stops", F.round("stop_s", 3).alias("stop_s"), F.round("longest_stop_s", 3).alias("longest_stop_s"))


def _dimension(d: str) -> str:
    there = f"coalesce(c >= 0.5 and w_{d} > 0, false)"
    return f"case when {there} then x_{d} / w_{d} end {d}, coalesce(w_{d} / w, 0) cov_{d}, case when {there} then '' when n is null then 'NO_PARTS' when c < 0.5 then 'COVERAGE_BELOW_THRESHOLD' else 'NO_AVAILABLE_PARTS' end reason_{d}"


@query("a5_order_labels", f"""with p as (select l_orderkey, l_quantity w, case when l_discount > 0.02 then l_discount / (l_discount + 0.05) end a, case when l_linenumber > 2 then l_tax / 0.08 end b, l_returnflag <> 'R' direct from lineitem where l_orderkey % 9 > 0),
    s as (select l_orderkey, count(*) n, sum(w) w, sum(case when direct then w else 0 end) d, sum(case when a is not null then w else 0 end) w_a, sum(w * a) x_a, sum(case when b is not null then w else 0 end) w_b, sum(w * b) x_b from p group by 1),
    o as (select o_orderkey, s.*, coalesce(d / w, 0) c from orders left join s on l_orderkey = o_orderkey), r as (select o_orderkey, c, {_dimension("a")}, {_dimension("b")} from o)
    select o_orderkey, round(c + 1e-9, 6) coverage, round(a + 1e-9, 6) a, round(cov_a + 1e-9, 6) a_coverage, reason_a a_reason, round(b + 1e-9, 6) b, round(cov_b + 1e-9, 6) b_coverage, reason_b b_reason,
        case when a is not null and b is not null then 'a+b' when a is not null then 'a' when b is not null then 'b' else 'none' end signature, round(case when a is null then b when b is null then a else (a + b) / 2 end + 1e-9, 6) composite from r""")
def _(spark, sf):
    parts = table(spark, sf, "lineitem").where("l_orderkey % 9 > 0").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_quantity", F.when(F.col("l_discount") > 0.02, F.col("l_discount") / (F.col("l_discount") + 0.05)).alias("a"),
        F.when(F.col("l_linenumber") > 2, F.col("l_tax") / 0.08).alias("b"), (F.col("l_returnflag") != "R").alias("direct"))
    out = labels.order_labels(table(spark, sf, "orders").select("o_orderkey"), parts, "o_orderkey", ["a", "b"], "l_quantity", F.col("direct"), 0.5)
    return out.select("o_orderkey", "a_reason", "b_reason", "signature", *[r6(F.col(c) + 1e-9).alias(c) for c in ("coverage", "a", "a_coverage", "b", "b_coverage", "composite")])


_LINKS = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, case when l_linenumber < 7 then l_discount * 5 end low_share, l_tax * 4 stop_share,
    case when l_returnflag <> 'A' or l_linenumber <> 3 then l_quantity / 25 end speed_variation, l_extendedprice / 50000 acceleration, cast(l_quantity as double) duration,
    l_discount * 100 / 7 low_time, l_tax * 100 / 7 stop_time, cast(o_custkey % 400 - 200 as double) angle, cast(p_size % 12 as double) node_degree, p_retailprice / 10 curvature, p_size <= 10 minor,
    case when p_size % 3 > 0 then p_size / 4e0 end fragmentation, cast(p_partkey % 10 as double) end_degree, case when l_suppkey % 50 > 0 then l_extendedprice / 21000 - 1 end excess,
    case when l_suppkey % 7 > 0 then (l_suppkey % 100) / 80e0 end activity, l_returnflag <> 'R' observed, o_orderstatus <> 'P' movement_reliable
    from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey"""


@query("p13_five_dimensions", f"""with l as ({_LINKS}), m as (select *, l_linenumber = max(l_linenumber) over (partition by l_orderkey) last_link,
    list_avg([coalesce(low_share, 0), coalesce(stop_share, 0), speed_variation / (speed_variation + 1), acceleration / (acceleration + 1)]) c, case when excess is not null then greatest(excess, 0) end late from l)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when observed then least(c, 1) end, 6) congestion,
    round(case when observed and (movement_reliable or last_link) then list_avg([least(low_time / duration, 1), least(stop_time / duration, 1), least(abs(angle) / 180, 1), least(node_degree / 8, 1)]) end, 6) intersection,
    round(list_avg([curvature / (curvature + 90), case when minor then 1e0 else 0e0 end, case when fragmentation is not null then least(fragmentation / 10, 1) end, least(end_degree / 8, 1)]), 6) geometry,
    round(case when observed then late / (late + 1) end, 6) tail, round(case when observed then least(coalesce(activity, 0), 1) * (least(c, 1) + late / (late + 1)) / 2 end, 6) place_activity,
    round(case when coalesce(activity, 0) >= 0.75 then late else 0e0 end, 6) active_delay from m""")
def _(spark, sf):
    li, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    rows = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    d = lambda c: F.expr(c).cast("double")
    links = rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") < 7, d("l_discount * 5")).alias("low_share"), d("l_tax * 4").alias("stop_share"),
        F.when((F.col("l_returnflag") != "A") | (F.col("l_linenumber") != 3), d("l_quantity / 25")).alias("speed_variation"), d("l_extendedprice / 50000").alias("acceleration"),
        d("l_quantity").alias("duration"), d("l_discount * 100 / 7").alias("low_time"), d("l_tax * 100 / 7").alias("stop_time"), d("o_custkey % 400 - 200").alias("angle"),
        d("p_size % 12").alias("node_degree"), d("p_retailprice / 10").alias("curvature"), (F.col("p_size") <= 10).alias("minor"),
        F.when(F.col("p_size") % 3 > 0, d("p_size / 4")).alias("fragmentation"), d("p_partkey % 10").alias("end_degree"),
        F.when(F.col("l_suppkey") % 50 > 0, d("l_extendedprice / 21000 - 1")).alias("excess"), F.when(F.col("l_suppkey") % 7 > 0, d("(l_suppkey % 100) / 80")).alias("activity"),
        (F.col("l_returnflag") != "R").alias("observed"), (F.col("o_orderstatus") != "P").alias("movement_reliable"))
    names = ("congestion", "intersection", "geometry", "tail", "place_activity", "active_delay")
    return show(labels.five_dimensions(links, "l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", **{c: c for c in names})


def _split_sql(truth: str) -> str:
    """Tables ``split`` (feature, threshold), ``t`` (training rows) and ``leaf`` (side, mean): the one split of least squared error."""
    return f"""t as (select l_quantity q, l_linenumber n, {truth} y from lineitem where l_orderkey % 2 = 0),
    v as (select 'q' f, cast(q as double) v, count(*) c, sum(y) s from t group by all union all select 'n', n, count(*), sum(y) from t group by all),
    u as (select f, v, lead(v) over w nxt, sum(c) over w c, sum(s) over w s from v window w as (partition by f order by v)),
    g as (select f, (v + nxt) / 2 cut, s * s / c + pow((select sum(y) from t) - s, 2) / ((select count(*) from t) - c) gain from u where nxt is not null),
    split as (select arg_max(f, gain) f, arg_max(cut, gain) cut from g),
    leaf as (select (case when f = 'q' then q else n end) <= cut low, avg(y) m from t, split group by 1)"""


@query("m1_one_split", f"""with {_split_sql("case when l_quantity * l_extendedprice > 800000 then 1e0 else 0e0 end")}
    select l_orderkey, l_linenumber, l_partkey, l_quantity, round(m, 6) score from lineitem, split join leaf on leaf.low = ((case when split.f = 'q' then l_quantity else l_linenumber end) <= split.cut) where l_orderkey % 2 = 1""")
def _(spark, sf):
    """The classifier forest with one tree of one split, which SQL can find too."""
    rows = table(spark, sf, "lineitem").withColumn("y", (F.col("l_quantity") * F.col("l_extendedprice") > 800_000).cast("double"))
    model = ml.fit_forest(rows.where("l_orderkey % 2 = 0"), [], ["l_quantity", "l_linenumber"], "y", binary=True, trees=1, depth=1)
    return ml.predict(model, rows.where("l_orderkey % 2 = 1"), "p").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", r6("p").alias("score"))


@query("m1_model_errors", f"""with {_split_sql("l_extendedprice")}, b as (select l_linenumber g, avg(l_extendedprice) m from lineitem where l_orderkey % 2 = 0 group by 1),
    e as (select l_extendedprice y, (select avg(y) from t) constant, coalesce(b.m, (select avg(y) from t)) class_mean, leaf.m one_split
        from lineitem cross join split join leaf on leaf.low = ((case when split.f = 'q' then l_quantity else l_linenumber end) <= split.cut) left join b on b.g = l_linenumber where l_orderkey % 2 = 1),
    k as (select 'constant' model, abs(constant - y) e from e union all select 'class_mean', abs(class_mean - y) from e union all select 'one_split', abs(one_split - y) from e),
    a as (select model, count(*) n, avg(e) mae, sqrt(avg(e * e)) rmse from k group by 1)
    select model, n, round(mae, 3) mae, round(rmse, 3) rmse, row_number() over (order by mae, model) = 1 best from a""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("g", F.col("l_linenumber"))
    train, test = rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1")
    model = ml.fit_forest(train, [], ["l_quantity", "l_linenumber"], "l_extendedprice", trees=1, depth=1)
    scored = ml.predict(model, ml.class_means(train, test, "g", "l_extendedprice"), "one_split")
    out = ml.model_errors(scored, "l_extendedprice", ["constant", "class_mean", "one_split"])
    return out.select("model", "n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), "best")


@query("m1_forest_classifier")
def _(spark, sf):
    """Lines of a high value by a forest over flags and numbers; no SQL, tested by its ranking of lines it wasn't fitted on."""
    rows = table(spark, sf, "lineitem").withColumn("y", (F.col("l_quantity") * F.col("l_extendedprice") > 800_000).cast("double"))
    model = ml.fit_forest(rows.where("l_orderkey % 2 = 0"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_linenumber", "l_discount"], "y", binary=True)
    return ml.predict(model, rows.where("l_orderkey % 2 = 1"), "p").select("l_orderkey", "l_linenumber", "l_partkey", "y", "p")
