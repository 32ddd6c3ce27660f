"""Queries of history, model reports, streams, scans and sinks, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import exprs as X
from waymark.operators import context, history, quantiles, scores
from waymark.plans.scratch import new_path
from waymark.queries import event_stream, events, query, r6, show, table
from waymark.sources import io

_ROUTE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


@query("w4_session_gap", "with g as (select (epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 6e7 gap from events) select case when quantile_disc(gap, 0.9) > 600 then 900.0::double else 600.0::double end gap_limit from g")
def _(spark, sf):
    from waymark.operators.sequence import next_intervals

    gaps = next_intervals(events(spark, sf), ["user_id"], "ts", "event_id").select((F.col("duration_s") / 60).alias("gap"))
    return history.session_gap(gaps.where("gap is not null"), "gap", 600.0, 900.0).select("gap_limit")


@query("w8_trailing_means", """select event_id, round(coalesce(sum(value) over a, 0), 5) sum_60, count(value) over a n_60, round(avg(value) over a, 5) mean_60, round(coalesce(sum(value) over b, 0), 5) sum_1440, count(value) over b n_1440
    from events window a as (partition by event_type order by epoch_us(ts) range between 3600000000 preceding and 1 preceding), b as (partition by event_type order by epoch_us(ts) range between 86400000000 preceding and 1 preceding)""")
def _(spark, sf):
    t = history.trailing_means(events(spark, sf), ["event_type"], "ts", "value", [60, 1440])
    return t.select("event_id", F.round("sum_60", 5).alias("sum_60"), "n_60", F.round("mean_60", 5).alias("mean_60"), F.round("sum_1440", 5).alias("sum_1440"), "n_1440")


@query("w6_entry_times", f"""with t as (select l.*, epoch_us(o_orderdate) / 1e6 s, row_number() over (partition by l_orderkey order by {_ROUTE}) - 1 q from lineitem l join orders on o_orderkey = l_orderkey),
    p as (select l_suppkey, cast(floor(epoch_us(l_shipdate) / 1e6 / 864000) as bigint) slot, avg(l_discount) * 1e6 pace from lineitem group by all),
    e1 as (select t.*, s + coalesce(sum(l_quantity * coalesce(pace, 5e4)) over (partition by l_orderkey order by q rows between unbounded preceding and 1 preceding), 0) entry_1 from t left join p on p.l_suppkey = t.l_suppkey and slot = cast(floor(s / 864000) as bigint)),
    e2 as (select e1.*, s + coalesce(sum(l_quantity * coalesce(p.pace, 5e4)) over (partition by l_orderkey order by q rows between unbounded preceding and 1 preceding), 0) entry_2 from e1 left join p on p.l_suppkey = e1.l_suppkey and p.slot = cast(floor(entry_1 / 864000) as bigint))
    select l_orderkey, q as sequence, round(entry_1, 1) entry_1, round(entry_2, 1) entry_2 from e2""")
def _(spark, sf):
    from waymark.operators.sequence import positions

    o = table(spark, sf, "orders").select("o_orderkey", (X.micros(F.col("o_orderdate")) / 1e6).alias("s"))
    rows = positions(_lines(spark, sf), ["l_orderkey"], _ROUTE.split(", ")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    pace = _lines(spark, sf).groupBy("l_suppkey", F.floor(X.micros(F.col("l_shipdate")) / 1e6 / 864_000).cast("long").alias("slot")).agg((F.avg("l_discount") * 1e6).alias("pace"))
    e = history.entry_times(rows, pace, "l_orderkey", "sequence", "s", "l_quantity", "l_suppkey", 864_000, 5e4)
    return e.select("l_orderkey", "sequence", F.round("entry_1", 1).alias("entry_1"), F.round("entry_2", 1).alias("entry_2"))


@query("w10_deciles", "select event_id, ntile(10) over (order by value, event_id) decile from events")
def _(spark, sf):
    return history.deciles(events(spark, sf), "value", "event_id").select("event_id", "decile")


@query("w11_selection_rank", "select event_id, round((row_number() over (partition by cast(ts as date) order by sha256('pick|' || event_id), event_id) - 0.5) / count(*) over (partition by cast(ts as date)) + 1e-9, 6) selection_rank from events")
def _(spark, sf):
    e = events(spark, sf).withColumn("date", F.to_date("ts"))
    out = history.selection_rank(e, ["date"], X.seeded_hash("pick", F.col("event_id")), "event_id")
    return out.select("event_id", r6(F.col("selection_rank") + 1e-9).alias("selection_rank"))


@query("a17_caps", """with l as (select 'l_quantity' dim, l_quantity x from lineitem union all select 'l_discount', l_discount from lineitem), r as (select *, row_number() over (partition by dim order by x) - 1 i, count(*) over (partition by dim) n from l)
    select dim, anchor::double anchor, min(x) filter (i >= ceil(round(anchor * (n - 1), 9))) as cap from r, unnest([0.5, 0.9, 0.99]) t(anchor) group by all""")
def _(spark, sf):
    return history.caps(_lines(spark, sf), ["l_quantity", "l_discount"], [0.5, 0.9, 0.99])


@query("a19_support_levels", """with t as (select *, user_id % 10 a, (user_id + 3) % 10 b, hour(ts) h from events where day(ts) <= 20), r as (select event_id, user_id, event_type, user_id % 10 a, (user_id + 3) % 10 b, hour(ts) h from events where day(ts) > 20),
    eh as (select user_id, h, count(*) n from t group by all), kh as (select event_type, h, count(*) n from t group by all), nh as (select node, h, count(*) n from (select unnest([a, b]) node, h from t) group by all), ah as (select h, count(*) n from t group by all),
    j as (select r.*, coalesce(eh.n, 0) e, coalesce(kh.n, 0) k, greatest(coalesce(na.n, 0), coalesce(nb.n, 0)) nn, coalesce(ah.n, 0) al from r left join eh on eh.user_id = r.user_id and eh.h = r.h left join kh on kh.event_type = r.event_type and kh.h = r.h left join nh na on na.node = r.a and na.h = r.h left join nh nb on nb.node = r.b and nb.h = r.h left join ah on ah.h = r.h)
    select event_id, e edge_hour, k kind_hour, nn neighbour_hour, case when e >= 6 then 'edge_hour' when k >= 70 then 'kind_hour' when nn >= 60 then 'neighbour' when al >= 60 then 'all_hour' else 'unavailable' end level from j""".replace("k >= 70", "k >= 60"))
def _(spark, sf):
    e = events(spark, sf).withColumn("a", F.col("user_id") % 10).withColumn("b", (F.col("user_id") + 3) % 10).withColumn("h", F.hour("ts"))
    s = history.support_levels(e.where(F.day("ts") <= 20), e.where(F.day("ts") > 20), "user_id", "event_type", ["a", "b"], "h", 6, 60)
    return s.select("event_id", "edge_hour", "kind_hour", "neighbour_hour", "level")


@query("a28_reference_pace", "select user_id, round(quantile_cont(value, 0.2), 6) q20, round(quantile_cont(value, 0.5), 6) median, count(value) n, count(distinct cast(ts as date)) as days from events where day(ts) <= 20 group by 1")
def _(spark, sf):
    e = events(spark, sf).where(F.day("ts") <= 20).withColumn("date", F.to_date("ts"))
    return show(history.reference_pace(e, ["user_id"], "value", "date"), "user_id", "n", "days", q20="q20", median="median")


@query("a31_frozen_threshold", """with h as (select event_type, least(floor(value / 4), 99) bin, count(*) n from events where value between 0 and 400 group by all), r as (select *, sum(n) over (partition by event_type order by bin) u, sum(n) over (partition by event_type) t from h)
    select event_type, (min(bin) + 0.5) * 4 threshold from r where u >= 0.9 * t group by 1""")
def _(spark, sf):
    h = quantiles.histogram(events(spark, sf), ["event_type"], "value", 0.0, 400.0, 100).where("bin between 0 and 99")
    return history.frozen_threshold(h, ["event_type"], 0.9, 0.0, 4.0)


@query("a41_a62_median_levels", """with t as (select *, hour(ts) h from events where day(ts) <= 20), r as (select event_id, user_id, event_type, hour(ts) h from events where day(ts) > 20), a as (select user_id, h, quantile_cont(value, 0.5) m, count(*) n from t group by all), b as (select event_type, h, quantile_cont(value, 0.5) m, count(*) n from t group by all)
    select event_id, round(case when a.n >= 8 then a.m when b.n >= 8 then b.m else (select quantile_cont(value, 0.5) from t) end, 6) estimate, case when a.n >= 8 then 'user_id_h' when b.n >= 8 then 'event_type_h' else 'global' end level from r left join a using (user_id, h) left join b using (event_type, h)""")
def _(spark, sf):
    e = events(spark, sf).withColumn("h", F.hour("ts"))
    m = history.median_levels(e.where(F.day("ts") <= 20), e.where(F.day("ts") > 20), [["user_id", "h"], ["event_type", "h"], []], "value", 8)
    return show(m, "event_id", "level", estimate="estimate")


@query("a30_std_with_fallback", """with d as (select user_id, event_type, cast(ts as date) date, sum(value) s, sum(value * value) ss, count(value) c from events group by all), w as (select *, sum(s) over p ps, sum(ss) over p pss, sum(c) over p pc from d window p as (partition by user_id, event_type order by date rows between 7 preceding and 1 preceding)),
    l as (select event_type, stddev_samp(value) g from events group by 1) select user_id, event_type, date, round(case when pc >= 6 then sqrt(greatest(pss - ps * ps / pc, 0) / (pc - 1)) else g end, 5) std, case when pc >= 6 then 'own' else 'kind' end level from w join l using (event_type)""")
def _(spark, sf):
    from waymark.operators.causal import previous_days

    e = events(spark, sf).withColumn("date", F.to_date("ts"))
    d = previous_days(e, ["user_id", "event_type"], "date", "value", 7).join(e.groupBy("event_type").agg(F.stddev_samp("value").alias("g")), "event_type")
    own = F.col("n") >= 6
    return d.select("user_id", "event_type", "date", F.round(F.when(own, F.col("std")).otherwise(F.col("g")), 5).alias("std"), F.when(own, "own").otherwise("kind").alias("level"))


@query("j9_history_fallback", """with e as (select * from events where event_type in ('view', 'click')), q as (select * from events where event_type = 'purchase'), g as (select *, user_id % 5 grp from e), h as (select event_id, ts, user_id, user_id % 5 grp from q)
    select event_id, round(case when nu >= 10 then mu when ng >= 10 then mg end + 1e-9, 5) mean, case when nu >= 10 then nu when ng >= 10 then ng end n, case when nu >= 10 then 'user_id' when ng >= 10 then 'grp' end level from (select event_id, (select avg(value) from g where g.user_id = h.user_id and g.ts < h.ts) mu, (select count(value) from g where g.user_id = h.user_id and g.ts < h.ts) nu,
    (select avg(value) from g where g.grp = h.grp and g.ts < h.ts) mg, (select count(value) from g where g.grp = h.grp and g.ts < h.ts) ng from h)""")
def _(spark, sf):
    e = events(spark, sf).withColumn("grp", F.col("user_id") % 5)
    h = history.history_with_fallback(e.where(F.col("event_type").isin("view", "click")), e.where("event_type = 'purchase'"), ["user_id", "grp"], "ts", "value", "event_id", 10)
    return h.select("event_id", F.round(F.col("mean") + 1e-9, 5).alias("mean"), "n", "level")


@query("a11_leave_one_out_quantile", """with b as (select event_id, user_id, least(floor(value / 10), 29) bin from events where value between 0 and 300), h as (select user_id, bin, count(*) n from b group by all), x as (select h.user_id, h.bin, o.bin own, h.n - (h.bin = o.bin)::int n from h join h o using (user_id)),
    r as (select *, sum(n) over (partition by user_id, own order by bin) u, sum(n) over (partition by user_id, own) t from x where n > 0), f as (select user_id, own, min({'b': bin, 'n': n, 'u': u, 'g': 0.5 * (t - 1)}) f from r where u > 0.5 * (t - 1) and t >= 20 group by all)
    select event_id, round((f.f.b + greatest(0, least(1, (f.f.g - (f.f.u - f.f.n) + 0.5) / f.f.n))) * 10, 6) reference from b left join f on f.user_id = b.user_id and f.own = b.bin""")
def _(spark, sf):
    out = history.leave_one_out_quantile(events(spark, sf), ["user_id"], "value", 0.5, 0.0, 300.0, 30, 20)
    return show(out, "event_id", reference="reference")


@query("a13_ecdf_fallback", """with t as (select * from events where day(ts) <= 20), r as (select event_id, user_id, event_type, value from events where day(ts) > 20)
    select event_id, round(case when nu >= 60 then (select count(*) from t where t.user_id = r.user_id and t.value <= r.value) / nu when nk >= 60 then (select count(*) from t where t.event_type = r.event_type and t.value <= r.value) / nk end, 6) ecdf, case when nu >= 60 then 'user_id' when nk >= 60 then 'event_type' end level
    from r join (select user_id, count(*) nu from t group by 1) using (user_id) join (select event_type, count(*) nk from t group by 1) using (event_type)""")
def _(spark, sf):
    e = events(spark, sf)
    out = quantiles.ecdf_with_fallback(e.where(F.day("ts") <= 20), e.where(F.day("ts") > 20), ["user_id", "event_type"], "value", 60)
    return show(out, "event_id", "level", ecdf="ecdf")


@query("a32_time_bins", "select event_type, epoch_us(time_bucket(interval 15 minute, ts)) // 1000000 window_start, count(*) n, round(sum(value), 5) total, count(value) valid from events group by all")
def _(spark, sf):
    g = events(spark, sf).groupBy("event_type", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("t"), F.count("value").alias("valid"))
    return g.select("event_type", F.unix_seconds("w.start").alias("window_start"), "n", F.round("t", 5).alias("total"), "valid")


@query("a40_scaling_profile", """with s as (select user_id, epoch_us(ts) / 1e6 s, epoch_us(ts) / 1e6 + value * 60 e, event_id from events), b as (select unnest(range(cast(floor(s / 1800) as bigint), cast(greatest(ceil(e / 1800), floor(s / 1800) + 1) as bigint))) * 1800 bin, event_id from s where e > s), u as (select bin, count(*) supply from b group by 1),
    d as (select cast(floor(s / 1800) as bigint) * 1800 bin, count(*) demand, count(*) filter (event_id % 4 = 0) replay from s group by 1) select bin, coalesce(demand, 0) demand, coalesce(replay, 0) replay, coalesce(supply, 0) supply, round(replay / demand, 6) ratio, round(supply * replay / demand, 6) target from d full join u using (bin)""")
def _(spark, sf):
    from waymark.operators.joins import overlap_bins

    s = X.micros(F.col("ts")) / 1e6
    e = events(spark, sf).select("event_id", s.alias("s"), (s + F.col("value") * 60).alias("e"))
    supply = overlap_bins(e, "s", "e", 1800).groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("supply"))
    demand = e.groupBy((F.floor(F.col("s") / 1800) * 1800).cast("long").alias("bin")).agg(F.count("*").alias("demand"), F.count_if(F.col("event_id") % 4 == 0).alias("replay"))
    d = demand.join(supply, "bin", "full_outer")
    ratio = F.col("replay") / F.col("demand")
    return d.select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("demand", "replay", "supply")], r6(ratio).alias("ratio"), r6(F.col("supply") * F.col("replay") / F.col("demand")).alias("target"))


@query("a50_vehicle_hours", "with s as (select user_id, epoch_us(ts) / 1e6 s, epoch_us(ts) / 1e6 + value * 60 e from events) select user_id, round(sum(greatest(0, least(e, 1705276800) - greatest(s, 1704672000))) / 3600, 5) as hours from s group by 1")
def _(spark, sf):
    s = X.micros(F.col("ts")) / 1e6
    part = F.greatest(F.lit(0.0), F.least(s + F.col("value") * 60, F.lit(1705276800.0)) - F.greatest(s, F.lit(1704672000.0)))
    return events(spark, sf).groupBy("user_id").agg(F.round(F.sum(part) / 3600, 5).alias("hours"))


@query("m5_remaining_time", """with r as (select l_extendedprice / (l_quantity * p_retailprice) r from lineitem join part on p_partkey = l_partkey where l_orderkey % 2 = 0), i as (select r, row_number() over (order by r) i, count(*) over () n from r), u as (select r, max(i) i from i group by 1),
    j as (select o_orderkey k, 1000.0::double p, o_totalprice % 1500 e, o_totalprice % 1500 / 1000 x from orders), f as (select j.*, coalesce(u.i, 0) i0, (select count(*) from r) - coalesce(u.i, 0) support from j asof left join u on j.x >= u.r)
    select k, round(p * (lo.r + hi.r) / 2 - e, 4) remaining, support from f left join i lo on lo.i = i0 + 1 + (support - 1) // 2 and support > 0 left join i hi on hi.i = i0 + 1 + support // 2 and support > 0""")
def _(spark, sf):
    """Ratios of the even orders' lines, jobs of all orders."""
    l = _lines(spark, sf).where("l_orderkey % 2 = 0").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ratios = l.select((F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice"))).alias("r"))
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1000.0).alias("p"), (F.col("o_totalprice") % 1500).alias("e"))
    return history.remaining_time(ratios, jobs, "r", "k", "p", "e").select("k", F.round("remaining", 4).alias("remaining"), "support")


# model reports

_PRICE = "p as (select l_returnflag g, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice t, l_quantity * p_retailprice x from lineitem join part on p_partkey = l_partkey)"


def _priced(spark, sf):
    l = _lines(spark, sf).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return l.select(F.col("l_returnflag").alias("g"), *_KEYS, "l_suppkey", "l_shipdate", F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * F.col("p_retailprice")).alias("x"))


@query("e10_profile_oracle", f"""with {_PRICE}, tr as (select * from p where l_orderkey % 2 = 0), te as (select * from p where l_orderkey % 2 = 1), a as (select l_partkey, avg(t) m, count(*) n from tr group by 1), b as (select g, avg(t) m, count(*) n from tr group by 1),
    s as (select te.t, case when a.n >= 16 then a.m when b.n >= 16 then b.m end v, case when a.n >= 16 then 'l_partkey' when b.n >= 16 then 'g' end level from te left join a using (l_partkey) left join b using (g)) select level, count(*) n, round(avg(abs(v - t)), 4) mae, round(sqrt(avg((v - t) ** 2)), 4) rmse from s group by 1""")
def _(spark, sf):
    p = _priced(spark, sf)
    o = scores.profile_oracle(p.where("l_orderkey % 2 = 0"), p.where("l_orderkey % 2 = 1"), [["l_partkey"], ["g"]], "t", 16)
    return o.select("level", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("e12_improvement", f"with {_PRICE} select g, count(*) n, round(1 - sum(abs(x - t)) / sum(abs(x * 0.9 - t)), 6) gain, 1 - sum(abs(x - t)) / sum(abs(x * 0.9 - t)) >= 0.02 adopt from p group by 1")
def _(spark, sf):
    return show(scores.improvement(_priced(spark, sf).withColumn("b", F.col("x") * 0.9), ["g"], "t", "b", "x", 0.02), "g", "n", "adopt", gain="gain")


@query("e13_error_by_support", f"""with {_PRICE}, s as (select l_partkey, count(*) c from lineitem group by 1), e as (select abs(x - t) e, case when c <= 20 then 0 when c <= 28 then 1 when c <= 36 then 2 else 3 end bucket from p join s using (l_partkey))
    select bucket, count(*) n, round(avg(e), 4) mae, round(quantile_cont(e, 0.5), 4) median, round(quantile_cont(e, 0.9), 4) p90 from e group by 1""")
def _(spark, sf):
    s = _lines(spark, sf).groupBy("l_partkey").agg(F.count("*").alias("c"))
    e = scores.error_by_support(_priced(spark, sf).withColumn("e", F.col("x") - F.col("t")).join(s, "l_partkey"), "c", "e", [20, 28, 36])
    return e.select("bucket", "n", *[F.round(c, 4).alias(c) for c in ("mae", "median", "p90")])


@query("e17_selection_effect", """with s as (select o_orderpriority p, avg((o_totalprice > 100000)::int) rate, avg(o_custkey) r, count(*) n from orders group by 1), a as (select avg((o_totalprice > 100000)::int) al from orders)
    select p, n, round(rate, 6) rate, round(r, 6) mean_rank, round(rate / al, 6) ratio, rate / al <= 0.99 and al - rate >= 0.001 material from s, a""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "p")
    return show(scores.selection_effect(o, "p", F.col("o_totalprice") > 100_000, "o_custkey", 0.99, 0.001), "p", "n", "material", rate="rate", mean_rank="mean_rank", ratio="ratio")


_U = "(('0x' || substr(sha256({key}), 1, 13))::bigint / 4503599627370496.0::double)"


@query("e18_scenarios", f"""with l as (select l_suppkey route, l_linenumber part, avg(l_discount) a, avg(l_discount) + avg(l_tax) b, sum(l_quantity) len from lineitem group by all), d as (select *, unnest(range(1, 21)) s from l),
    u as (select *, 0.6 * {_U.format(key="'scen|' || route || '|' || s")} + 0.4 * {_U.format(key="'scen|' || route || '|' || s || '|' || part")} u from d),
    t as (select route, s, sum(case when u < 0.5 then a / 2 + u * a when u < 0.9 then a + (u - 0.5) / 0.4 * (b - a) else least(1.5 * b, b + (u - 0.9) / 0.1 * (b - a)) end * len) t from u group by all), q as (select route, avg(t) mean, quantile_cont(t, 0.5) p50, quantile_cont(t, 0.9) p90, quantile_cont(t, 0.95) p95, avg((t > 900)::int) timeout from t group by 1)
    select route, round(mean, 5) mean, round(p50, 5) p50, round(q.p90, 5) p90, round(q.p95, 5) p95, timeout, round(avg(t), 5) cvar from q join t using (route) where t >= q.p90 - 1e-9 group by all""")
def _(spark, sf):
    l = _lines(spark, sf).groupBy(F.col("l_suppkey").alias("route"), F.col("l_linenumber").alias("part")).agg(F.avg("l_discount").alias("a"), (F.avg("l_discount") + F.avg("l_tax")).alias("b"), F.sum("l_quantity").alias("len"))
    q = scores.quantile_scenarios(l, "route", "part", "a", "b", "len", 20, "scen", 0.6, 900.0)
    return q.select("route", "timeout", *[F.round(c, 5).alias(c) for c in ("mean", "p50", "p90", "p95", "cvar")])


@query("e20_leakage", "select count(*) n, count(*) filter (l_shipdate >= o_orderdate + interval 60 day) late, 0::bigint untimed, 'l_tax' forbidden from lineitem join orders on o_orderkey = l_orderkey")
def _(spark, sf):
    rows = _lines(spark, sf).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("cutoff", F.col("o_orderdate") + F.expr("interval 60 days"))
    return scores.leakage(rows, "l_shipdate", "cutoff", ["l_tax", "l_discount"], ["l_tax", "o_totalprice"])


@query("e21_stability", f"with {_PRICE} select g, count(*) n, count(*) filter (x > 50000) above_50000, count(*) filter (x < t) crossed, round(max(abs(x - t)) / sum(abs(x - t)), 8) mae_share, round(max((x - t) ** 2) / sum((x - t) ** 2), 8) rmse_share from p group by 1")
def _(spark, sf):
    s = scores.stability(_priced(spark, sf), ["g"], "t", "x", [50_000.0])
    return s.select("g", "n", "above_50000", "crossed", F.round("mae_share", 8).alias("mae_share"), F.round("rmse_share", 8).alias("rmse_share"))


@query("e22_label_review", """with r as (select event_type, cast(ts as date) date, case when user_id % 9 > 0 then value end l, case when user_id % 9 = 0 then 'missing' when value > 100 then 'large' end reason from events), b as (select event_type, date, count(*) n, avg((l is not null)::int) available, avg(l) mean, stddev_samp(l) std, min(l) low, max(l) high from r group by all),
    m as (select event_type, date, reason from (select event_type, date, reason, count(*) c from r where reason is not null group by all) qualify row_number() over (partition by event_type, date order by c desc, reason) = 1)
    select event_type, date, n, round(available, 6) available, round(mean, 5) mean, round(std, 5) std, low, high, reason, round(mean - lag(mean) over (partition by event_type order by date), 5) drift from b left join m using (event_type, date)""")
def _(spark, sf):
    u = F.col("user_id") % 9
    r = events(spark, sf).withColumn("date", F.to_date("ts")).withColumn("l", F.when(u > 0, F.col("value"))).withColumn("reason", F.when(u == 0, "missing").when(F.col("value") > 100, "large"))
    v = scores.label_review(r, ["event_type", "date"], "l", "reason")
    return v.select("event_type", "date", "n", r6("available").alias("available"), *[F.round(c, 5).alias(c) for c in ("mean", "std", "drift")], "low", "high", "reason")


@query("t6_top_cells", "with s as (select floor(value / 5) cell, count(*) n from events group by 1) select cast(cell as bigint) cell, n from s qualify row_number() over (order by n desc, cell) <= ceil(0.1 * count(*) over ())")
def _(spark, sf):
    s = events(spark, sf).groupBy(F.floor(F.col("value") / 5).alias("cell")).agg(F.count("*").alias("n"))
    return scores.top_cells(s, "cell", "n", 0.1)


@query("e23_representativeness", """with a as (select floor(value / 10) c, count(*) n from events where event_type = 'view' group by 1), b as (select floor(value / 10) c, count(*) n from events where event_type = 'click' group by 1), p as (select c, n / sum(n) over () p from a), q as (select c, n / sum(n) over () q from b), u as (select c, coalesce(p, 0) p, coalesce(q, 0) q from p full join q using (c)),
    k as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 ra, rank() over (order by q) + (count(*) over (partition by q) - 1) / 2 rb from u), ta as (select c from p qualify row_number() over (order by p desc, c) <= ceil(0.1 * count(*) over ())), tb as (select c from q qualify row_number() over (order by q desc, c) <= ceil(0.1 * count(*) over ()))
    select round(sum(abs(p - q)) / 2, 6) total_variation, round(corr(ra, rb), 6) spearman, round((select count(*) from ta join tb using (c)) / (select count(*) from (select c from ta union select c from tb)), 6) top_jaccard from k""")
def _(spark, sf):
    e = events(spark, sf).withColumn("cell", F.floor(F.col("value") / 10))
    r = scores.representativeness(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "cell")
    return show(r, total_variation="total_variation", spearman="spearman", top_jaccard="top_jaccard")


@query("e24_ensemble_band", """with m as (select l_orderkey k, avg(l_discount) m, coalesce(stddev_samp(l_discount), 0) + 0.01 s, max(l_tax) y from lineitem group by 1), c as (select abs(y - m) / s e from m where k % 2 = 0), r as (select e, row_number() over (order by e) i, count(*) over () n from c), q as (select min(e) q from r where i >= least(n, ceil(round((n + 1) * 0.9, 9))))
    select round(q, 6) q, round(avg((y between greatest(m - q * s, 0) and m + q * s)::int), 6) coverage, round(avg(m + q * s - greatest(m - q * s, 0)), 6) width from m, q where k % 2 = 1 group by q""")
def _(spark, sf):
    l = _lines(spark, sf)
    return show(scores.ensemble_band(l.where("l_orderkey % 2 = 0"), l.where("l_orderkey % 2 = 1"), ["l_orderkey"], "l_tax", "l_discount", 0.01, 0.9), q="q", coverage="coverage", width="width")


@query("e27_blend", f"""with {_PRICE}, a as (select *, x * 0.8 a, x * 1.3 b from p), v as (select i / 20 alpha, round(avg(abs(i / 20 * a + (1 - i / 20) * b - t)), 9) m from a, range(0, 21) r(i) where l_orderkey % 2 = 0 group by 1), b as (select min({{'m': m, 'a': alpha}}) z from v)
    select b.z.a alpha, round(b.z.m, 4) validation_mae, round(avg(abs(b.z.a * a + (1 - b.z.a) * a.b - t)), 4) test_mae from a, b where l_orderkey % 2 = 1 group by all""")
def _(spark, sf):
    p = _priced(spark, sf).withColumn("a", F.col("x") * 0.8).withColumn("b", F.col("x") * 1.3)
    out = scores.blend(p.where("l_orderkey % 2 = 0"), p.where("l_orderkey % 2 = 1"), "t", "a", "b")
    return out.select("alpha", F.round("validation_mae", 4).alias("validation_mae"), F.round("test_mae", 4).alias("test_mae"))


@query("e29_monotonicity", """with d as (select least(floor(l_discount * 10), 9) + 1 decile, count(*) n, avg(l_quantity) m from lineitem group by 1), r as (select *, rank() over (order by decile) a, rank() over (order by m) b from d) select cast(decile as bigint) decile, n, round(m, 6) mean, round(corr(a, b) over (), 6) rank_correlation from r""")
def _(spark, sf):
    return show(scores.monotonicity(_lines(spark, sf), "l_discount", "l_quantity"), "decile", "n", mean="mean", rank_correlation="rank_correlation")


@query("e28_screening", """with t as (select l_orderkey k, avg(l_extendedprice) y, avg(l_quantity) s from lineitem group by 1), h as (select *, (y > avg(y) over ())::int hit, row_number() over (order by s desc, k) <= ceil(0.1 * count(*) over ()) top from t)
    select count(*) filter (top) k, round(avg(hit) filter (top), 6) as precision, round(sum(hit) filter (top) / sum(hit), 6) recall, round(avg(hit) filter (top) / avg(hit), 6) lift, round(sum(y) filter (top) / sum(y), 6) captured from h""")
def _(spark, sf):
    return show(scores.screening(_lines(spark, sf), "l_orderkey", "l_extendedprice", "l_quantity", 0.1), "k", precision="precision", recall="recall", lift="lift", captured="captured")


@query("m4_speed_posterior", """with t as (select event_type k, value v, [10.0::double, 30.0, 60.0, 120.0][user_id % 4 + 1] l from events where day(ts) <= 20), pr as (select k, l, count(*) c from t group by all), mu as (select avg(ln(v / l)) mu from t where v > 0), r as (select event_id, event_type k, value v from events where day(ts) > 20),
    s as (select event_id, g, round(ln(coalesce(c, 0) + 1) - coalesce((case when v > 0 then ln(v / g) end - mu) ** 2 / (2 * 0.25), 0), 9) s from r cross join mu, unnest([10.0::double, 30.0, 60.0, 120.0]) u(g) left join pr on pr.k = r.k and pr.l = g) select event_id, g as "limit" from s qualify row_number() over (partition by event_id order by s desc, g) = 1""")
def _(spark, sf):
    grid = [10.0, 30.0, 60.0, 120.0]
    e = events(spark, sf).withColumn("l", F.element_at(F.array(*map(F.lit, grid)), (F.col("user_id") % 4 + 1).cast("int")))
    return scores.speed_posterior(e.where(F.day("ts") <= 20), e.where(F.day("ts") > 20).drop("l"), "event_type", "value", "l", grid, 0.5, "event_id")


@query("e8_moments", "select event_type, count(value) n, round(avg(value), 5) mean, round(stddev_samp(value), 5) std, round(quantile_cont(value, 0.25), 5) q25, round(quantile_cont(value, 0.75), 5) q75, min(value) low, max(value) high from events group by 1")
def _(spark, sf):
    m = scores.moments(events(spark, sf), ["event_type"], "value")
    return m.select("event_type", "n", *[F.round(c, 5).alias(c) for c in ("mean", "std", "q25", "q75")], "low", "high")


# sets, scans, sinks and streams

@query("u1_u2_unions", "with a as (select l_suppkey s, l_partkey d from lineitem where l_returnflag = 'A'), r as (select l_suppkey s, l_partkey d from lineitem where l_returnflag = 'R') select (select count(*) from a) + (select count(*) from r) all_rows, count(*) distinct_rows from (select s, d from a union select s, d from r union select d, s from a)")
def _(spark, sf):
    a, r = (_lines(spark, sf).where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("d")) for f in "AR")
    both = a.unionByName(r)
    ways = both.union(a.select("d", "s")).distinct()
    return both.agg(F.count("*").alias("all_rows")).crossJoin(ways.agg(F.count("*").alias("distinct_rows")))  # one row each


@query("s1_s2_s6_product", "select user_id, event_id, value from events where strftime(ts, '%Y%m%d') in ('20240103', '20240117')")
def _(spark, sf):
    """Published by date, one day published again, and read back by date and column."""
    root = new_path(spark, "product")
    e = events(spark, sf).withColumn("date", F.date_format("ts", "yyyyMMdd"))
    io.publish(e.withColumn("value", F.when(F.col("date") == "20240103", 0.0).otherwise(F.col("value"))), root, ["date"])
    io.publish(e.where("date = '20240103'"), root, ["date"])
    return io.scan_product(spark, root, ["user_id", "event_id", "value"], ["20240103", "20240117"])


@query("s3_point_log", "select cast(user_id as varchar) driver_id, cast(event_id as varchar) order_id, case when event_id % 50 > 0 then epoch_us(ts) / 1e6 end as timestamp, value lon from events")
def _(spark, sf):
    path = new_path(spark, "points")
    t = F.when(F.col("event_id") % 50 > 0, (X.micros(F.col("ts")) / 1e6).cast("string")).otherwise("bad")
    events(spark, sf).select(F.col("user_id").cast("string").alias("a"), F.col("event_id").cast("string").alias("b"), t.alias("c"), F.col("value").alias("d"), F.lit(30.0).alias("e")).write.csv(path)
    return io.scan_points(spark, path).select("driver_id", "order_id", "timestamp", "lon")


@query("s4_s7_poi_csv", "select distinct round(value, 3) lon, 30.0::double lat, event_type category from events where value <= 180")
def _(spark, sf):
    path = new_path(spark, "pois")
    e = events(spark, sf).select(F.round("value", 3).alias("wgs_lon"), F.lit("30.0").alias("wgs_lat"), F.col("event_type").alias("type_name"))
    io.write_summary(e, path, "csv")
    return io.scan_pois(spark, path, {"lon": ["lon"], "lat": ["lat"], "category": ["type"]})


@query("s7_json_summary", "select event_type, count(*) n, round(sum(value), 4) total from events group by 1")
def _(spark, sf):
    path = new_path(spark, "summary")
    io.write_summary(events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), path, "json")
    return spark.read.schema("event_type string, n long, total double").json(path)


@query("r2_same_day", "select event_id from events where cast(ts as date) = cast(ts + to_microseconds(cast(floor(value * 60 * 1000000) as bigint)) as date)")
def _(spark, sf):
    from waymark.streaming import windows

    ends = F.timestamp_micros(X.micros(F.col("ts")) + F.floor(F.col("value") * 60 * 1_000_000))
    kept = windows.same_day(event_stream(spark, sf).withColumn("ends", ends), "ts", "ends").select("event_id")
    return windows.run_to_files(kept, "same-day")


@query("r3_streamed_gates", """with g as (select time_bucket(interval 15 minute, ts) w, count(*) n, count(*) filter (value >= 10) n1, count(*) filter (value >= 10 and event_type <> 'view') n2 from events group by 1)
    select epoch_us(w) // 1000000 window_start, n, n1, n2 from g where w + interval 15 minute <= (select max(ts) from events) - interval 1 hour""")
def _(spark, sf):
    from waymark.streaming import windows

    g = windows.gate_windows(event_stream(spark, sf), "ts", {"n1": F.col("value") >= 10, "n2": F.col("event_type") != "view"}, late="1 hour")
    return windows.run_to_files(g, "gates").select(F.unix_seconds("window_start").alias("window_start"), "n", "n1", "n2")


@query("r4_streamed_dedupe", "select distinct user_id, cast(floor(value) as bigint) v, epoch_us(ts) // 1000000 // 3600 h from events")
def _(spark, sf):
    """Identities within a watermark that spans the data, so every one is kept once."""
    from waymark.streaming import windows

    e = event_stream(spark, sf).withColumn("v", F.floor("value")).withColumn("h", F.floor(F.unix_seconds("ts") / 3600))
    return windows.run_to_files(windows.deduplicate(e, "ts", ["user_id", "v", "h"], "100 days").select("user_id", "v", "h"), "once")
