"""One query per operator family on the driver's tables, each with DuckDB SQL for the same rows.

Concepts: orders are trips, line items their route parts, events road observations per user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import exprs as X
from waymark.operators import causal, evaluate, joins, labels, quantiles, reports, sampling, sequence
from waymark.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def show(df: DataFrame, *columns: str, **rounded: str) -> DataFrame:
    """``columns`` as they are, and doubles rounded to 6 digits: out name = column."""
    return df.select(*columns, *[r6(c).alias(o) for o, c in rounded.items()])


ROUTE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
_ORDER = ", ".join(ROUTE_ORDER)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("w1_next_interval", """select event_id, round((epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6, 6) duration_s
    from events window w as (partition by user_id order by ts, event_id)""")
def _(spark, sf):
    return show(sequence.next_intervals(events(spark, sf), ["user_id"], "ts", "event_id"), "event_id", duration_s="duration_s")


def _spans(spark, sf):
    e = events(spark, sf)
    return e.withColumn("start_s", X.micros(F.col("ts")) / 1e6).withColumn("end_s", F.col("start_s") + F.col("value") * 60)


_SPANS = "(select *, epoch_us(ts) / 1e6 start_s, epoch_us(ts) / 1e6 + value * 60 end_s from events)"


@query("w3_sessions", f"""with m as (select *, max(end_s) over (partition by user_id order by start_s, event_id rows between unbounded preceding and 1 preceding) pe from {_SPANS}),
    s as (select *, sum(case when start_s - pe > 43200 then 1 else 0 end) over (partition by user_id order by start_s, event_id) session from m)
    select user_id, cast(session as bigint) as session, count(*) n, min(event_id) first_event, round(max(end_s) - min(start_s), 3) span_s from s group by all""")
def _(spark, sf):
    s = sequence.sessionize(_spans(spark, sf), "user_id", "start_s", "end_s", "event_id", 43_200)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.max("end_s") - F.min("start_s"), 3).alias("span_s"))


@query("w5_exclusive_sum", f"""select l_orderkey, cast(row_number() over w - 1 as bigint) as sequence, round(coalesce(sum(l_quantity) over (w rows between unbounded preceding and 1 preceding), 0), 6) earlier
    from lineitem window w as (partition by l_orderkey order by {_ORDER})""")
def _(spark, sf):
    rows = sequence.exclusive_sum(table(spark, sf, "lineitem"), ["l_orderkey"], ROUTE_ORDER, "l_quantity", "earlier")
    return show(sequence.positions(rows, ["l_orderkey"], ROUTE_ORDER), "l_orderkey", "sequence", earlier="earlier")


@query("w13_positions", f"""select l_orderkey, cast(row_number() over w - 1 as bigint) as sequence, count(*) over (partition by l_orderkey) link_count,
    round((row_number() over w - 1) / greatest(count(*) over (partition by l_orderkey) - 1, 1), 6) position_ratio
    from lineitem window w as (partition by l_orderkey order by {_ORDER})""")
def _(spark, sf):
    return show(sequence.positions(table(spark, sf, "lineitem"), ["l_orderkey"], ROUTE_ORDER), "l_orderkey", "sequence", "link_count", position_ratio="position_ratio")


@query("w14_longest_run", f"""with f as (select *, l_returnflag = 'R' flag, row_number() over (partition by l_orderkey order by {_ORDER}) rn from lineitem),
    g as (select *, rn - row_number() over (partition by l_orderkey, flag order by rn) grp from f),
    r as (select l_orderkey, grp, sum(l_quantity) w, count(*) n from g where flag group by all),
    b as (select l_orderkey, max({{'w': w, 'n': n}}) b from r group by 1)
    select o.l_orderkey, b.b.w run_weight, b.b.n run_rows from (select distinct l_orderkey from lineitem) o left join b using (l_orderkey)""")
def _(spark, sf):
    return sequence.longest_run(table(spark, sf, "lineitem"), ["l_orderkey"], ROUTE_ORDER, F.col("l_returnflag") == "R", "l_quantity")


@query("w7_local_median", """select event_id, round(case when count(value) over w >= 3 then quantile_cont(value, 0.5) over w end, 6) local_median
    from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)""")
def _(spark, sf):
    return show(sequence.centred_median(events(spark, sf), ["user_id"], ["ts", "event_id"], "value"), "event_id", local_median="local_median")


@query("w9_average_rank", """select event_id, rank() over w + (count(*) over (partition by event_type, value) - 1) / 2 avg_rank,
    round((rank() over w + (count(*) over (partition by event_type, value) - 1) / 2) / count(*) over (partition by event_type), 6) pct_rank
    from events window w as (partition by event_type order by value)""")
def _(spark, sf):
    return show(sequence.average_rank(events(spark, sf), ["event_type"], "value"), "event_id", "avg_rank", pct_rank="pct_rank")


@query("w15_share_of_total", """select l_orderkey, l_linenumber, l_partkey, round(l_quantity / sum(l_quantity) over (partition by l_orderkey), 6) share from lineitem""")
def _(spark, sf):
    return show(sequence.share_of_total(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", share="share")


@query("w17_quotas", """with t as (select o_orderpriority p, o_orderstatus s, count(*) n from orders group by all),
    e as (select *, n * 100.0::double / sum(n) over (partition by p) x from t),
    f as (select *, floor(x) fl, row_number() over (partition by p order by round(x - floor(x), 9) desc, s) rn from e)
    select p o_orderpriority, s o_orderstatus, cast(fl + case when rn <= 100 - sum(fl) over (partition by p) then 1 else 0 end as bigint) quota from f""")
def _(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("double").alias("n"))
    return sequence.largest_remainder(n, ["o_orderpriority"], "n", 100, "o_orderstatus").select("o_orderpriority", "o_orderstatus", "quota")


@query("w18_chunks", f"""with p as (select l_orderkey, row_number() over (partition by l_orderkey order by {_ORDER}) - 1 q, count(*) over (partition by l_orderkey) n from lineitem),
    o as (select distinct l_orderkey, greatest(n - 3, 0) last from p), c as (select distinct l_orderkey, s from (select l_orderkey, unnest(list_append(list_filter(range(0, last + 1, 2), lambda x: x <= last), last)) s from o)),
    j as (select p.l_orderkey, q, s from p join c on p.l_orderkey = c.l_orderkey and s <= q and q < s + 3)
    select l_orderkey, q as sequence, s as chunk_start, round(1.0 / count(*) over (partition by l_orderkey, q), 6)::double weight from j""")
def _(spark, sf):
    rows = sequence.positions(table(spark, sf, "lineitem"), ["l_orderkey"], ROUTE_ORDER)
    return show(sequence.overlapping_chunks(rows, ["l_orderkey"], "sequence", 3, 2), "l_orderkey", "sequence", "chunk_start", weight="weight")


@query("a55_allocation", f"""with p as (select l_orderkey, l_quantity w, row_number() over (partition by l_orderkey order by {_ORDER}) rn, count(*) over (partition by l_orderkey) n, sum(l_quantity) over (partition by l_orderkey) t from lineitem),
    a as (select p.*, o_totalprice x, o_totalprice * w / t part from p join orders on o_orderkey = l_orderkey)
    select l_orderkey, rn - 1 as sequence, cast(floor((case when rn = n then x - coalesce(sum(part) over (partition by l_orderkey order by rn rows between unbounded preceding and 1 preceding), 0) else part end + 0.00137) * 100) as bigint) allocated_cents from a""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    rows = sequence.positions(table(spark, sf, "lineitem"), ["l_orderkey"], ROUTE_ORDER).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return sequence.allocate(rows, ["l_orderkey"], ["sequence"], "o_totalprice", "l_quantity").select("l_orderkey", "sequence", F.floor((F.col("allocated") + 0.00137) * 100).alias("allocated_cents"))


_BIN = "case when value is null or isnan(value) then null when value < 0 then -1 when value > 300 then 30 else least(cast(floor(value / 10) as bigint), 29) end"


@query("a8_histogram", f"select event_type, cast({_BIN} as bigint) bin, count(*) n from events group by all")
def _(spark, sf):
    return quantiles.histogram(events(spark, sf), ["event_type"], "value", 0.0, 300.0, 30)


@query("a9_cohort_histograms", f"""with b as (select *, cast({_BIN} as bigint) bin from events)
    select level, key, bin, count(*) n from (select 'user' as level, cast(user_id as varchar) as key, bin from b union all select 'kind', event_type, bin from b union all select 'global', 'all', bin from b) group by all""")
def _(spark, sf):
    levels = {"user": F.col("user_id").cast("string"), "kind": F.col("event_type"), "global": F.lit("all")}
    return quantiles.multi_level(events(spark, sf), levels, "value", 0.0, 300.0, 30)


@query("a10_histogram_quantile", f"""with h as (select event_type, cast({_BIN} as bigint) bin, count(*) n from events group by all),
    r as (select *, sum(n) over (partition by event_type order by bin) u, sum(n) over (partition by event_type) t from h where bin between 0 and 29),
    f as (select event_type, min_by({{'bin': bin, 'n': n, 'u': u, 't': t}}, bin) b from r where u > 0.9 * (t - 1) group by 1)
    select event_type, round(10 * (b.bin + greatest(0, least(1, (0.9 * (b.t - 1) - (b.u - b.n) + 0.5) / b.n))), 6)::double "quantile", cast(b.t as bigint) support from f""")
def _(spark, sf):
    h = quantiles.histogram(events(spark, sf), ["event_type"], "value", 0.0, 300.0, 30)
    return show(quantiles.histogram_quantile(h, ["event_type"], 0.9, 0.0, 300.0, 30), "event_type", "support", quantile="quantile")


@query("a12_midrank_cdf", f"""with h as (select event_type, cast({_BIN} as bigint) bin, count(*) n from events group by all)
    select event_type, bin, n, round((sum(n) over (partition by event_type order by bin) - n / 2) / sum(n) over (partition by event_type), 6) cdf from h""")
def _(spark, sf):
    h = quantiles.histogram(events(spark, sf), ["event_type"], "value", 0.0, 300.0, 30)
    return show(quantiles.midrank_cdf(h, ["event_type"]), "event_type", "bin", "n", cdf="cdf")


@query("a13_ecdf", """with t as (select event_type, value from events where day(ts) <= 20), r as (select event_id, event_type, value from events where day(ts) > 20)
    select event_id, round((select count(*) from t where t.event_type = r.event_type and t.value <= r.value) / (select count(*) from t where t.event_type = r.event_type), 6) ecdf from r""")
def _(spark, sf):
    e = events(spark, sf)
    return show(quantiles.ecdf(e.where(F.day("ts") <= 20), e.where(F.day("ts") > 20), "event_type", "value"), "event_id", ecdf="ecdf")


@query("a15_weighted_quantile", """with c as (select l_orderkey, l_discount x, sum(l_quantity) over (partition by l_orderkey order by l_discount) c, sum(l_quantity) over (partition by l_orderkey) t from lineitem)
    select l_orderkey, min(case when c >= 0.9 * t - 1e-9 then x end) weighted_q from c group by 1""")
def _(spark, sf):
    return quantiles.weighted_quantile(table(spark, sf, "lineitem"), ["l_orderkey"], "l_discount", "l_quantity", 0.9)


@query("a14_weighted_mid_cdf", """with a as (select l_returnflag, l_discount, sum(l_quantity) w from lineitem group by all)
    select l_returnflag, l_discount, w, round((sum(w) over (partition by l_returnflag order by l_discount) - w / 2) / sum(w) over (partition by l_returnflag), 6) mid_cdf from a""")
def _(spark, sf):
    return show(quantiles.weighted_mid_cdf(table(spark, sf, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity"), "l_returnflag", "l_discount", "w", mid_cdf="mid_cdf")


@query("a16_exact_quantiles", """with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 i, count(*) over (partition by event_type) n from events)
    select event_type, round(quantile_cont(value, 0.85), 6) linear, round(min(case when (i + 1) / n >= 0.85 - 1e-12 then value end), 6) inverted_cdf,
    round(max(case when i = ceil(round(0.85 * (n - 1), 9)) then value end), 6) higher, round(max(case when i = round_even(0.85 * (n - 1), 0) then value end), 6) nearest, round(quantile_cont(value, 0.5), 6) median from r group by 1""")
def _(spark, sf):
    q = quantiles.exact_quantiles(events(spark, sf), ["event_type"], "value", 0.85)
    return show(q, "event_type", **{c: c for c in ("linear", "inverted_cdf", "higher", "nearest", "median")})


def _history(spark, sf):
    e = events(spark, sf)
    return e.where(F.col("event_type").isin("view", "click")), e.where("event_type = 'purchase'")


_EQ = "with e as (select * from events where event_type in ('view', 'click')), q as (select * from events where event_type = 'purchase')"


@query("j6_asof", _EQ + """ select q.event_id, round(max_by(e.value, {'t': e.ts, 'v': e.value}), 6) as value, round((epoch_us(any_value(q.ts)) - epoch_us(max(e.ts))) / 1e6, 6) age_s
    from q left join e on e.user_id = q.user_id and e.ts <= q.ts group by 1""")
def _(spark, sf):
    e, q = _history(spark, sf)
    return show(causal.asof(e, q, "user_id", "ts", "value", "event_id"), "event_id", value="value", age_s="age_s")


@query("j7_asof_tolerance", _EQ + """, a as (select q.event_id, max_by(e.value, {'t': e.ts, 'v': e.value}) v, (epoch_us(any_value(q.ts)) - epoch_us(max(e.ts))) / 1e6 age
    from q left join e on e.user_id = q.user_id and e.ts < q.ts group by 1) select event_id, round(case when age <= 21600 then v end, 6) as value, round(case when age <= 21600 then age end, 6) age_s from a""")
def _(spark, sf):
    e, q = _history(spark, sf)
    return show(causal.asof(e, q, "user_id", "ts", "value", "event_id", inclusive=False, max_age_s=21_600), "event_id", value="value", age_s="age_s")


_J8 = """ select q.event_id, round(avg(e.value) + 0.000000137, 6) mean, round(stddev_pop(e.value) + 0.000000137, 6) std, count(e.value) n, round((epoch_us(any_value(q.ts)) - epoch_us(max(e.ts))) / 1e6, 6) last_age_s
    from q left join e on e.user_id = q.user_id and e.ts < q.ts %s group by 1"""


@query("j8_window_history", _EQ + _J8 % "and epoch_us(e.ts) >= epoch_us(q.ts) - 259200000000")
def _(spark, sf):
    return show(causal.window_history(*_history(spark, sf), "user_id", "ts", "value", "event_id", 259_200), "event_id", "n", last_age_s="last_age_s", mean=F.col("mean") + 0.000000137, std=F.col("std") + 0.000000137  # off the grid of exact decimal ties
                )


@query("j9_all_history", _EQ + _J8 % "")
def _(spark, sf):
    return show(causal.window_history(*_history(spark, sf), "user_id", "ts", "value", "event_id", None), "event_id", "n", last_age_s="last_age_s", mean=F.col("mean") + 0.000000137, std=F.col("std") + 0.000000137  # off the grid of exact decimal ties
                )


@query("j11_hierarchical_lookup", """with t as (select * from events where day(ts) <= 20), r as (select * from events where day(ts) > 20),
    a as (select user_id, event_type, avg(value) m, count(*) n from t group by all), b as (select user_id, avg(value) m, count(*) n from t group by all), c as (select event_type, avg(value) m, count(*) n from t group by all), g as (select avg(value) m, count(*) n from t)
    select r.event_id, round(case when a.n >= 15 then a.m when b.n >= 15 then b.m when c.n >= 15 then c.m when g.n >= 15 then g.m end, 6) reference,
    case when a.n >= 15 then 'user_id_event_type' when b.n >= 15 then 'user_id' when c.n >= 15 then 'event_type' when g.n >= 15 then 'global' end as level
    from r left join a on a.user_id = r.user_id and a.event_type = r.event_type left join b on b.user_id = r.user_id left join c on c.event_type = r.event_type cross join g""")
def _(spark, sf):
    e = events(spark, sf)
    out = causal.hierarchical_lookup(e.where(F.day("ts") <= 20), e.where(F.day("ts") > 20), [["user_id", "event_type"], ["user_id"], ["event_type"], []], "value", 15)
    return show(out, "event_id", "level", reference="reference")


@query("w16_previous_days", """with d as (select event_type, cast(strftime(ts, '%Y%m%d') as varchar) date, sum(value) s, sum(value * value) ss, count(value) c from events group by all),
    r as (select event_type, date, sum(s) over w s, sum(ss) over w ss, sum(c) over w c from d window w as (partition by event_type order by date rows between 3 preceding and 1 preceding))
    select event_type, date, round(s / c, 6) mean, round(sqrt(greatest(ss - c * (s / c) * (s / c), 0) / nullif(c - 1, 0)), 4) std, cast(coalesce(c, 0) as bigint) n from r""")
def _(spark, sf):
    e = events(spark, sf).withColumn("date", F.date_format("ts", "yyyyMMdd"))
    return causal.previous_days(e, ["event_type"], "date", "value", 3).select("event_type", "date", r6("mean").alias("mean"), F.round("std", 4).alias("std"), "n")


@query("j2_reconcile", """with l as (select o_orderkey k, count(*) n from orders group by 1), r as (select l_orderkey k, count(*) n from lineitem group by 1)
    select count(*) filter (l.k is not null and r.k is not null and l.n = r.n) equal_rows, count(*) filter (l.k is not null and r.k is not null and l.n <> r.n) different,
    count(*) filter (r.k is null) left_only, count(*) filter (l.k is null) right_only from l full join r on l.k = r.k""")
def _(spark, sf):
    l = table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("n"))
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.reconcile(l, r, ["k"], ["n"])


@query("j3_orphans", "select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def _(spark, sf):
    return joins.orphans(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").where("l_returnflag = 'R'"), "o_orderkey", "l_orderkey")


@query("s8_key_violations", "select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1")
def _(spark, sf):
    return joins.key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("j12_interval_overlap", f"""select cast(b as bigint) bin, count(*) n, round(sum(least(end_s, b + 1800) - greatest(start_s, b)), 3) overlap_s from
    (select *, unnest(range(cast(floor(start_s / 1800) as bigint) * 1800, (greatest(cast(floor(start_s / 1800) as bigint), cast(ceil(end_s / 1800) as bigint) - 1) + 1) * 1800, 1800)) b from {_SPANS} where end_s > start_s) group by 1""")
def _(spark, sf):
    o = joins.overlap_bins(_spans(spark, sf), "start_s", "end_s", 1800)
    return o.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.sum("overlap_s"), 3).alias("overlap_s"))


@query("j13_adjacency", """with e as (select distinct c_nationkey s, s_nationkey d from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey),
    x as (select s * 1000 + d id, s, d from e)
    select distinct a.id upstream, b.id downstream from x a join x b on a.d = b.s where a.id <> b.id""")
def _(spark, sf):
    """Flows of goods between nations that follow each other."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_nationkey").alias("s"))
    l = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("d"))
    e = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("s", "d").distinct()
    return joins.adjacency(e.withColumn("id", F.col("s") * 1000 + F.col("d")), "s", "d", "id")


def _points(spark, sf):
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return p.where("id % 2 = 0"), p.where("id % 2 = 1")


_POINTS = "with p as (select vec_id id, embedding[1]::double x, embedding[2]::double y from embeddings), a as (select * from p where id % 2 = 0), b as (select * from p where id % 2 = 1)"


@query("j15_within_radius", _POINTS + " select a.id, b.id target, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) distance from a, b where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02")
def _(spark, sf):
    return show(joins.within_radius(*_points(spark, sf), 0.02), "id", "target", distance="distance")


@query("j16_nearest", _POINTS + """, d as (select a.id, b.id target, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) distance from a, b)
    select id, arg_min(target, {'d': distance, 't': target}) target, round(min(distance), 6) distance from d where distance <= 0.05 group by 1""")
def _(spark, sf):
    return show(joins.nearest(*_points(spark, sf), 0.05), "id", "target", distance="distance")


@query("j20_paired", """with a as (select o_custkey, sum(o_totalprice) v from orders where day(o_orderdate) % 2 = 0 group by 1), b as (select o_custkey, sum(o_totalprice) v from orders where day(o_orderdate) % 2 = 1 group by 1)
    select o_custkey, round(a.v, 4) value_a, round(b.v, 4) value_b, round(b.v - a.v, 4) delta from a join b using (o_custkey)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (o.where(F.day("o_orderdate") % 2 == i).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v")) for i in (0, 1))
    return joins.paired(a, b, "o_custkey", "v").select("o_custkey", *[F.round(c, 4).alias(c) for c in ("value_a", "value_b", "delta")])


@query("j19_common_support", "select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'N'")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return joins.common_support([li.where(F.col("l_returnflag") == f) for f in "RAN"], ["l_partkey"])


@query("u5_set_similarity", """with s as (select distinct o_orderpriority g, o_custkey i from orders), n as (select g, count(*) n, lead(g) over (order by g) o, lead(count(*)) over (order by g) m from s group by g),
    x as (select n.g, count(b.i) c from n join s a on a.g = n.g left join s b on b.g = n.o and b.i = a.i where n.o is not null group by 1)
    select n.g o_orderpriority, n.o other, x.c shared, round(x.c / (n + m - x.c), 6) jaccard, round(x.c / least(n, m), 6) overlap from n join x using (g)""")
def _(spark, sf):
    return show(joins.set_similarity(table(spark, sf, "orders"), "o_orderpriority", "o_custkey"), "o_orderpriority", "other", "shared", jaccard="jaccard", overlap="overlap")


def _visits(spark, sf):
    e = sequence.next_intervals(events(spark, sf).withColumn("date", F.date_format("ts", "yyyyMMdd")), ["user_id", "date"], "ts", "event_id").where("duration_s > 0")
    i = labels.label_intervals(e, ["user_id", "date"], ["ts", "event_id"], "value", "duration_s", 5.0, 40.0, 1.0)
    return labels.visits(i, ["user_id", "date", "event_type"], "value", "duration_s", 1, 60.0)


_VISITS = """i0 as (select *, strftime(ts, '%Y%m%d') date, (epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6 d from events window w as (partition by user_id, strftime(ts, '%Y%m%d') order by ts, event_id)),
    i1 as (select *, (d + lag(d) over w) / 2 gap, value - lag(value) over w dv from i0 where d > 0 window w as (partition by user_id, date order by ts, event_id)),
    v0 as (select user_id, date, event_type, count(*) n, sum(d) time_s, sum(value * d) / sum(d) m, sum(value * value * d) / sum(d) mm, sum(case when value <= 5 then d else 0 end) st, sum(case when value > 5 and value < 40 then d else 0 end) cr,
      sqrt(sum(case when abs(dv / gap) <= 1 then gap * (dv / gap) ** 2 end) / sum(case when abs(dv / gap) <= 1 then gap end)) rms from i1 group by all),
    v as (select user_id, date, event_type, n, time_s, m speed_mean, sqrt(greatest(mm - m * m, 0)) / nullif(m, 0) speed_cv, st / time_s stop_share, cr / time_s crawl_share, rms acceleration_rms, case when n < 1 then 'few_intervals' when time_s < 60 then 'short_time' when coalesce(m, 0) = 0 then 'no_speed' end reason from v0)"""


@query("a1_visits", f"with {_VISITS} select user_id, date, event_type, n, reason, round(time_s, 3) time_s, round(speed_mean, 6) speed_mean, round(speed_cv, 4) speed_cv, round(stop_share, 6) stop_share, round(crawl_share, 6) crawl_share, round(acceleration_rms, 6) acceleration_rms from v")
def _(spark, sf):
    v = _visits(spark, sf)
    return v.select("user_id", "date", "event_type", "n", "reason", F.round("time_s", 3).alias("time_s"), r6("speed_mean").alias("speed_mean"), F.round("speed_cv", 4).alias("speed_cv"),
                    *[r6(c).alias(c) for c in ("stop_share", "crawl_share", "acceleration_rms")])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which users' visits are slow against their cohort, how much of the time, and with how much evidence."""
    v = _visits(spark, sf).withColumn("pace", F.when(F.col("reason").isNull(), F.try_divide(F.lit(1.0), F.col("speed_mean"))))
    v = labels.leave_one_out_reference(v, [["user_id", "event_type"], ["event_type", "date"], ["event_type"], []], "pace", 5)
    t = labels.trip_summary(labels.excess_label(v, "pace"), ["user_id"], "slow_label", "time_s", 0.3, 0.5)
    return t.select("user_id", *[F.round(c, 5).alias(c) for c in ("coverage", "mean", "max", "tail_mean", "tail_share")])


_LEVELS = [("user_id, event_type", 5), ("event_type, date", 5), ("event_type", 5), ("", 1)]
_S = ", ".join(f"sum(pace) over (partition by {k or '1'}) s{i}, count(pace) over (partition by {k or '1'}) - (pace is not null)::int n{i}" for i, (k, _) in enumerate(_LEVELS))
_REF = "case " + " ".join(f"when n{i} >= {least} then (s{i} - coalesce(pace, 0)) / n{i}" for i, (_, least) in enumerate(_LEVELS)) + " end"
query("p12_trip_labels", f"""with {_VISITS}, p as (select *, case when reason is null then 1 / speed_mean end pace from v), r as (select *, {_S} from p),
    x as (select user_id, time_s w, greatest(pace / ({_REF}) - 1, 0) e, pace, {_REF} ref from r), y as (select user_id, w, case when pace is not null and ref is not null then e / (1 + e) end x from x),
    z as (select user_id, coalesce(sum(case when x is not null then w end) / sum(w), 0) c, sum(w * x) / sum(case when x is not null then w end) m, max(x) mx, sum(case when x >= 0.3 then w * x end) / sum(case when x >= 0.3 then w end) tm,
      coalesce(sum(case when x >= 0.3 then w end) / sum(case when x is not null then w end), 0) ts from y group by 1)
    select user_id, round(c, 5) coverage, round(case when c >= 0.5 then m end, 5) mean, round(case when c >= 0.5 then mx end, 5) max, round(case when c >= 0.5 then tm end, 5) tail_mean, round(case when c >= 0.5 then ts end, 5) tail_share from z""")(flagship)


_TRUTH = "t as (select doc_id, quality y, least(n_chars / 20000.0::double, 1) s, source from labels join documents using (doc_id))"


def _scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("s"), "source")


_PRICE = "p as (select l_returnflag g, l_orderkey, l_partkey, l_extendedprice t, l_quantity * p_retailprice x from lineitem join part on p_partkey = l_partkey)"


def _priced(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("g"), "l_orderkey", "l_partkey", F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * F.col("p_retailprice")).alias("x"))


@query("e1_regression", f"with {_PRICE} select g, count(*) n, round(avg(abs(x - t)), 4) mae, round(sqrt(avg((x - t) ** 2)), 4) rmse, round(avg(x - t), 4) bias, round(corr(t, x), 6) pearson from p group by 1")
def _(spark, sf):
    m = evaluate.regression(_priced(spark, sf), ["g"], "t", "x")
    return m.select("g", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias")], r6("pearson").alias("pearson"))


@query("e1_spearman", f"""with {_PRICE}, r as (select g, rank() over (partition by g order by t) + (count(*) over (partition by g, t) - 1) / 2 a, rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2 b from p)
    select g, round(corr(a, b), 6) spearman from r group by 1""")
def _(spark, sf):
    return show(evaluate.spearman(_priced(spark, sf), ["g"], "t", "x"), "g", spearman="spearman")


@query("e2_binary", f"""with {_TRUTH}, a as (select s, sum(y) p, count(*) c, sum((s - y) ** 2) b from t group by 1), r as (select *, sum(p) over (order by s desc) tp, sum(c) over (order by s desc) seen, c - p neg from a)
    select cast(sum(c) as bigint) n, cast(sum(p) as bigint) positives, round(sum(neg * (tp - p / 2)) / (sum(p) * sum(neg)), 6) auc, round(sum(p * tp / seen) / sum(p), 6) average_precision, round(sum(b) / sum(c), 6) brier from r""")
def _(spark, sf):
    return show(evaluate.binary(_scored(spark, sf), "y", "s"), "n", "positives", auc="auc", average_precision="average_precision", brier="brier")


_REL = "r as (select cast(least(floor(s * 15), 14) as bigint) bin, count(*) n, avg(s) ms, avg(y) mt from t group by 1)"


@query("e30_reliability", f"with {_TRUTH}, {_REL} select bin, n, round(ms, 6) mean_score, round(mt, 6) mean_truth from r")
def _(spark, sf):
    return show(evaluate.reliability(_scored(spark, sf), "y", "s"), "bin", "n", mean_score="mean_score", mean_truth="mean_truth")


@query("e3_calibration_error", f"with {_TRUTH}, {_REL} select round(sum(n * abs(ms - mt)) / sum(n), 6) ece from r")
def _(spark, sf):
    return show(evaluate.calibration_error(_scored(spark, sf), "y", "s"), ece="ece")


@query("e7_distribution_distance", f"""with b as (select day(ts) <= 20 early, cast({_BIN} as bigint) bin from events), p as (select bin, count(*)::double n from b where early group by 1), q as (select bin, count(*)::double n from b where not early group by 1),
    j as (select coalesce(p.n, 0) / (select sum(n) from p) p, coalesce(q.n, 0) / (select sum(n) from q) q from p full join q on p.bin = q.bin)
    select round(sum(abs(p - q)) / 2, 6) total_variation, round(sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2, 6) jensen_shannon,
    round(sum(least(p, q)), 6) shared_mass, round(count(*) filter (p > 0 and q > 0) / count(*), 6) jaccard from j""")
def _(spark, sf):
    e = events(spark, sf).withColumn("bin", F.least(F.floor(F.col("value") / 10), F.lit(29)))
    e = e.withColumn("bin", F.when(F.col("value") > 300, 30).when(F.col("value") < 0, -1).otherwise(F.col("bin")))
    d = evaluate.distribution_distance(e.where(F.day("ts") <= 20), e.where(F.day("ts") > 20), "bin")
    return show(d, **{c: c for c in ("total_variation", "jensen_shannon", "shared_mass", "jaccard")})


@query("e8_ks_distance", """with a as (select value, sum(case when day(ts) <= 20 then 1 else 0 end) x, sum(case when day(ts) > 20 then 1 else 0 end) y from events group by 1),
    r as (select sum(x) over (order by value) cx, sum(y) over (order by value) cy from a) select round(max(abs(cx / (select max(cx) from r) - cy / (select max(cy) from r))), 6) ks from r""")
def _(spark, sf):
    e = events(spark, sf)
    return show(evaluate.ks_distance(e.where(F.day("ts") <= 20), e.where(F.day("ts") > 20), "value"), ks="ks")


@query("e9_variance_shares", """with g as (select user_id, count(*) n, avg(value) m, var_pop(value) v from events group by 1), s as (select count(*) k, sum(n) nn, sum(n * n) n2, sum(n * v) w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) b from g),
    x as (select *, b / (k - 1) msb, w / (nn - k) msw, (nn - n2 / nn) / (k - 1) n0 from s) select round(b, 2) between_ss, round(w, 2) within_ss, round((msb - msw) / (msb + (n0 - 1) * msw), 6) icc from x""")
def _(spark, sf):
    v = evaluate.variance_shares(events(spark, sf), "user_id", "value")
    return v.select(F.round("between_ss", 2).alias("between_ss"), F.round("within_ss", 2).alias("within_ss"), r6("icc").alias("icc"))


@query("e11_split_conformal", f"""with {_PRICE}, c as (select abs(t - x) r from p where l_orderkey % 2 = 0), s as (select r, row_number() over (order by r) rn, count(*) over () n from c), q as (select min(r) q from s where rn >= ceil(round(0.9 * (n - 1), 9)) + 1)
    select round(q, 4) q, round(avg((t between greatest(x - q, 0) and x + q)::int), 6) coverage, round(avg(x + q - greatest(x - q, 0)), 4) width from p, q where l_orderkey % 2 = 1 group by q""")
def _(spark, sf):
    p = _priced(spark, sf)
    c = evaluate.split_conformal(p.where("l_orderkey % 2 = 0"), p.where("l_orderkey % 2 = 1"), "t", "x")
    return c.select(F.round("q", 4).alias("q"), r6("coverage").alias("coverage"), F.round("width", 4).alias("width"))


@query("t5_top_fraction", f"""with {_TRUTH}, k as (select ceil(count(*) * 0.1) k, count(*) n, sum(y) p from t), h as (select sum(y) h from (select y, row_number() over (order by s desc, doc_id) rn from t) where rn <= (select k from k))
    select cast(k as bigint) k, round(h / k, 6) "precision", round(h / p, 6) recall, round(h / k / (p / n), 6) lift from h, k""")
def _(spark, sf):
    return show(evaluate.top_fraction(_scored(spark, sf), "y", "s", "doc_id", 0.1), "k", precision="precision", recall="recall", lift="lift")


_U = "((('0x' || substr(sha256('%s|' || %s), 1, 13))::bigint) / 4503599627370496.0)"


@query("t1_hash_sample", """with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by sha256('s1|' || o_orderkey), o_orderkey) rn, count(*) over (partition by o_orderpriority) n from orders)
    select o_orderkey, o_orderpriority, cast(rn as int) rank, round(least(1, 20 / n), 6)::double probability, round(1 / least(1, 20 / n), 6)::double design_weight from r where rn <= 20""")
def _(spark, sf):
    s = sampling.hash_sample(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", "s1", 20)
    return show(s, "o_orderkey", "o_orderpriority", "rank", probability="probability", design_weight="design_weight")


@query("t2_thinning", f"select o_orderkey, o_custkey from orders where {_U % ('s2', 'o_custkey')} < 0.25")
def _(spark, sf):
    return sampling.thin(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "s2", 0.25)


@query("t3_proportional_sample", """with r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by sha256('s3|' || o_orderkey), o_orderkey) rn, count(*) over (partition by o_orderstatus) n from orders)
    select o_orderkey, o_orderstatus from r where rn <= floor(n * 0.05 + 0.5)""")
def _(spark, sf):
    return sampling.proportional_sample(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", "s3", 0.05)


@query("t4_top_k", "select user_id, event_id, value, cast(rn as int) rank from (select *, row_number() over (partition by user_id order by value desc, event_id) rn from events) where rn <= 3")
def _(spark, sf):
    return sampling.top_k(events(spark, sf).select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3)


@query("t7_folds", """with h as (select c_custkey, sha256('f|' || c_custkey) h from customer)
    select c_custkey, cast(list_reduce(list_prepend(0::bigint, [('0x' || substr(h, 1 + 8 * i, 8))::bigint for i in range(8)]), lambda a, g: (a * (4294967296 % 5) + g) % 5) as bigint) fold from h""")
def _(spark, sf):
    return sampling.folds(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "f", 5)


@query("f5_local_calendar", """with l as (select event_id, ts + interval 8 hour t from events)
    select event_id, cast(floor((hour(t) * 60 + minute(t)) / 30) as bigint) time_bin, case when dayofweek(t) in (0, 6) then 'weekend' else 'weekday' end weekday_type,
    dayofweek(t) not in (0, 6) and (hour(t) between 7 and 8 or hour(t) between 17 and 18) peak, strftime(t, '%Y%m%d') date from l""")
def _(spark, sf):
    return events(spark, sf).select("event_id", *[c.alias(n) for n, c in X.local_calendar(F.col("ts")).items()])


@query("f15_buckets", "select l_orderkey, l_linenumber, l_partkey, cast(case when l_quantity <= 5 then 0 when l_quantity <= 15 then 1 when l_quantity <= 30 then 2 else 3 end as bigint) bucket from lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.right_closed_bucket(F.col("l_quantity"), [5, 15, 30]).alias("bucket"))


_RULES = [("low_value", "o_totalprice < 50000"), ("old", "year(o_orderdate) < 1994"), ("open", "o_orderstatus = 'O'")]


@query("p4_reasons", "select o_orderkey, " + "case " + " ".join(f"when {c} then '{n}'" for n, c in _RULES) + " end first_reason, array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in _RULES) + "], lambda x: x is not null), '|') reasons from orders")
def _(spark, sf):
    rules = [(n, F.expr(c)) for n, c in _RULES]
    return table(spark, sf, "orders").select("o_orderkey", X.first_reason(rules).alias("first_reason"), F.array_join(X.all_reasons(rules), "|").alias("reasons"))


@query("a36_reason_counts", "select reason, count(*) n from (select unnest(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in _RULES) + "], lambda x: x is not null)) reason from orders) group by 1")
def _(spark, sf):
    return table(spark, sf, "orders").select(F.explode(X.all_reasons([(n, F.expr(c)) for n, c in _RULES])).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("p21_acceptance", f"select o_orderkey, {_U % ('42', 'o_orderkey')} <= 0.7 accepted from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (X.hash_uniform(42, F.col("o_orderkey")) <= 0.7).alias("accepted"))


@query("f2_haversine", """with p as (select vec_id, embedding[1]::double + 114 x, embedding[2]::double + 30 y, embedding[3]::double + 114 x2, embedding[4]::double + 30 y2 from embeddings)
    select vec_id, round(2 * 6371000 * asin(sqrt(least(1, sin(radians(y2 - y) / 2) ** 2 + cos(radians(y)) * cos(radians(y2)) * sin(radians(x2 - x) / 2) ** 2))), 3) metres from p""")
def _(spark, sf):
    e = [F.col("embedding")[i].cast("double") + o for i, o in enumerate((114, 30, 114, 30))]
    return table(spark, sf, "embeddings").select("vec_id", F.round(X.haversine_m(*e), 3).alias("metres"))


@query("a49_grid_shares", """with c as (select floor(embedding[1]::double / 0.05)::bigint || '_' || floor(embedding[2]::double / 0.05)::bigint cell from embeddings) select cell, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from c group by 1""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(X.grid_cell(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), 0.05).alias("cell"))
    return show(sequence.share_of_total(e.groupBy("cell").agg(F.count("*").alias("n")), [], "n"), "cell", "n", share="share")


@query("s10_split_roles", "select event_id, case when day(ts) <= 20 then 'train' when day(ts) between 21 and 25 then 'validation' when day(ts) between 26 and 30 then 'test' end as role from events")
def _(spark, sf):
    return events(spark, sf).select("event_id", io.split_role(F.day("ts"), (1, 20), (21, 25), (26, 30)).alias("role"))


@query("s5_buckets", "select l_orderkey, cast(('0x' || substr(sha256(cast(l_orderkey as varchar)), 1, 12))::bigint % 16 as bigint) bucket, count(*) n from lineitem group by all")
def _(spark, sf):
    return io.bucketed(table(spark, sf, "lineitem"), "l_orderkey", 16).groupBy("l_orderkey", "bucket").agg(F.count("*").alias("n"))


@query("s9_content_digest", "select count(*) n, cast(sum(('0x' || substr(sha256(c_custkey || chr(31) || c_name || chr(31) || c_mktsegment), 1, 13))::bigint) as varchar) digest from customer")
def _(spark, sf):
    return io.content_digest(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("a27_two_stage_mean", """with a as (select user_id, event_type, time_bucket(interval 30 minute, ts) w, avg(value) m, count(*) n from events group by all)
    select event_type, cast(epoch_us(w) / 1000000 as bigint) window_start, round(avg(m), 6) mean, count(*) users, cast(sum(n) as bigint) n from a group by all""")
def _(spark, sf):
    a = events(spark, sf).groupBy("user_id", "event_type", F.window("ts", "30 minutes").alias("w")).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return a.groupBy("event_type", F.unix_seconds("w.start").alias("window_start")).agg(r6(F.avg("m")).alias("mean"), F.count("*").alias("users"), F.sum("n").alias("n"))


@query("a42_transitions", """with l as (select user_id, event_type a, lead(event_type) over (partition by user_id order by ts, event_id) b from events)
    select a, b, n, round(n / sum(n) over (partition by a), 6) share from (select a, b, count(*) n from l where b is not null group by all)""")
def _(spark, sf):
    from pyspark.sql import Window

    e = events(spark, sf).withColumn("b", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("b is not null")
    return show(sequence.share_of_total(e.groupBy(F.col("event_type").alias("a"), "b").agg(F.count("*").alias("n")), ["a"], "n"), "a", "b", "n", share="share")


@query("g1_components", """with recursive e as (select distinct 2 * o_custkey s, 2 * cast(floor(o_totalprice) as bigint) + 1 d from orders), b as (select s, d from e union select d, s from e),
    r(n, m) as (select s, s from b union select b.d, r.m from r join b on b.s = r.n)
    select n node, min(m) component from r group by 1""")
def _(spark, sf):
    """Customers with an order of the same price, to the unit, belong together."""
    from waymark.plans.components import connected_components

    return connected_components(table(spark, sf, "orders").select((2 * F.col("o_custkey")).alias("src"), (2 * F.floor("o_totalprice") + 1).alias("dst")))


@query("g2_node_degrees", "with e as (select distinct l_suppkey s, l_partkey d from lineitem) select d node, count(*) degree_in from e group by 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("degree_in"))


@query("a21_known_share", """select l_orderkey, round(sum(case when l_returnflag = 'R' then l_quantity else 0 end) filter (l_returnflag <> 'N') / sum(case when l_returnflag <> 'N' then l_quantity end), 6) share from lineitem group by 1""")
def _(spark, sf):
    known = F.col("l_returnflag") != "N"
    share = F.try_divide(F.sum(F.when(known, F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))), F.sum(F.when(known, F.col("l_quantity"))))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(r6(share).alias("share"))


@query("a22_entropy", """with g as (select l_orderkey, p_brand, sum(l_quantity) q from lineitem join part on p_partkey = l_partkey group by all), s as (select l_orderkey, q / sum(q) over (partition by l_orderkey) p from g)
    select l_orderkey, round(-sum(p * ln(p)), 6) + 0.0 entropy from s group by 1""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    g = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "p_brand").agg(F.sum("l_quantity").alias("q"))
    s = sequence.share_of_total(g, ["l_orderkey"], "q")
    return s.groupBy("l_orderkey").agg((F.round(-F.sum(F.col("share") * F.log("share")), 6) + 0.0).alias("entropy"))


@query("a53_crosstab", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') f, count(*) filter (o_orderstatus = 'O') o, count(*) filter (o_orderstatus = 'P') p from orders group by 1")
def _(spark, sf):
    t = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return t.select("o_orderpriority", *[F.col(c).alias(c.lower()) for c in "FOP"])


@query("m1_class_means", f"""with {_PRICE}, t as (select * from p where l_orderkey % 2 = 0), m as (select g, avg(t) m from t group by 1)
    select l_orderkey, l_partkey, x, round((select avg(t) from t), 4) constant, round(coalesce(m.m, (select avg(t) from t)), 4) class_mean from p left join m using (g) where l_orderkey % 2 = 1""")
def _(spark, sf):
    from waymark.operators import ml

    p = _priced(spark, sf)
    out = ml.class_means(p.where("l_orderkey % 2 = 0"), p.where("l_orderkey % 2 = 1"), "g", "t")
    return out.select("l_orderkey", "l_partkey", "x", F.round("constant", 4).alias("constant"), F.round("class_mean", 4).alias("class_mean"))


@query("m1_boosted_trees")
def _(spark, sf):
    from waymark.operators import ml

    p = _priced(spark, sf)
    model = ml.fit_trees(p.where("l_orderkey % 2 = 0"), ["g"], ["x"], "t")
    return model.transform(p.where("l_orderkey % 2 = 1")).select("l_orderkey", "l_partkey", "t", "prediction")


@query("m2_calibration")
def _(spark, sf):
    from waymark.operators import ml

    s = _scored(spark, sf)
    return ml.calibrate(s.where("doc_id % 2 = 0"), s.where("doc_id % 2 = 1"), "y", "s").select("doc_id", "y", "s", "platt", "isotonic", "calibrated")


@query("m6_shrunk_means", """with u as (select user_id, avg(value) m, count(*) n from events group by 1), g as (select avg(value) m from events)
    select user_id, n, round(n / (n + 20.0) * u.m + (1 - n / (n + 20.0)) * g.m, 6) shrunk from u, g""")
def _(spark, sf):
    from waymark.operators import ml

    e = events(spark, sf)
    u = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n")).crossJoin(e.agg(F.avg("value").alias("g")))  # one row
    return u.select("user_id", "n", r6(ml.shrink(F.col("m"), F.col("g"), F.col("n"), 20.0)).alias("shrunk"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query("r1_streamed_cells", """with c as (select time_bucket(interval 30 minute, ts) w, event_type, count(*) n, sum(value) total, count(value) valid from events group by all)
    select epoch_us(w) // 1000000 window_start, event_type, n, round(total, 4) total, valid from c where w + interval 30 minute <= (select max(ts) from events) - interval 1 hour""")
def _(spark, sf):
    """Cells that the watermark has closed, appended to files."""
    from waymark.streaming import windows

    cells = windows.run_to_files(windows.state_cells(event_stream(spark, sf), "ts", ["event_type"], "value", late="1 hour"), "cells")
    return cells.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"), "valid")


@query("a38_gates", """with g as (select time_bucket(interval 15 minute, ts) w, count(*) n0, count(*) filter (value >= 10) n1, count(*) filter (value >= 10 and event_type <> 'view') n2, count(*) filter (value >= 10 and event_type = 'purchase') n3 from events group by 1)
    select epoch_us(w) // 1000000 window_start, n0, n1, n2, n3, round(n1 / n0, 6) kept_1, case when n1 > 0 then round(n2 / n1, 6) end kept_2, case when n2 > 0 then round(n3 / n2, 6) end kept_3 from g""")
def _(spark, sf):
    a, b, c = F.col("value") >= 10, F.col("event_type") != "view", F.col("event_type") == "purchase"
    g = events(spark, sf).groupBy(F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n0"), F.count_if(a).alias("n1"), F.count_if(a & b).alias("n2"), F.count_if(a & c).alias("n3"))
    return g.select(F.unix_seconds("w.start").alias("window_start"), "n0", "n1", "n2", "n3", *[r6(F.try_divide(F.col(f"n{i}"), F.col(f"n{i - 1}"))).alias(f"kept_{i}") for i in (1, 2, 3)])


@query("a39_time_of_day", """with b as (select unnest(range(48)) time_bin), c as (select (hour(ts) * 60 + minute(ts)) // 30 time_bin, count(*) n, count(distinct user_id) users from events group by 1)
    select cast(b.time_bin as bigint) time_bin, coalesce(n, 0) n, coalesce(users, 0) users, round(coalesce(n, 0) / sum(n) over (), 6) share from b left join c using (time_bin)""")
def _(spark, sf):
    c = events(spark, sf).groupBy(F.expr("(hour(ts) * 60 + minute(ts)) div 30").alias("time_bin")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    dense = spark.range(48).withColumnRenamed("id", "time_bin").join(c, "time_bin", "left").na.fill(0)  # a fixed day grid
    return show(sequence.share_of_total(dense, [], "n"), "time_bin", "n", "users", share="share")


@query("a18_support_counts", """select case when grouping(user_id) = 0 then 'user' when grouping(event_type) = 0 then 'kind_hour' else 'hour' end as scope, user_id, event_type, hour, count(*) n
    from (select user_id, event_type, cast(hour(ts) as int) as hour from events) group by grouping sets ((user_id, hour), (event_type, hour), (hour))""")
def _(spark, sf):
    e = events(spark, sf).withColumn("hour", F.hour("ts"))
    g = e.groupingSets([[F.col("user_id"), F.col("hour")], [F.col("event_type"), F.col("hour")], [F.col("hour")]], "user_id", "event_type", "hour").agg(
        F.when(F.grouping("user_id") == 0, "user").when(F.grouping("event_type") == 0, "kind_hour").otherwise("hour").alias("scope"), F.count("*").alias("n"))
    return g.select("scope", "user_id", "event_type", "hour", "n")


@query("a29_profile_stats", """select event_type, day(ts) as "day", count(*) n, round(avg(value), 6) mean, round(stddev_samp(value), 6) std, round(quantile_cont(value, 0.5), 6) q50, round(quantile_cont(value, 0.75), 6) q75,
    round(quantile_cont(value, 0.9), 6) q90, round(avg((value >= 100)::int), 6) tail_rate from events group by all""")
def _(spark, sf):
    v = F.col("value")
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    return events(spark, sf).withColumn("day", F.day("ts").cast("bigint")).groupBy("event_type", "day").agg(
        F.count("*").alias("n"), r6(F.avg(v)).alias("mean"), r6(F.stddev_samp(v)).alias("std"), q.alias("q"), r6(F.avg((v >= 100).cast("int"))).alias("tail_rate")).select(
        "event_type", "day", "n", "mean", "std", *[r6(F.col("q")[i]).alias(c) for i, c in enumerate(("q50", "q75", "q90"))], "tail_rate")


@query("a33_mode", "select event_type, arg_max(v, {'n': n, 'v': -v}) as mode from (select event_type, cast(floor(value) as bigint) v, count(*) n from events group by all) group by 1")
def _(spark, sf):
    c = events(spark, sf).groupBy("event_type", F.floor("value").alias("v")).agg(F.count("*").alias("n"))
    return c.groupBy("event_type").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))


@query("a7_trip_ends", """select user_id, count(*) n, arg_min(event_type, {'t': ts, 'e': event_id}) first_type, arg_max(event_type, {'t': ts, 'e': event_id}) last_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) span_s from events group by 1""")
def _(spark, sf):
    at = F.struct("ts", "event_id")
    return events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"),
                                                    F.round((X.micros(F.max("ts")) - X.micros(F.min("ts"))) / 1e6, 3).alias("span_s"))


@query("a23_change_rate", f"""with l as (select l_orderkey, l_returnflag <> lag(l_returnflag) over (partition by l_orderkey order by {_ORDER}) c from lineitem) select l_orderkey, round(avg(c::int), 6) change_rate from l group by 1""")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(*ROUTE_ORDER)
    c = table(spark, sf, "lineitem").withColumn("c", (F.col("l_returnflag") != F.lag("l_returnflag").over(w)).cast("int"))
    return c.groupBy("l_orderkey").agg(r6(F.avg("c")).alias("change_rate"))


@query("e16_inverse_propensity", f"""with {_TRUTH}, w as (select (select avg(y) from t) / greatest(s, 0.05) r from t where y = 1) select round(sum(least(r, 5)) ** 2 / sum(least(r, 5) ** 2), 4) ess, round(max(least(r, 5)), 6) max_weight, count(*) filter (r > 5) clipped from w""")
def _(spark, sf):
    s = _scored(spark, sf).withColumn("seen", F.col("y") == 1)
    return evaluate.inverse_propensity(s, "seen", "s", 0.05, 5.0).select(F.round("ess", 4).alias("ess"), r6("max_weight").alias("max_weight"), "clipped")


@query("p15_traffic_state", """with c as (select user_id, avg(value) / 60 r, avg((value >= 100)::int) s, count(*) n from events group by 1)
    select user_id, case when n < 30 then 'UNKNOWN' when r >= 2 and s >= 0.5 then 'SEVERE' when r >= 1.3 and s >= 0.3 then 'CONGESTED' when r < 1.3 and s < 0.3 then 'NON' else 'MIXED' end state from c""")
def _(spark, sf):
    c = events(spark, sf).groupBy("user_id").agg((F.avg("value") / 60).alias("r"), F.avg((F.col("value") >= 100).cast("int")).alias("s"), F.count("*").alias("n"))
    return c.select("user_id", reports.traffic_state(F.col("r"), F.col("s"), F.col("n"), 30).alias("state"))


@query("a43_residual_quantiles", """with r as (select event_type, cast(hour(ts) as int) as hour, value - 50 v from events)
    select event_type, hour, grouping(event_type, hour)::bigint gid, round(quantile_cont(v, 0.9), 6) q, count(v) n from r group by grouping sets ((event_type, hour), (event_type), ())""")
def _(spark, sf):
    e = events(spark, sf).select("event_type", F.hour("ts").alias("hour"), (F.col("value") - 50).alias("v"))
    return show(reports.residual_quantiles(e, [["event_type", "hour"], ["event_type"], []], "v", 0.9), "event_type", "hour", "gid", "n", q="q")


@query("a20_support_groups", """with c as (select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by 1), q as (select quantile_cont(n, 0.25) a, quantile_cont(n, 0.75) b from c where n > 0)
    select c_custkey, n, case when n <= 0 then 'unseen' when n <= a then 'low' when n <= b then 'medium' else 'high' end support_group from c, q""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return reports.support_groups(c, "n")


@query("a45_conservation", """with s as (select l_orderkey k, sum(l_quantity) p from lineitem group by 1), t as (select o_orderkey k, 100.0::double t from orders), j as (select abs(coalesce(p, 0) - coalesce(t, 0)) d from s full join t using (k))
    select count(*) keys, count(*) filter (d > 50) violations, max(d) largest from j""")
def _(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(100.0).alias("t"))
    return reports.conservation(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k"), t, ["k"], "l_quantity", "t", 50.0)


@query("a57_duration_audit", """with d as (select 'ship' as name, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 d from lineitem join orders on o_orderkey = l_orderkey)
    select name, count(*) n, count(*) filter (d < 0) negative, count(*) filter (d = 0) zero, count(*) filter (d > 5184000) "over", round(median(d), 3) median from d group by 1""")
def _(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    a = reports.duration_audit(j, {"ship": (X.micros(F.col("o_orderdate")) / 1e6, X.micros(F.col("l_shipdate")) / 1e6)}, 5_184_000.0)
    return a.select("name", "n", "negative", "zero", "over", F.round("median", 3).alias("median"))


@query("e15_against_baseline", """with s as (select event_type, avg(value) m, count(*)::double n from events group by 1), b as (select m, n from s where event_type = 'view')
    select event_type, round(s.m, 6) m, s.n, round(s.m / b.m - 1, 6) m_change, round(s.n / b.n - 1, 6) n_change from s, b""")
def _(spark, sf):
    s = events(spark, sf).groupBy("event_type").agg(F.avg("value").alias("m"), F.count("*").cast("double").alias("n"))
    return show(reports.against_baseline(s, "event_type", "view", ["m", "n"]), "event_type", "n", m="m", m_change="m_change", n_change="n_change")


@query("a68_waterfall", """with k as (select distinct o_orderkey k from orders), a as (select distinct l_orderkey k from lineitem where l_returnflag = 'R'), b as (select distinct l_orderkey k from lineitem where l_linestatus = 'O')
    select count(*) as start, count(a.k) returned, count(case when a.k is not null and b.k is not null then 1 end) open from k left join a using (k) left join b using (k)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    return reports.waterfall(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k", [("returned", li.where("l_returnflag = 'R'")), ("open", li.where("l_linestatus = 'O'"))])


@query("a66_failures", """with f as (select (not coalesce(o_totalprice >= 50000, false))::int price, (not coalesce(o_orderstatus = 'F', false))::int done, (not coalesce(o_orderpriority <> '5-LOW', false))::int priority from orders),
    x as (select unnest(['price', 'done', 'priority']) condition, unnest([price, done, priority]) f, price + done + priority n from f)
    select condition, sum(f)::bigint failures, count(*) filter (f = 1 and n = 1) only_cause, count(*) filter (f = 1 and n > 1) joint, count(*) filter (n = 0) pass_all from x group by 1""")
def _(spark, sf):
    return reports.failure_decomposition(table(spark, sf, "orders"), {
        "price": F.col("o_totalprice") >= 50000, "done": F.col("o_orderstatus") == "F", "priority": F.col("o_orderpriority") != "5-LOW"})


@query("e4_two_part", f"""with {_PRICE}, q as (select g, greatest(t - 30000, 0) t, greatest(x - 30000, 0) x from p) select g, round(avg((t > 0)::int), 6) positive_share, round(avg(case when t > 0 then abs(x - t) end), 3) positive_mae, round(avg(abs(x - t)), 3) mae, round(avg(abs(t)), 3) zero_mae from q group by 1""")
def _(spark, sf):
    q = _priced(spark, sf).select("g", F.greatest(F.col("t") - 30000, F.lit(0.0)).alias("t"), F.greatest(F.col("x") - 30000, F.lit(0.0)).alias("x"))
    m = reports.two_part(q, ["g"], "t", "x")
    return m.select("g", r6("positive_share").alias("positive_share"), *[F.round(c, 3).alias(c) for c in ("positive_mae", "mae", "zero_mae")])


@query("e6_cluster_bootstrap")
def _(spark, sf):
    return reports.cluster_bootstrap(events(spark, sf), "user_id", "value", 200, "boot")


@query("e19_crps", """with s as (select e.user_id, e.value x, t.y from events e join (select user_id, max_by(value, event_id) y from events group by 1) t using (user_id)),
    r as (select *, row_number() over (partition by user_id order by x) i, count(*) over (partition by user_id) n from s)
    select user_id, round(avg(abs(x - y)) - sum((2 * i - n - 1) * x) / max(n * n), 6) crps, max(y) between quantile_cont(x, 0.05) and quantile_cont(x, 0.95) covered from r group by 1""")
def _(spark, sf):
    e = events(spark, sf)
    y = e.groupBy("user_id").agg(F.max_by("value", "event_id").alias("y"))
    return show(reports.crps(e.join(y, "user_id"), ["user_id"], "value", "y"), "user_id", "covered", crps="crps")


@query("e25_quantile_map", """with x as (select event_id, value, row_number() over (order by value, event_id) - 1 i, count(*) over () n from events where event_type = 'view'), r as (select value r, row_number() over (order by value) - 1 j, count(*) over () m from events where event_type = 'click'),
    a as (select event_id, value, i / (n - 1) * ((select max(m) from r) - 1) p from x) select event_id, value, round(lo.r + (hi.r - lo.r) * (p - floor(p)), 6) mapped from a join r lo on lo.j = floor(p) join r hi on hi.j = ceil(p)""")
def _(spark, sf):
    e = events(spark, sf)
    return show(reports.quantile_map(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "event_id", "value", "value"), "event_id", "value", mapped="mapped")


@query("e14_interaction", """with m as (select event_id % 2 a, (user_id % 2) b, avg(value) m from events group by all), p as (select max(m) filter (a = 0 and b = 0) m00, max(m) filter (a = 0 and b = 1) m01, max(m) filter (a = 1 and b = 0) m10, max(m) filter (a = 1 and b = 1) m11 from m)
    select round(m00, 6) m00, round(m01, 6) m01, round(m10, 6) m10, round(m11, 6) m11, round((m11 - m10) - (m01 - m00), 6) did from p""")
def _(spark, sf):
    e = events(spark, sf).withColumn("a", F.col("event_id") % 2).withColumn("b", F.col("user_id") % 2)
    return show(reports.did(e, "a", "b", "value"), **{c: c for c in ("m00", "m01", "m10", "m11", "did")})


@query("f12_sequence_overlap", """with recursive s as (select user_id, cast(ts as date) as date, list(event_type order by ts, event_id) b from events group by all), p as (select *, lag(b) over (partition by user_id order by date) a from s),
    d(user_id, date, a, b, i, row) as (select user_id, date, a, b, 0, list_transform(range(len(b) + 1), lambda x: 0::bigint) from p where a is not null
        union all select user_id, date, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k: case when k > 0 and b[k] = a[i + 1] then greatest(row[k + 1], row[k] + 1) else row[k + 1] end))) from d where i < len(a))
    select user_id, date, round(row[len(b) + 1] / len(b), 6) overlap from d where i = len(a)""")
def _(spark, sf):
    from pyspark.sql import Window

    s = events(spark, sf).withColumn("date", F.to_date("ts")).groupBy("user_id", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))  # a user's day
    w = Window.partitionBy("user_id").orderBy("date")
    return s.withColumn("before", F.lag("s").over(w)).where("before is not null").select("user_id", "date", r6(reports.sequence_overlap(F.col("before"), F.col("s"))).alias("overlap"))
