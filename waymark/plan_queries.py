"""Queries of context joins, ledgers and reports, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import exprs as X
from waymark.operators import context, ledgers
from waymark.queries import events, query, r6, show, table

_ROUTE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


@query("p1_direct_evidence", """with e as (select event_id, user_id, event_type, epoch_us(ts) / 1e6 s, epoch_us(ts) / 1e6 + value * 300 + case when event_id % 11 = 0 then 5 else 0 end e, value * 300 d, value * 3000 dist, 10.0 + case when event_id % 13 = 0 then 4 else 0 end v from events)
    select event_id, case when abs(e - s - d) > 1 then 'duration' when abs(dist / d - v) > 1 then 'speed' when s < max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 'overlap' end violation from e where event_type <> 'click'""")
def _(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    s = X.micros(F.col("ts")) / 1e6
    e = events(spark, sf).select("event_id", "user_id", "event_type", s.alias("s"), (s + v * 300 + F.when(k % 11 == 0, 5).otherwise(0)).alias("e"), (v * 300).alias("d"), (v * 3000).alias("dist"), (10.0 + F.when(k % 13 == 0, 4).otherwise(0)).alias("v"))
    return context.direct_evidence(e, ["user_id"], "s", "e", "d", "dist", "v", F.col("event_type") != "click", 1.0, 1.0).select("event_id", "violation")


@query("p24_best_candidate", """with c as (select l_orderkey, l_quantity, l_extendedprice, l_partkey, l_discount < 0.05 ok, min(l_extendedprice) over (partition by l_orderkey) * 1.5 o from lineitem),
    b as (select l_orderkey, min({'q': l_quantity, 'x': l_extendedprice, 'p': l_partkey}) b from c where ok and l_extendedprice <= 1.25 * o group by 1)
    select l_orderkey, b.b.q l_quantity, b.b.x l_extendedprice, b.b.p l_partkey from (select distinct l_orderkey from lineitem) left join b using (l_orderkey)""")
def _(spark, sf):
    from pyspark.sql import Window

    c = _lines(spark, sf).withColumn("o", F.min("l_extendedprice").over(Window.partitionBy("l_orderkey")) * 1.5)
    return ledgers.best_feasible(c, ["l_orderkey"], F.col("l_discount") < 0.05, ["l_quantity", "l_extendedprice", "l_partkey"], "l_extendedprice", "o", 1.25)


@query("j1_validated_context", """with o as (select o_orderkey k, o_custkey c, count(*) n from (select o_orderkey, o_custkey from orders where o_orderkey % 10 <> 0 union all select o_orderkey, o_custkey from orders where o_orderkey % 17 = 0) group by all)
    select l_orderkey, l_linenumber, l_partkey, case when n is null then 'no_context' when n > 1 then 'ambiguous' when c % 2 <> l_suppkey % 2 then 'mismatch' else 'ok' end state from lineitem left join o on k = l_orderkey""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 2).alias("parity"))
    o = o.where("l_orderkey % 10 <> 0").unionByName(o.where("l_orderkey % 17 = 0"))
    out = context.with_context(_lines(spark, sf).withColumn("own", F.col("l_suppkey") % 2), o, ["l_orderkey"], [("own", "parity")])
    return out.select(*_KEYS, F.col("context_state").alias("state"))


@query("j4_u4_key_sets", """with a as (select distinct l_orderkey k from lineitem where l_quantity > 10), b as (select distinct o_orderkey k from orders where o_orderstatus <> 'P'), c as (select (select count(*) from a anti join b using (k)) only_a, (select count(*) from b anti join a using (k)) only_b, (select count(*) from a join b using (k)) shared)
    select *, only_a = 0 subset, shared = 0 disjoint from c""")
def _(spark, sf):
    a = _lines(spark, sf).where("l_quantity > 10").select(F.col("l_orderkey").alias("k"))
    return context.key_sets(a, table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k")), ["k"])


@query("j5_skeleton", """with l as (select l_partkey, avg(l_discount) d from lineitem where l_returnflag = 'R' group by 1) select l_orderkey, l_linenumber, lineitem.l_partkey, round(d, 6) d, d is not null d_valid from lineitem left join l using (l_partkey)""")
def _(spark, sf):
    labels = _lines(spark, sf).where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.avg("l_discount").alias("d"))
    return context.on_skeleton(_lines(spark, sf).select(*_KEYS), labels, ["l_partkey"], ["d"]).select(*_KEYS, r6("d").alias("d"), "d_valid")


@query("j10_causal_pairs", """select a.event_id own, b.event_id other from events a join events b on a.user_id = b.user_id and cast(a.ts as date) = cast(b.ts as date) where b.ts < a.ts and a.event_type <> b.event_type""")
def _(spark, sf):
    e = events(spark, sf).withColumn("date", F.to_date("ts"))
    b = e.select("user_id", "date", F.col("ts").alias("available"), F.col("event_type").alias("theirs"), F.col("event_id").alias("other"))
    return context.causal_pairs(e.join(b, ["user_id", "date"]), "event_type", "theirs", "available", "ts").select(F.col("event_id").alias("own"), "other")


@query("j14_neighbours", f"""with c as (select l_suppkey link, l_linenumber b, avg(l_discount) v from lineitem group by all), n as (select l_suppkey a, lead(l_suppkey) over (partition by l_orderkey order by {_ROUTE}) z from lineitem),
    adj as (select a link, z nb from n where z <> a union select z, a from n where z <> a)
    select adj.link, b, round(avg(v), 6) neighbour_mean, count(distinct c.link) neighbours from adj join c on c.link = adj.nb group by all""")
def _(spark, sf):
    """Suppliers that follow each other on a route are neighbours, both ways."""
    from pyspark.sql import Window

    lines = _lines(spark, sf)
    c = lines.groupBy(F.col("l_suppkey").alias("link"), F.col("l_linenumber").alias("b")).agg(F.avg("l_discount").alias("v"))
    n = lines.select(F.col("l_suppkey").alias("link"), F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy(*_ROUTE.split(", "))).alias("neighbour")).where("link <> neighbour")
    adj = n.select(F.explode(F.array(F.struct("link", "neighbour"), F.struct(F.col("neighbour").alias("link"), F.col("link").alias("neighbour")))).alias("p")).select("p.*")
    return show(context.neighbour_means(c, adj, "link", "b", "v"), "link", "b", "neighbours", neighbour_mean="neighbour_mean")


def _xy(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.concat(F.lit("c"), F.col("label") % 3).alias("category"))


_XY = "p as (select vec_id id, embedding[1]::double x, embedding[2]::double y, 'c' || (label % 3) category from embeddings)"


@query("j15_category_counts", f"""with {_XY}, a as (select * from p where id % 2 = 0), b as (select * from p where id % 2 = 1), n as (select a.id, b.category from a join b on sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02)
    select a.id, count(*) filter (n.category = 'c0') c0, count(*) filter (n.category = 'c1') c1, count(*) filter (n.category = 'c2') c2, round(count(n.id) / (pi() * 0.0004), 4) density from a left join n using (id) group by 1""")
def _(spark, sf):
    p = _xy(spark, sf)
    out = context.category_counts(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["c0", "c1", "c2"], 0.02)
    return out.select("id", "c0", "c1", "c2", F.round("density", 4).alias("density"))


@query("j17_near_pairs", f"with {_XY} select a.id a, b.id b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 8) distance from p a join p b on a.id < b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.01")
def _(spark, sf):
    return context.near_pairs(_xy(spark, sf), 0.01).select("a", "b", F.round("distance", 8).alias("distance"))


@query("j18_parallel_pairs", """with e as (select o_custkey c, o_orderpriority p, o_orderkey k, o_totalprice t from orders) select a.c, a.p, a.k a, b.k b, case when least(a.t, b.t) / greatest(a.t, b.t) >= 0.9 then 'twin' else 'parallel' end kind from e a join e b on a.c = b.c and a.p = b.p and a.k < b.k""")
def _(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), "o_orderkey", "o_totalprice")
    return context.parallel_pairs(e, ["c", "p"], "o_orderkey", "o_totalprice", 0.9)


@query("j23_edge_time_lookup", """with c as (select user_id, hour(ts) h, count(*) n from events where event_type = 'purchase' group by all) select event_id, coalesce(n, 0) n from events left join c on c.user_id = events.user_id and h = hour(ts)""")
def _(spark, sf):
    e = events(spark, sf).withColumn("h", F.hour("ts"))
    return context.lookup_or_zero(e, e.where("event_type = 'purchase'").groupBy("user_id", "h").agg(F.count("*").alias("n")), ["user_id", "h"], "n").select("event_id", "n")


@query("j24_class_diversity", "select l_orderkey, count(distinct p_brand) classes, count(distinct l_partkey) edges from lineitem join part on p_partkey = l_partkey group by 1")
def _(spark, sf):
    return context.class_diversity(_lines(spark, sf), table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "l_orderkey", "p_brand")


@query("a47_agreed_copies", "select l_orderkey, l_linenumber, count(*) copies, count(distinct l_returnflag) <= 1 and count(distinct l_linestatus) <= 1 agree, min(l_returnflag) l_returnflag, min(l_linestatus) l_linestatus from lineitem group by all")
def _(spark, sf):
    return context.agreed(_lines(spark, sf), ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"])


@query("a46_overlap_merge", "select l_orderkey, l_linenumber, round(sum(1 / n), 6) weight, round(sum(l_discount / n), 6) l_discount, round(sum(l_quantity / n), 6) l_quantity from (select *, count(*) over (partition by l_orderkey, l_linenumber) n from lineitem) group by all")
def _(spark, sf):
    return show(context.overlap_merge(_lines(spark, sf), ["l_orderkey", "l_linenumber"], ["l_discount", "l_quantity"]), "l_orderkey", "l_linenumber", weight="weight", l_discount="l_discount", l_quantity="l_quantity")


@query("g2_edge_catalogue", "select l_partkey, count(*) n, min(l_returnflag) l_returnflag, min(l_linestatus) l_linestatus, min(l_returnflag) <> max(l_returnflag) or min(l_linestatus) <> max(l_linestatus) conflict from lineitem group by 1")
def _(spark, sf):
    return context.edge_catalogue(_lines(spark, sf), "l_partkey", ["l_returnflag", "l_linestatus"]).withColumnRenamed("rows", "n")


_NATIONS = "(select distinct c_nationkey s, s_nationkey d from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey)"


@query("g3_movements", f"""with e as (select s * 1000 + d edge, s src, d dst, (s * 40 + d * 15) % 360 heading from {_NATIONS}), r as (select a.edge i, b.edge o, case when (a.edge + b.edge) % 7 = 0 then 'no' when (a.edge * 3 + b.edge) % 101 = 0 then 'only' end rule from e a join e b on a.dst = b.src),
    q as (select * from r where rule is not null), m as (select a.edge i, a.dst node, b.edge o, ((b.heading - a.heading) % 360 + 360) % 360 m from e a join e b on a.dst = b.src where a.edge <> b.edge), t as (select *, case when m > 180 then m - 360 else m end df from m)
    select i in_edge, node, o out_edge, case when abs(df) < 35 then 'straight' when abs(df) > 150 then 'u_turn' when df > 0 then 'right' else 'left' end turn,
    case when rule = 'no' then 'prohibited' when i in (select i from q where rule = 'only') and coalesce(rule, '') <> 'only' then 'prohibited' else 'allowed' end state from t left join q using (i, o)""")
def _(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    l = _lines(spark, sf).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("dst"))
    e = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst").distinct()
    e = e.withColumn("edge", F.col("src") * 1000 + F.col("dst")).withColumn("heading", ((F.col("src") * 40 + F.col("dst") * 15) % 360).cast("double"))
    pairs = e.select(F.col("edge").alias("in_edge"), F.col("dst").alias("n")).join(e.select(F.col("edge").alias("out_edge"), F.col("src").alias("n")), "n")
    rule = F.when((F.col("in_edge") + F.col("out_edge")) % 7 == 0, "no").when((F.col("in_edge") * 3 + F.col("out_edge")) % 101 == 0, "only")
    return context.movements(e, pairs.select("in_edge", "out_edge", rule.alias("rule")).where("rule is not null"))


@query("g5_option_counts", "select l_returnflag, count(distinct (l_orderkey, l_suppkey)) pairs, count(distinct l_orderkey) with_option, count(distinct l_suppkey) offered from lineitem where l_discount < 0.03 group by 1")
def _(spark, sf):
    return context.option_counts(_lines(spark, sf).where("l_discount < 0.03"), ["l_returnflag"], "l_orderkey", "l_suppkey")


@query("g11_idle_chains", """with s as (select o_custkey c, o_orderkey k, epoch_us(o_orderdate) / 1e6 s, epoch_us(o_orderdate) / 1e6 + o_totalprice e from orders), l as (select *, lag(k) over w pk, s - lag(e) over w gap from s window w as (partition by c order by s, k))
    select k, pk previous, round(gap, 3) gap_s, gap < 0 as "overlaps", gap > 2592000 as "long" from l where pk is not null""")
def _(spark, sf):
    from waymark.operators.sequence import idle_chains

    s = X.micros(F.col("o_orderdate")) / 1e6
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), s.alias("s"), (s + F.col("o_totalprice")).alias("e"))
    return idle_chains(o, "o_custkey", "k", "s", "e", 2_592_000.0).select("k", "previous", F.round("gap_s", 3).alias("gap_s"), "overlaps", "long")


# reports

@query("a6_composite", """with a as (select l_orderkey, avg(l_discount) a, avg(case when l_returnflag = 'R' then l_tax end) b, avg((l_discount >= 0.05)::int) a_tail, avg(case when l_returnflag = 'R' then (l_tax >= 0.05)::int end) b_tail from lineitem group by 1)
    select l_orderkey, round(a, 6) a, round(b, 6) b, round(a_tail, 6) a_tail, round(b_tail, 6) b_tail, round((a + coalesce(b, 0)) / (1 + (b is not null)::int), 6) composite, 1 + (b is not null)::int available from a""".replace("1 + (b is not null)::int available", "cast(1 + (b is not null)::int as bigint) available"))
def _(spark, sf):
    rows = _lines(spark, sf).select("l_orderkey", F.col("l_discount").alias("a"), F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("b"))
    return show(ledgers.composite(rows, ["l_orderkey"], ["a", "b"], 0.05), "l_orderkey", "available", **{c: c for c in ("a", "b", "a_tail", "b_tail", "composite")})


@query("a34_reduced_states", "select l_orderkey, case max(case l_returnflag when 'R' then 3 when 'N' then 2 else 1 end) when 3 then 'R' when 2 then 'N' else 'A' end state from lineitem group by 1")
def _(spark, sf):
    return ledgers.reduce_states(_lines(spark, sf), ["l_orderkey"], "l_returnflag", ["A", "N", "R"])


@query("a35_reason_sets", """with r as (select l_orderkey, list_sort(list(distinct p_brand) filter (l_returnflag <> 'N')) k, list_sort(list(distinct p_brand) filter (l_returnflag = 'N')) u from lineitem join part on p_partkey = l_partkey group by 1)
    select l_orderkey, coalesce(array_to_string(k, '|'), '') known, coalesce(array_to_string(u, '|'), '') unknown, coalesce(len(k), 0) n_known, coalesce(len(u), 0) n_unknown from r""")
def _(spark, sf):
    rows = _lines(spark, sf).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return ledgers.reason_sets(rows, ["l_orderkey"], "p_brand", F.col("l_returnflag") != "N")


@query("a37_funnel", "select o_orderpriority, count(*) n, count(*) filter (o_totalprice > 20000) priced, count(*) filter (o_totalprice > 20000 and o_orderstatus <> 'P') settled, count(*) filter (o_totalprice > 20000 and o_orderstatus <> 'P' and o_custkey % 3 = 0) chosen, true reconciles from orders group by 1")
def _(spark, sf):
    f = ledgers.funnel(table(spark, sf, "orders"), ["o_orderpriority"], [("priced", F.col("o_totalprice") > 20_000), ("settled", F.col("o_orderstatus") != "P"), ("chosen", F.col("o_custkey") % 3 == 0)])
    return f.withColumnRenamed("rows", "n")


@query("a44_ledger", """select round(sum(r), 2) revenue, round(sum(c), 2) cost, round(sum(r) - sum(c), 2) net, count(*) filter (k) orders, true balanced from (select true k, o_totalprice r, o_totalprice * 0.7 c from orders where o_orderstatus <> 'P' union all select false, 0, count(*) * 25.0::double from orders where o_orderstatus = 'P' union all select false, 0, 1000.0)""")
def _(spark, sf):
    book = ledgers.ledger(table(spark, sf, "orders"), "o_orderkey", F.col("o_orderstatus") != "P", F.col("o_totalprice"), F.col("o_totalprice") * 0.7, 1000.0, 25.0)
    return ledgers.ledger_audit(book, 0.01).select(*[F.round(c, 2).alias(c) for c in ("revenue", "cost", "net")], "orders", "balanced")


@query("a48_coverage", "select cast(sum(n) as bigint) n, cast(sum(r) as bigint) resolved, round(sum(r) / sum(n), 6) share, count(*) trips, count(*) filter (n = r) whole_trips from (select l_orderkey, count(*) n, count(*) filter (l_returnflag <> 'N') r from lineitem group by 1)")
def _(spark, sf):
    s = ledgers.coverage_summary(_lines(spark, sf), "l_orderkey", F.col("l_returnflag") != "N")
    return s.select(F.col("rows").alias("n"), "resolved", r6("share").alias("share"), "trips", "whole_trips")


@query("a51_exposure", """with r as (select event_type, user_id, value, avg(value) over (partition by event_type, user_id order by ts, event_id rows between unbounded preceding and current row) m from events)
    select event_type, user_id, round(max(m), 5) max_mean, max(value) max_exposure, round(min(100 - m), 5) min_slack, count(*) filter (abs(100 - m) <= 20) binding from r group by all""")
def _(spark, sf):
    e = ledgers.exposure_over_time(events(spark, sf), ["event_type", "user_id"], ["ts", "event_id"], "value", 100.0, 20.0)
    return e.select("event_type", "user_id", F.round("max_mean", 5).alias("max_mean"), "max_exposure", F.round("min_slack", 5).alias("min_slack"), "binding")


@query("a52_cap_exceedance", "select l_returnflag, round(avg((l_quantity > 10)::int), 6) c, round(avg((l_quantity > 25)::int), 6) m, round(avg((l_quantity > 40)::int), 6) a, true nested from lineitem group by 1")
def _(spark, sf):
    return show(ledgers.cap_exceedance(_lines(spark, sf), ["l_returnflag"], "l_quantity", {"a": 40.0, "m": 25.0, "c": 10.0}), "l_returnflag", "nested", c="c", m="m", a="a")


@query("a56_cell_errors", """with c as (select l_suppkey, l_linenumber, l_returnflag, avg(abs(l_discount - 0.05)) m, count(*) n from lineitem group by all) select l_returnflag, round(avg(m), 6) cell_mean, count(*) cells, cast(sum(n) as bigint) n, round(sum(m * n) / sum(n), 6) row_mean from c group by 1""")
def _(spark, sf):
    rows = _lines(spark, sf).withColumn("e", F.abs(F.col("l_discount") - 0.05))
    return show(ledgers.cell_errors(rows, ["l_suppkey", "l_linenumber"], "l_returnflag", "e").withColumnRenamed("rows", "n"), "l_returnflag", "cells", "n", cell_mean="cell_mean", row_mean="row_mean")


@query("a58_scenarios", """with s as (select o_orderpriority p, count(*) n, avg(o_totalprice) m, sum(o_totalprice) t from orders group by 1) select p, n, round(m, 4) mean, round(t, 2) total, round(m / (select m from s where p = '5-LOW') - 1, 6) change from s""")
def _(spark, sf):
    s = ledgers.scenario_summary(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "p"), "p", "5-LOW", "o_totalprice")
    return s.select("p", "n", F.round("mean", 4).alias("mean"), F.round("total", 2).alias("total"), r6("change").alias("change"))


@query("a61_profile_margins", """with t as (select l_orderkey, sum(l_quantity) size, max(l_discount) slow, max(case when l_returnflag = 'R' then l_tax end) tax from lineitem group by 1), p as (select * from (values ('A', 300.0::double, 0.2::double, 0.1::double), ('M', 150, 0.09, 0.07), ('C', 60, 0.05, 0.04)) v(profile, cs, cl, ct)),
    u as (select l_orderkey, profile, size / cs us, slow / cl ul, tax / ct ut from t, p), m as (select *, list_filter([{'m': 1 - us, 'd': 'size'}, {'m': 1 - ul, 'd': 'slow'}, case when ut is not null then {'m': 1 - ut, 'd': 'tax'} end], lambda x: x is not null) ms from u)
    select l_orderkey, profile, round((us * 2 + ul + coalesce(ut, 0)) / (3 + (ut is not null)::int), 6) stress, array_to_string(list_filter([case when us > 1 then 'size' end, case when ul > 1 then 'slow' end, case when ut > 1 then 'tax' end], lambda x: x is not null), '|') violations, list_min(ms).d binding, round(list_min(ms).m, 6) margin from m""")
def _(spark, sf):
    t = _lines(spark, sf).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("size"), F.max("l_discount").alias("slow"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("tax"))
    p = spark.createDataFrame([("A", 300.0, 0.2, 0.1), ("M", 150.0, 0.09, 0.07), ("C", 60.0, 0.05, 0.04)], "profile string, cap_size double, cap_slow double, cap_tax double")
    return show(ledgers.profile_margins(t, "l_orderkey", {"size": 2.0, "slow": 1.0, "tax": 1.0}, p), "l_orderkey", "profile", "violations", "binding", stress="stress", margin="margin")


@query("a63_cap_tail", "select count(*) n, count(*) filter (x > 40 and m <= 40) max_only, count(*) filter (m > 40) as both, round(avg(t), 6) mean_tail from (select l_orderkey, avg(l_quantity) m, max(l_quantity) x, avg((l_quantity > 40)::int) t from lineitem group by 1)")
def _(spark, sf):
    return show(ledgers.cap_tail(_lines(spark, sf), ["l_orderkey"], "l_quantity", 40.0), "n", "max_only", "both", mean_tail="mean_tail")


@query("a64_wide", "select user_id, cast(ts as date) date, round(sum(value) filter (event_type = 'click'), 4) click, round(sum(value) filter (event_type = 'purchase'), 4) purchase, round(sum(value) filter (event_type = 'view'), 4) as view from events group by all having count(*) filter (event_type in ('click', 'purchase', 'view')) > 0")
def _(spark, sf):
    long = events(spark, sf).where(F.col("event_type").isin("click", "purchase", "view")).groupBy("user_id", F.to_date("ts").alias("date"), "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return ledgers.wide(long, ["user_id", "date"], "event_type", "v", ["click", "purchase", "view"])


@query("a65_thresholds", "select l_returnflag, threshold, round(avg((l_quantity >= threshold)::int), 6) share, round(avg(l_quantity) filter (l_quantity >= threshold), 6) mean from lineitem, unnest([10.0::double, 20.0, 30.0, 45.0]) t(threshold) group by all")
def _(spark, sf):
    return show(ledgers.threshold_table(_lines(spark, sf), ["l_returnflag"], "l_quantity", [10.0, 20.0, 30.0, 45.0]), "l_returnflag", "threshold", share="share", mean="mean")


@query("a67_hourly_exposure", """with e as (select hour(ts) h, value, unnest([{'c': 'high', 'o': value > 50}, {'c': 'even', 'o': event_id % 2 = 0}]) e from events) select e.c category, h as hour, round(sum(value), 4) total, count(value) n, round(avg(value), 6) mean from e where e.o group by all""")
def _(spark, sf):
    rows = events(spark, sf).withColumn("high", F.col("value") > 50).withColumn("even", F.col("event_id") % 2 == 0)
    e = ledgers.hourly_exposure(rows, F.hour("ts"), ["high", "even"], "value")
    return e.select("category", F.col("hour").cast("long").alias("hour"), F.round("total", 4).alias("total"), "n", r6("mean").alias("mean"))


_POS = f"p as (select *, (row_number() over w - 1) / greatest(count(*) over (partition by l_orderkey) - 1, 1) pos from lineitem window w as (partition by l_orderkey order by {_ROUTE}))"


def _positions(spark, sf):
    from waymark.operators.sequence import positions

    return positions(_lines(spark, sf), ["l_orderkey"], _ROUTE.split(", "))


@query("a26_segments", f"""with {_POS} select l_orderkey, round(avg(l_discount), 6) mean, round(quantile_cont(l_discount, 0.9), 6) q90, round(quantile_cont(l_discount, 0.95), 6) q95, max(l_discount) as max, round(stddev_samp(l_discount), 6) std, round(avg(l_discount) filter (pos < 1 / 3), 6) early,
    round(avg(l_discount) filter (pos >= 1 / 3 and pos < 2 / 3), 6) middle, round(avg(l_discount) filter (pos >= 2 / 3), 6) late, round(coalesce(sum(l_quantity) filter (l_discount >= 0.08), 0) / sum(l_quantity), 6) tail_share from p group by 1""")
def _(spark, sf):
    s = ledgers.segments(_positions(spark, sf), ["l_orderkey"], "position_ratio", "l_discount", "l_quantity", 0.08)
    return show(s, "l_orderkey", "max", **{c: c for c in ("mean", "q90", "q95", "std", "early", "middle", "late", "tail_share")})


@query("a25_route_conditions", f"""with {_POS}, k as (select *, case when l_returnflag <> 'N' then l_discount end v, case when l_returnflag <> 'N' then l_quantity else 0 end kw from p), c as (select *, sum(kw) over (partition by l_orderkey order by v nulls last) cum, sum(kw) over (partition by l_orderkey) al from k),
    a as (select l_orderkey, sum(kw) / sum(l_quantity) coverage, sum(kw * v) / nullif(sum(kw) filter (v is not null), 0) mean, min(v) filter (cum >= 0.9 * al - 1e-9) p90, case when sum(kw) > 0 then coalesce(sum(l_quantity) filter (v >= 0.08), 0) / sum(kw) end high,
    sum(kw * v) filter (pos <= 0.2) / sum(kw) filter (pos <= 0.2 and v is not null) f, sum(kw * v) filter (pos >= 0.8) / sum(kw) filter (pos >= 0.8 and v is not null) l, list_sort(list(v) filter (v is not null), 'desc')[1:5] worst from c group by 1)
    select l_orderkey, round(coverage, 6) coverage, round(mean + 1e-9, 5) mean, p90, round(high, 6) high_share, round(f + 1e-9, 5) as first, round(l + 1e-9, 5) as last, round(coalesce(list_sum(worst), 0), 6) worst_sum, case when coverage = 0 then 'missing' when coverage < 0.5 then 'partial' else 'complete' end status from a""")
def _(spark, sf):
    rows = _positions(spark, sf).withColumn("v", F.when(F.col("l_returnflag") != "N", F.col("l_discount")))
    c = ledgers.route_conditions(rows, ["l_orderkey"], "position_ratio", "v", "l_quantity", 0.08, 0.5)
    c = c.withColumn("worst_sum", F.aggregate("worst", F.lit(0.0), lambda a, x: a + x))
    means = [F.round(F.col(k) + 1e-9, 5).alias(k) for k in ("mean", "first", "last")]
    return c.select("l_orderkey", "status", "p90", *means, *[r6(k).alias(k) for k in ("coverage", "high_share", "worst_sum")])
