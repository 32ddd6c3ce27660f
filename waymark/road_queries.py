"""Queries of traces, route parts and road rules, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import exprs as X
from waymark.functions import road as R
from waymark.operators import traces
from waymark.queries import events, query, r6, show, table

def _hav(a: tuple[str, str], b: tuple[str, str]) -> str:
    (o1, l1), (o2, l2) = a, b
    return f"2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({l2} - {l1}) / 2), 2) + cos(radians({l1})) * cos(radians({l2})) * pow(sin(radians({o2} - {o1}) / 2), 2))))"


#: Events as a point log: a user's traces, six hours being a minute, some positions out of range.
_POINTS = """select user_id trip, event_id seq, floor(epoch_us(ts) / 3.6e8) t, case when event_id % 97 = 0 then 999.0 else 104.0 + value / 20000 end lon, 30.0 + (event_id % 13) / 20000.0 lat from events"""


def _points(spark, sf):
    e = events(spark, sf)
    return e.select(F.col("user_id").alias("trip"), F.col("event_id").alias("seq"), F.floor(X.micros(F.col("ts")) / 3.6e8).cast("double").alias("t"),
                    F.when(F.col("event_id") % 97 == 0, 999.0).otherwise(104.0 + F.col("value") / 20000).alias("lon"), (30.0 + (F.col("event_id") % 13) / 20000.0).alias("lat"))


_CLEAN = f"""v as (select trip, t, lon, lat, min(seq) seq from ({_POINTS}) where lon between -180 and 180 group by all),
    s as (select *, t - lag(t) over w gap_s, coalesce({_hav(('lag(lon) over w', 'lag(lat) over w'), ('lon', 'lat'))}, 0) step_m, {_hav(('lag(lon) over w', 'lag(lat) over w'), ('lead(lon) over w', 'lead(lat) over w'))} bridge,
        row_number() over w rn from v window w as (partition by trip order by t, seq)),
    s2 as (select *, case when gap_s > 0 then step_m / gap_s end speed, coalesce(lead(step_m) over (partition by trip order by t, seq), 0) nxt from s),
    s3 as (select *, case when count(speed) over x >= 3 then quantile_cont(speed, 0.5) over x end med, lag(speed) over w ps, lead(speed) over w ns
        from s2 window w as (partition by trip order by t, seq), x as (partition by trip order by t, seq rows between 2 preceding and 2 following)),
    s4 as (select *, case when coalesce(speed >= 0.05 and speed >= 1.6 * med and (coalesce(abs(speed - ps) >= 0.02, false) or coalesce(abs(speed - ns) >= 0.02, false)), false) then 'speed_peak'
        when coalesce(gap_s <= 0 and step_m > 20, false) then 'moved_without_time'
        when coalesce(step_m >= 15 and nxt >= 15 and bridge <= greatest(5, 0.3 * (step_m + nxt)), false) then 'out_and_back' end outlier from s3),
    s5 as (select *, case when rn = 1 then null when outlier is not null or lag(outlier) over (partition by trip order by t, seq) is not null then 'outlier'
        when coalesce(gap_s <= 0 and step_m > 0, false) then 'no_time' when coalesce(speed > 10, false) then 'jump' when coalesce(gap_s > 120, false) then 'gap' end break_reason from s4),
    c as (select *, sum(case when break_reason is not null then 1 else 0 end) over (partition by trip order by t, seq) subtrace from s5)"""


def _cleaned(spark, sf):
    return traces.clean_trace(_points(spark, sf), max_gap_s=120.0, max_speed=10.0, least_points=3, peak=(0.05, 0.02))


@query("g6_clean_trace", f"""with {_CLEAN} select trip, seq, round(step_m, 3) step_m, outlier, break_reason, cast(subtrace as bigint) subtrace, count(*) over (partition by trip, subtrace) >= 3 usable from c""")
def _(spark, sf):
    return _cleaned(spark, sf).select("trip", "seq", F.round("step_m", 3).alias("step_m"), "outlier", "break_reason", "subtrace", "usable")


@query("g7_trace_summary", f"""with {_CLEAN}, u as (select *, count(*) over (partition by trip, subtrace) >= 3 usable from c)
    select trip, count(*) points, max(t) - min(t) duration_s, round(sum(step_m), 2) distance_m, round(sum(case when break_reason is null then step_m else 0 end), 2) unbroken_m, round(quantile_cont(speed, 0.5), 5) speed_median,
    round(quantile_cont(speed, 0.9), 5) speed_p90, count(break_reason) breaks, count(outlier) outliers, count(distinct subtrace) subtraces, count(distinct case when usable then subtrace end) usable_subtraces from u group by 1""")
def _(spark, sf):
    s = traces.trace_summary(_cleaned(spark, sf))
    return s.select("trip", "points", "duration_s", *[F.round(c, 2).alias(c) for c in ("distance_m", "unbroken_m")], *[F.round(c, 5).alias(c) for c in ("speed_median", "speed_p90")],
                    "breaks", "outliers", "subtraces", "usable_subtraces")


_EV = "(select *, epoch_us(ts) / 1e6 t from events)"
_VISITS = f"""p as (select *, row_number() over (partition by user_id order by t, event_id) rn, coalesce(event_type <> lag(event_type) over (partition by user_id order by t, event_id), false) ch from {_EV}),
    q as (select *, sum(ch::int) over (partition by user_id order by t, event_id) visit from p),
    h as (select *, lead(t) over w - t ahead, t - lag(t) over w behind, lead(visit) over w = visit ns, lag(visit) over w = visit ls from q window w as (partition by user_id order by t, event_id)),
    vis as (select user_id, cast(visit as bigint) visit, event_type, count(*) points, min(t) start_s, max(t) end_s, sum(coalesce(case when ns then ahead else ahead / 2 end, 0) + coalesce(case when not ls then behind / 2 end, 0)) time_s from h group by all)"""


def _timed(spark, sf):
    return events(spark, sf).withColumn("t", X.micros(F.col("ts")) / 1e6)


@query("a54_link_traversals", f"with {_VISITS} select user_id, visit, event_type, points, round(time_s, 3) time_s from vis")
def _(spark, sf):
    v = traces.link_traversals(_timed(spark, sf), "user_id", ["t", "event_id"], "t", "event_type")
    return v.select("user_id", "visit", "event_type", "points", F.round("time_s", 3).alias("time_s"))


@query("g9_observed_parts", f"""with {_VISITS}, plan as (select user_id, event_id seq, event_type from events where event_id % 3 <> 0),
    pn as (select *, row_number() over (partition by user_id, event_type order by seq) n, lead(event_type) over (partition by user_id order by seq) next_link from plan),
    vn as (select *, row_number() over (partition by user_id, event_type order by visit) n from vis)
    select pn.user_id, seq, pn.event_type, round(time_s, 3) time_s, points, case when time_s is null then 'inferred' else 'observed' end source, next_link from pn left join vn using (user_id, event_type, n)""")
def _(spark, sf):
    v = traces.link_traversals(_timed(spark, sf), "user_id", ["t", "event_id"], "t", "event_type")
    plan = events(spark, sf).where("event_id % 3 <> 0").select("user_id", F.col("event_id").alias("seq"), "event_type")
    out = traces.attach_observed(plan, v, "user_id", "seq", "event_type")
    return out.select("user_id", "seq", "event_type", F.round("time_s", 3).alias("time_s"), "points", "source", "next_link")


@query("g10_interval_kinds", """with p as (select user_id, event_id, epoch_us(ts) / 1e6 t, case when event_type <> 'click' then event_type end link, value > 200 cut, floor(event_id / 5) part from events),
    n as (select user_id, event_id, link, lead(link) over w next_link, lead(t) over w - t d, lead(cut) over w c, lead(part) over w - part a from p window w as (partition by user_id order by t, event_id))
    select user_id, event_id, link, next_link, round(d, 3) duration_s, kind, round(case when kind = 'direct' then d end, 3) direct_s from (select *, case when link is null or next_link is null or c or d <= 0 or a < 0 then 'unresolved'
    when link = next_link and a = 0 then 'direct' when a = 1 then 'supported' else 'unresolved' end kind from n where d is not null)""")
def _(spark, sf):
    p = _timed(spark, sf).withColumn("link", F.when(F.col("event_type") != "click", F.col("event_type"))).withColumn("cut", F.col("value") > 200).withColumn("part", F.floor(F.col("event_id") / 5))
    k = traces.classify_intervals(p, "user_id", ["t", "event_id"], "t", "link", "cut")
    return k.select("user_id", "event_id", "link", "next_link", F.round("duration_s", 3).alias("duration_s"), "kind", F.round("direct_s", 3).alias("direct_s"))


_ROUTE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"


@query("g8_route_sequence", f"""with p as (select l_orderkey, l_suppkey, l_quantity, l_returnflag = 'N' i, o_totalprice / 1000 d, l_suppkey = lag(l_suppkey, 2) over w and l_suppkey <> lag(l_suppkey) over w turn
    from lineitem join orders on o_orderkey = l_orderkey window w as (partition by l_orderkey order by {_ROUTE}))
    select l_orderkey, round(avg(i::int), 6) interpolated_share, round(1 - count(distinct l_suppkey) / count(*), 6) repeated_share, count(*) filter (turn) returns, round(sum(l_quantity) / max(d), 6) length_ratio from p group by 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("d"))
    s = traces.route_sequence(table(spark, sf, "lineitem"), "l_orderkey", _ROUTE.split(", "), "l_suppkey", "l_quantity", F.col("l_returnflag") == "N", o)
    return show(s, "l_orderkey", "returns", **{c: c for c in ("interpolated_share", "repeated_share", "length_ratio")})


@query("a60_measurement_support", """with s as (select user_id, cast(ts as date) date, epoch_us(ts) / 1e6 s, epoch_us(ts) / 1e6 + value * 60 e, value from events),
    g as (select *, greatest(s - lag(e) over (partition by user_id, date order by s), 0) gap from s)
    select user_id, date, count(*) n, round(sum(e - s), 3) time_s, round(sum(value), 4) distance, round(max(e) - min(s), 3) window_s, round(max(gap), 3) max_gap_s, round(least(1, sum(value) / 200), 6) distance_coverage,
    round(least(1, sum(e - s) / (max(e) - min(s))), 6) time_coverage from g group by all""")
def _(spark, sf):
    rows = _timed(spark, sf).withColumn("date", F.to_date("ts")).withColumn("e", F.col("t") + F.col("value") * 60)
    s = traces.measurement_support(rows, ["user_id", "date"], "t", "e", "value", F.lit(200.0))
    return s.select("user_id", "date", "n", *[F.round(c, 3).alias(c) for c in ("time_s", "window_s", "max_gap_s")], F.round("distance", 4).alias("distance"), r6("distance_coverage").alias("distance_coverage"), r6("time_coverage").alias("time_coverage"))


@query("a59_state_exposure", """with s as (select l_orderkey, l_linenumber, l_returnflag, max(l_quantity) q from lineitem group by all), d as (select * from s qualify row_number() over (partition by l_orderkey, l_linenumber order by l_returnflag) = 1),
    h as (select *, l_returnflag = 'R' hot, lag(l_returnflag = 'R') over w and lag(l_linenumber) over w = l_linenumber - 1 goes_on from d window w as (partition by l_orderkey order by l_linenumber)),
    r as (select *, case when hot then sum(case when coalesce(goes_on, false) then 0 else 1 end) over (partition by l_orderkey order by l_linenumber) end run from h),
    g as (select l_orderkey, run, sum(q) w from r group by all), l as (select l_orderkey, max(w) filter (run is not null) best from g group by 1)
    select l_orderkey, round(coalesce(sum(q) filter (l_returnflag = 'A'), 0) / sum(q), 6) share_a, round(coalesce(sum(q) filter (l_returnflag = 'N'), 0) / sum(q), 6) share_n, round(coalesce(sum(q) filter (hot), 0) / sum(q), 6) share_r,
    round(coalesce(max(best), 0) / sum(q), 6) longest_share from r join l using (l_orderkey) group by 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.max("l_quantity").alias("q"))
    first = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_returnflag", "q"), "l_returnflag").alias("b")).select("l_orderkey", "l_linenumber", "b.*")
    e = traces.state_exposure(first, ["l_orderkey"], "l_linenumber", "l_returnflag", "q", ["A", "N", "R"], ["R"])
    return show(e, "l_orderkey", share_a="share_A", share_n="share_N", share_r="share_R", longest_share="longest_share")


@query("g4_encounters", """with p as (select user_id, event_id, event_type link, case when value > 20 then floor(value / 100) end area, row_number() over w rn, lag(event_type) over w b, lead(event_type) over w a from events window w as (partition by user_id order by ts, event_id)),
    o as (select *, area is not null and not coalesce(lag(area) over (partition by user_id order by rn) = area, false) opens from p), r as (select *, sum(opens::int) over (partition by user_id order by rn) run from o)
    select user_id, cast(run as bigint) encounter, cast(area as bigint) area, min_by(b, rn) incoming, count(*) inner_parts, arg_max_null(a, rn) outgoing from r where area is not null group by all""".replace("min_by(b, rn)", "arg_min_null(b, rn)"))
def _(spark, sf):
    p = events(spark, sf).withColumn("link", F.col("event_type")).withColumn("area", F.when(F.col("value") > 20, F.floor(F.col("value") / 100)))
    return traces.encounters(p, "user_id", ["ts", "event_id"], "area").withColumnRenamed("inner", "inner_parts")


# road rules

_GCJ_X, _GCJ_Y = "(lon - 105.0)", "(lat - 35.0)"


def _gcj_sql() -> str:
    wave = lambda v, terms: "(" + " + ".join(f"{a} * sin({v} * pi() / {d})" for a, d in terms) + ") * 2 / 3"
    x, y = _GCJ_X, _GCJ_Y
    common = wave(x, [(20, 1 / 6), (20, 0.5)])
    north = f"-100 + 2 * {x} + 3 * {y} + 0.2 * {y} * {y} + 0.1 * {x} * {y} + 0.2 * sqrt(abs({x})) + {common} + {wave(y, [(20, 1), (40, 3)])} + {wave(y, [(160, 12), (320, 30)])}"
    east = f"300 + {x} + 2 * {y} + 0.1 * {x} * {x} + 0.1 * {x} * {y} + 0.1 * sqrt(abs({x})) + {common} + {wave(x, [(20, 1), (40, 3)])} + {wave(x, [(150, 12), (300, 30)])}"
    return f"""with p as (select event_id, 104.0 + value / 1000 lon, 30.0 + (event_id % 1000) / 1000.0 lat from events), m as (select *, 1 - 0.00669342162296594323 * pow(sin(radians(lat)), 2) g, {north} n, {east} e from p)
    select event_id, round(lon - e * 180 / (6378245.0 / sqrt(g) * cos(radians(lat)) * pi()), 8) lon, round(lat - n * 180 / (6335552.717000426 / (g * sqrt(g)) * pi()), 8) lat from m"""


@query("f1_gcj_to_wgs", _gcj_sql())
def _(spark, sf):
    lon, lat = R.gcj02_to_wgs84(104.0 + F.col("value") / 1000, 30.0 + (F.col("event_id") % 1000) / 1000.0)
    return events(spark, sf).select("event_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


_SPEED = """case event_id % 9 when 0 then null when 1 then '' when 2 then cast(floor(value) as varchar) when 3 then floor(value) || ' km/h' when 4 then floor(value) || ' MPH' when 5 then '50;60' when 6 then 'signals' when 7 then '30 @ (22:00-06:00)' else ' 80|50 mph ' end"""


@query("f8_speeds", f"""with s as (select event_id, lower(trim(coalesce({_SPEED}, ''))) t from events), p as (select *, list_filter(list_transform(regexp_split_to_array(t, '[;|]'), lambda x: trim(x)), lambda x: x <> '') pc from s),
    f as (select *, len(pc) > 0 and len(list_filter(pc, lambda x: not regexp_full_match(x, '[0-9]+([.][0-9]+)? *(km/h|kmh|kph|mph)?'))) = 0 ok from p),
    k as (select *, case when t = '' then 'missing' when contains(t, '@') then 'conditional' when not ok then 'named_or_non_numeric' when len(pc) > 1 then 'multi_numeric' when suffix(pc[1], 'mph') then 'mph' when regexp_matches(pc[1], '[a-z]$') then 'kmh_unit' else 'numeric' end format from f)
    select event_id, format, case when format in ('numeric', 'kmh_unit', 'mph', 'multi_numeric') then round(list_sum(list_transform(pc, lambda x: regexp_extract(x, '^[0-9.]+')::double * case when suffix(x, 'mph') then 1.609344 else 1 end)), 6) end total, case when format in ('numeric', 'kmh_unit', 'mph', 'multi_numeric') then len(pc) else 0 end n from k""")
def _(spark, sf):
    v = F.floor("value").cast("string")
    text = F.element_at(F.array(F.lit(None), F.lit(""), v, F.concat(v, F.lit(" km/h")), F.concat(v, F.lit(" MPH")), F.lit("50;60"), F.lit("signals"), F.lit("30 @ (22:00-06:00)"), F.lit(" 80|50 mph ")), (F.col("event_id") % 9 + 1).cast("int"))
    s = R.parse_speed(text)
    e = events(spark, sf).select("event_id", s["format"].alias("format"), s["values"].alias("values"))
    return e.select("event_id", "format", F.when(F.size("values") > 0, r6(F.aggregate("values", F.lit(0.0), lambda a, x: a + x))).alias("total"), F.size("values").cast("long").alias("n"))


@query("f8_tags", """with j as (select event_id, json_extract_string(props, k) v, k from events, unnest(json_keys(props)) t(k)) select event_id, k as key, v as val from j""")
def _(spark, sf):
    pairs = F.transform(F.json_object_keys("props"), lambda k: F.concat(F.lit('"'), k, F.lit('"=>"'), F.coalesce(F.get(F.map_values(F.map_filter(F.from_json("props", "map<string,string>"), lambda a, b: a == k)), 0), F.lit("")), F.lit('"')))
    tags = R.parse_tags(F.array_join(pairs, ", "))
    return table(spark, sf, "events").select("event_id", F.explode(tags).alias("key", "val"))


_ONEWAY = "['yes', '-1', 'No', null, 'TRUE', 'reverse', '', '1', 'alternating'][o_orderkey % 9 + 1]"


@query("f9_f14_directions", f"""with o as (select o_orderkey, lower(trim(coalesce({_ONEWAY}, ''))) t, case when o_custkey % 5 = 0 then 'Roundabout' end j, case when o_custkey % 7 = 0 then 'motorway' end h, case when o_custkey % 3 = 0 then o_custkey % 4 || '' end layer, o_custkey % 2 = 0 bridge, o_custkey % 11 = 0 tunnel from orders),
    n as (select *, case when t in ('-1', 'reverse') then 'reverse' when t in ('1', 'true', 'yes', 'y') or coalesce(lower(j) = 'roundabout', false) or coalesce(h = 'motorway', false) then 'forward' else 'both' end ow,
        coalesce(try_cast(layer as bigint), case when bridge then 1 when tunnel then -1 else 0 end) layer_no from o)
    select o_orderkey || ':' || d uid, o_orderkey || ':' || case d when 'F' then 'R' else 'F' end opposite, ow oneway, cast(layer_no as bigint) layer from n, unnest(case ow when 'forward' then ['F'] when 'reverse' then ['R'] else ['F', 'R'] end) u(d)""")
def _(spark, sf):
    k = F.col("o_custkey")
    text = F.element_at(F.array(*[F.lit(x) for x in ("yes", "-1", "No", None, "TRUE", "reverse", "", "1", "alternating")]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    mark = lambda c: F.when(c, "yes").otherwise("no")
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), R.normal_oneway(text, F.when(k % 5 == 0, "Roundabout"), F.when(k % 7 == 0, "motorway")).alias("oneway"),
        R.normal_layer(F.when(k % 3 == 0, (k % 4).cast("string")), mark(k % 2 == 0), mark(k % 11 == 0)).alias("layer"))
    d = o.withColumn("d", F.explode(R.directions(F.col("oneway")))).withColumn("uid", R.directed_id(F.col("id"), F.col("d")))
    return d.select("uid", R.reversed_id(F.col("uid")).alias("opposite"), "oneway", "layer")


@query("p5_p22_targets", """select l_orderkey, l_linenumber, l_partkey, coalesce(l_quantity >= 10 and l_discount * 10 between 0 and 1, false) unit_ok, l_returnflag = 'R' and l_discount > 0 ok, round(case when l_returnflag = 'R' and l_discount > 0 then l_discount * 100 / l_quantity end, 6) pace from lineitem""")
def _(spark, sf):
    source = F.when(F.col("l_returnflag") == "R", "direct").otherwise("inferred")
    t = R.service_targets(source, F.col("l_discount") * 100, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.unit_valid(F.col("l_discount") * 10, F.col("l_quantity"), 10).alias("unit_ok"), t["valid"].alias("ok"), r6(t["pace"]).alias("pace"))


@query("p6_p7_quality_tiers", """with a as (select l_orderkey, sum(l_quantity) filter (l_returnflag = 'R') / sum(l_quantity) direct, sum(l_quantity) filter (l_returnflag = 'N') / sum(l_quantity) unresolved, count(*) n from lineitem group by 1)
    select l_orderkey, case when coalesce(coalesce(direct, 0) >= 0.7 and coalesce(unresolved, 0) <= 0.2, false) then 'strict' when coalesce(direct, 0) >= 0.3 and coalesce(unresolved, 0) <= 0.6 then 'analysis' else 'rejected' end tier,
    array_to_string(list_filter([case when coalesce(direct, 0) < 0.7 then 'direct_share' end, case when coalesce(unresolved, 0) > 0.2 then 'unresolved_share' end, case when n < 3 then 'few_parts' end], lambda x: x is not null), '|') failed from a""")
def _(spark, sf):
    part = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(part("R").alias("direct"), part("N").alias("unresolved"), F.count("*").alias("n"))
    failed = X.all_reasons([("direct_share", F.col("direct") < 0.7), ("unresolved_share", F.col("unresolved") > 0.2), ("few_parts", F.col("n") < 3)])
    return a.select("l_orderkey", R.tier((F.col("direct") >= 0.7) & (F.col("unresolved") <= 0.2), (F.col("direct") >= 0.3) & (F.col("unresolved") <= 0.6)).alias("tier"), F.array_join(failed, "|").alias("failed"))


@query("p8_mapping_status", """select l_orderkey, case when bool_or(l_returnflag = 'A' and l_discount > 0.08) then 'ambiguous' when bool_or(l_returnflag = 'N' and l_discount = 0) then 'unmapped' when count(distinct l_suppkey) < count(*) then 'chain' else 'unique' end status from lineitem group by 1""")
def _(spark, sf):
    flag, d = F.col("l_returnflag"), F.col("l_discount")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(X.first_reason([
        ("ambiguous", F.bool_or((flag == "A") & (d > 0.08))), ("unmapped", F.bool_or((flag == "N") & (d == 0))), ("chain", F.count_distinct("l_suppkey") < F.count("*"))]).alias("s")).select("l_orderkey", F.coalesce("s", F.lit("unique")).alias("status"))


@query("p9_p10_audit", """with s as (select o_orderkey, 100 * (2 * greatest(0, least(1, o_totalprice / 200000)) + 1 * greatest(0, least(1, (o_custkey % 50) / 40))) / 3 score, case when o_totalprice > 250000 then ['price'] else [] end || case when o_orderstatus = 'P' and o_totalprice > 100000 then ['pending'] else [] end hard,
    case when o_custkey % 4 = 0 then ['customer'] else [] end review, o_totalprice >= 20000 eligible from orders)
    select o_orderkey, round(score, 6) score, case when not eligible then 'excluded_low_information' when len(hard) > 0 then 'auto_fail' when len(review) > 0 then 'manual_review' else 'auto_pass' end audit from s""")
def _(spark, sf):
    price, c = F.col("o_totalprice"), F.col("o_custkey")
    hard = X.all_reasons([("price", price > 250_000), ("pending", (F.col("o_orderstatus") == "P") & (price > 100_000))])
    return table(spark, sf, "orders").select("o_orderkey", r6(R.risk_score([(price, 200_000.0, 2.0), (c % 50, 40.0, 1.0)])).alias("score"),
                                             R.audit_class(price >= 20_000, hard, X.all_reasons([("customer", c % 4 == 0)])).alias("audit"))


@query("p13_movement_labels", """with m as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) nxt, l_quantity, l_discount, l_tax from lineitem),
    r as (select l_suppkey, avg(l_discount) ref, count(*) n from lineitem group by 1)
    select m.l_orderkey, m.l_linenumber, m.l_partkey, round(l_discount / (l_discount + 0.05), 6) dynamic, round((l_quantity / 50) / (l_quantity / 50 + 1), 6) exposure, case when n >= 10 then round(greatest(l_discount / ref - 1, 0) / (1 + greatest(l_discount / ref - 1, 0)), 6) end slow,
    case when nxt is null then null when nxt = l_suppkey then 0.0::double else 1.0::double end turn from m join r using (l_suppkey)""")
def _(spark, sf):
    """Five dimensions become four here: dynamic, exposure, excess over the link's own reference, and movement."""
    from pyspark.sql import Window

    l = table(spark, sf, "lineitem")
    ref = l.groupBy("l_suppkey").agg(F.avg("l_discount").alias("ref"), F.count("*").alias("n"))
    w = Window.partitionBy("l_orderkey").orderBy(*_ROUTE.split(", "))
    m = l.withColumn("nxt", F.lead("l_suppkey").over(w)).join(ref, "l_suppkey")
    slow = X.bounded(X.excess(F.try_divide(F.col("l_discount"), F.col("ref"))), 1.0)
    return m.select("l_orderkey", "l_linenumber", "l_partkey", r6(X.bounded(F.col("l_discount"), 0.05)).alias("dynamic"), r6(X.bounded(F.col("l_quantity") / 50, 1.0)).alias("exposure"),
                    F.when(F.col("n") >= 10, r6(slow)).alias("slow"), F.when(F.col("nxt").isNull(), None).when(F.col("nxt") == F.col("l_suppkey"), 0.0).otherwise(1.0).alias("turn"))


@query("p14_p18_p19_states", """with s as (select o_orderkey, case when o_orderstatus <> 'P' then o_totalprice / 150000 end a, case when o_custkey % 6 > 0 then (o_custkey % 60) / 50 end b from orders)
    select o_orderkey, case when a is not null then a >= 0.9 end tail, round(case when a is not null and b is not null then greatest(a, b) end, 6) used, case when coalesce(a > 1, false) or coalesce(b > 1, false) then 'INFEASIBLE' when a is null or b is null then 'UNKNOWN' else 'FEASIBLE' end state from s""")
def _(spark, sf):
    from waymark.operators.labels import tail_event

    a = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 150_000)
    b = F.when(F.col("o_custkey") % 6 > 0, (F.col("o_custkey") % 60) / 50)
    state = X.hard_state(X.all_reasons([("a", a > 1), ("b", b > 1)]), X.all_reasons([("no_a", a.isNull()), ("no_b", b.isNull())]))
    return table(spark, sf, "orders").select("o_orderkey", tail_event(a, 0.9).alias("tail"), r6(X.utilization([a, b], [F.lit(1.0), F.lit(1.0)])).alias("used"), state.alias("state"))


@query("p16_unknown_reasons", """with r as (select user_id, count(*) n, count(distinct cast(ts as date)) d, quantile_cont(value, 0.2) q from events where event_type = 'view' and user_id % 7 > 0 group by 1), u as (select user_id, avg(value) p from events group by 1)
    select user_id, case when not coalesce(p > 40, false) then 'invalid_prediction' when n is null then 'no_reference' when q is null or q <= 0 then 'invalid_reference' when n < 150 and d < 28 then 'low_count_and_days' when n < 150 then 'low_count' when d < 28 then 'low_days' else 'not_unknown' end reason from u left join r using (user_id)""")
def _(spark, sf):
    e = events(spark, sf)
    ref = e.where("event_type = 'view' and user_id % 7 > 0").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("d"), F.percentile("value", F.lit(0.2)).alias("q"))
    u = e.groupBy("user_id").agg(F.avg("value").alias("p")).join(ref, "user_id", "left")
    return u.select("user_id", R.unknown_reason(F.col("p") > 40, F.col("d"), F.col("q"), F.col("n"), 150, 28).alias("reason"))


@query("p17_turns", """with t as (select l_orderkey, l_linenumber, l_partkey, ['A', 'M', 'C'][l_suppkey % 3 + 1] pr, ['STRAIGHT', 'RIGHT', 'LEFT', 'UTURN', 'OTHER'][l_partkey % 5 + 1] tu, ['SIGNALIZED', 'STOP_OR_YIELD_CONTROLLED', 'UNKNOWN_CONTROL'][l_linenumber % 3 + 1] co, l_returnflag = 'R' ro, l_discount > 0.09 ph from lineitem)
    select l_orderkey, l_linenumber, l_partkey, case when ph or (ro and pr = 'C') then 'INCOMPATIBLE' when tu in ('STRAIGHT', 'RIGHT') then 'COMPATIBLE' when tu = 'LEFT' then case when pr in ('M', 'A') or co = 'SIGNALIZED' then 'COMPATIBLE' when co = 'STOP_OR_YIELD_CONTROLLED' then 'INCOMPATIBLE' else 'UNKNOWN' end
    when tu = 'UTURN' then case when pr = 'A' then 'COMPATIBLE' else 'INCOMPATIBLE' end else 'UNKNOWN' end state from t""")
def _(spark, sf):
    at = lambda names, c, n: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % n + 1).cast("int"))
    state = R.turn_compatible(at("AMC", "l_suppkey", 3), at(("STRAIGHT", "RIGHT", "LEFT", "UTURN", "OTHER"), "l_partkey", 5), at(("SIGNALIZED", "STOP_OR_YIELD_CONTROLLED", "UNKNOWN_CONTROL"), "l_linenumber", 3),
                              F.col("l_returnflag") == "R", F.col("l_discount") > 0.09)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", state.alias("state"))


@query("p23_timing_flags", """with t as (select event_id, value gap, case when event_id % 10 > 0 then value * (event_id % 5) / 2 end raw, value * (event_id % 7) / 3 cor from events), v as (select *, coalesce(gap >= 0 and raw >= 0 and cor >= 0, false) ok from t)
    select event_id, ok and coalesce(raw <= gap, false) raw_fits, ok and coalesce(cor <= gap, false) corrected_fits, ok and coalesce(cor <= gap and cor > 30, false) corrected_hold, ok and coalesce(raw <= gap and raw > 30, false) raw_hold,
    ok and coalesce(raw <= gap and cor > gap, false) only_corrected_late, ok and coalesce(raw <= 30 and cor > 30, false) only_corrected_impatient from v""")
def _(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    flags = R.timing_flags(v, F.when(k % 10 > 0, v * (k % 5) / 2), v * (k % 7) / 3, 30.0)
    return events(spark, sf).select("event_id", *[c.alias(n) for n, c in flags.items()])


@query("f3_turns", """with a as (select event_id, (event_id * 37) % 360 h1, value h2 from events), d as (select event_id, ((h2 - h1) % 360 + 360) % 360 m from a), w as (select event_id, case when m > 180 then m - 360 else m end d from d)
    select event_id, round(d, 6) difference, case when abs(d) < 35 then 'straight' when abs(d) > 150 then 'u_turn' when d > 0 then 'right' else 'left' end turn from w""")
def _(spark, sf):
    d = X.angle_difference((F.col("event_id") * 37) % 360, F.col("value"))
    return events(spark, sf).select("event_id", r6(d).alias("difference"), X.turn_class(d).alias("turn"))


@query("f6_f10_f11_f13_keys", """select event_id, cast(greatest(0, least(95, floor((epoch_us(ts) / 1e6 - 1704067200) / 900))) as bigint) day_bin, case when contains(lower(event_type), 'view') then 'look' when contains(lower(event_type), 'purch') then 'buy' else 'other' end category,
    (select min_by(g, abs(g - value) * 1000 + g / 1000) from unnest([10.0, 30.0, 50.0, 80.0, 120.0]) t(g))::double nearest, event_type || '|' || (hour(ts) * 2 + minute(ts) // 30) || '|' || case when dayofweek(ts) in (0, 6) then 'weekend' else 'weekday' end kind_bin from events""")
def _(spark, sf):
    cal = X.local_calendar(F.col("ts"), "UTC")
    keys = X.cohort_keys(F.col("user_id"), F.col("event_type"), cal["time_bin"], cal["weekday_type"], cal["peak"])
    return events(spark, sf).select(
        "event_id", X.day_bin(X.micros(F.col("ts")) / 1e6 - 1704067200, 900).alias("day_bin"), X.keyword_category(F.col("event_type"), [("look", ["view"]), ("buy", ["purch"])]).alias("category"),
        X.nearest_of(F.col("value"), [10.0, 30.0, 50.0, 80.0, 120.0]).alias("nearest"), keys["kind_bin"].alias("kind_bin"))
