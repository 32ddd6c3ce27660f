"""Column expressions: cleaning, calendar, geometry, ratios, reasons and hash draws. Missing stays missing."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def no_nan(x: Column) -> Column:
    """NaN as null, as Spark would compare NaN as the largest number."""
    return F.when(~F.isnan(x), x)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), use)[0]


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, also of timestamps without a zone (read as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres (F2)."""
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def angle_difference(a: Column, b: Column) -> Column:
    """b - a wrapped to (-180, 180]."""
    turned = F.pmod(b - a, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def turn_class(difference: Column, straight: float = 35.0, back: float = 150.0) -> Column:
    """straight, left, right or u_turn of an angular difference in degrees."""
    size = F.abs(difference)
    return (F.when(difference.isNull(), None).when(size < straight, "straight").when(size > back, "u_turn")
            .when(difference > 0, "right").otherwise("left"))


def grid_cell(x: Column, y: Column, cell: float, x0: float = 0.0, y0: float = 0.0) -> Column:
    """``gx_gy`` of a square grid, MISSING without a position."""
    gx, gy = (F.floor((v - v0) / cell).cast("long") for v, v0 in ((x, x0), (y, y0)))
    return F.when(x.isNull() | y.isNull(), "MISSING").otherwise(F.concat_ws("_", gx, gy))


def local_calendar(ts: Column, zone: str = "Asia/Shanghai", minutes: int = 30) -> dict[str, Column]:
    """Local time bin, weekday type and peak flag."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    hour = F.hour(local)
    weekend = F.dayofweek(local).isin(1, 7)
    return {
        "time_bin": F.floor((hour * 60 + F.minute(local)) / minutes).cast("long"),
        "weekday_type": F.when(weekend, "weekend").otherwise("weekday"),
        "peak": ~weekend & (hour.between(7, 8) | hour.between(17, 18)),
        "date": F.date_format(local, "yyyyMMdd"),
    }


def day_bin(seconds: Column, width_s: int) -> Column:
    """Index of a bin of the day, clipped to the day."""
    last = 86_400 // width_s - 1
    return F.greatest(F.lit(0), F.least(F.lit(last), F.floor(seconds / width_s))).cast("long")


def seeded_hash(seed: str | int, *keys: Column, separator: str = "|") -> Column:
    """SHA-256 of a seed and keys, hex."""
    return F.sha2(F.concat_ws(separator, F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def hash_uniform(seed: str | int, *keys: Column, separator: str = "|") -> Column:
    """A number in [0, 1): the first 13 hex digits, exact in a double."""
    return F.conv(F.substring(seeded_hash(seed, *keys, separator=separator), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def hash_modulo(seed: str | int, key: Column, n: int) -> Column:
    """The full 256-bit hash modulo n, folded digit group by digit group."""
    digest = seeded_hash(seed, key)
    groups = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)])
    return F.aggregate(groups, F.lit(0).cast("long"), lambda a, g: (a * (2**32 % n) + g) % n)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first failing rule's code, null if none fails (P3). Unknown (null) doesn't fail."""
    return reduce(lambda out, rule: out.when(rule[1], rule[0]), rules[1:], F.when(rules[0][1], rules[0][0]))


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Codes of all failing rules, in order."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))


def hard_state(hard: Column, unknown: Column) -> Column:
    """INFEASIBLE, UNKNOWN or FEASIBLE from arrays of reasons."""
    return F.when(F.size(hard) > 0, "INFEASIBLE").when(F.size(unknown) > 0, "UNKNOWN").otherwise("FEASIBLE")


def bounded(value: Column, scale: float) -> Column:
    """x / (x + s) for x >= 0."""
    return value / (value + F.lit(scale))


def mean_present(parts: list[Column]) -> Column:
    """The mean of those values that are there; null if none is."""
    return F.try_divide(sum(F.coalesce(p, F.lit(0.0)) for p in parts), sum(p.isNotNull().cast("int") for p in parts))


def weighted_components(parts: list[tuple[Column, float]]) -> Column:
    """Weighted sum that needs every component."""
    return reduce(lambda a, b: a + b, [c * F.lit(w) for c, w in parts])


def all_or_null(columns: list[Column], combine) -> Column:
    """``combine(*columns)``, null if any is null: greatest() and least() alone skip nulls."""
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]), combine(*columns))


def utilization(observed: list[Column], caps: list[Column]) -> Column:
    """Largest observed / cap, unclipped, null if any is missing."""
    return all_or_null([F.try_divide(o, c) for o, c in zip(observed, caps, strict=True)], F.greatest)


def excess(ratio: Column) -> Column:
    """max(ratio - 1, 0), null stays null (P20)."""
    return F.when(ratio.isNotNull(), F.greatest(ratio - 1, F.lit(0.0)))


def right_closed_bucket(value: Column, edges: list[float]) -> Column:
    """Index of the bin (edge[i-1], edge[i]]."""
    out = F.when(value.isNull(), None)
    for i, edge in enumerate(edges):
        out = out.when(value <= edge, i)
    return out.otherwise(len(edges)).cast("long")


def keyword_category(text: Column, rules: list[tuple[str, list[str]]], default: str = "other") -> Column:
    """The first category one of whose keywords occurs in the lower-cased text."""
    lower = F.lower(text)
    hit = lambda ks: reduce(lambda a, b: a | b, [F.contains(lower, F.lit(k)) for k in ks])
    return F.coalesce(first_reason([(name, hit(ks)) for name, ks in rules]), F.lit(default))


def nearest_of(value: Column, grid: list[float]) -> Column:
    """The grid value at the least distance, the smaller on a tie."""
    return F.array_min(F.transform(F.array(*map(F.lit, grid)), lambda g: F.struct(F.abs(g - value).alias("d"), g.alias("v"))))["v"]


def cohort_keys(user: Column, kind: Column, time_bin: Column, weekday: Column, peak: Column) -> dict[str, Column]:
    """Keys of six fallback levels, narrowest first."""
    cat = lambda *c: F.concat_ws("|", *[x.cast("string") for x in c])
    return {"user_bin": cat(user, time_bin, weekday), "user_peak": cat(user, peak), "user": cat(user),
            "kind_bin": cat(kind, time_bin, weekday), "kind": cat(kind), "global": F.lit("all")}
