"""Rules of roads and trips as column expressions: coordinates, tags, directions, masks, tiers and conflicts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.exprs import first_reason

# The ellipsoid and series of the GCJ-02 offset, and words that mean yes.
SEMI_MAJOR, MERIDIAN, ECCENTRICITY = 6_378_245.0, 6_335_552.717000426, 0.00669342162296594323
YES = ("1", "true", "yes", "y")


def _wave(angle: Column, terms: list[tuple[float, float]]) -> Column:
    """Two thirds of a sum of amplitude x sin(angle x pi / divisor)."""
    total = F.lit(0.0)
    for amplitude, divisor in terms:
        total = total + amplitude * F.sin(angle * (math.pi / divisor))
    return total * 2 / 3


def gcj02_to_wgs84(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Closed-form offset removed from GCJ-02 positions (F1)."""
    x, y = lon - 105.0, lat - 35.0
    common = _wave(x, [(20.0, 1 / 6), (20.0, 0.5)])
    north = (-100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + common
             + _wave(y, [(20.0, 1.0), (40.0, 3.0)]) + _wave(y, [(160.0, 12.0), (320.0, 30.0)]))
    east = (300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + common
            + _wave(x, [(20.0, 1.0), (40.0, 3.0)]) + _wave(x, [(150.0, 12.0), (300.0, 30.0)]))
    angle = F.radians(lat)
    magic = 1 - ECCENTRICITY * F.pow(F.sin(angle), 2)
    return (lon - east * 180 / (SEMI_MAJOR / F.sqrt(magic) * F.cos(angle) * math.pi),
            lat - north * 180 / (MERIDIAN / (magic * F.sqrt(magic)) * math.pi))


def parse_tags(text: Column) -> Column:
    """``"key"=>"value"`` pairs as a map; the last of equal keys counts (F8)."""
    pattern = F.lit(r'"((?:[^"\\]|\\.)*)"\s*=>\s*"((?:[^"\\]|\\.)*)"')
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    keys, values = (F.transform(F.regexp_extract_all(text, pattern, F.lit(i)), plain) for i in (1, 2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["k"]))
    return F.map_from_entries(last)


def parse_speed(text: Column) -> dict[str, Column]:
    """Kilometres an hour of a speed text: ``values`` and ``format`` (F8). mph is converted, several values are kept, anything else isn't guessed."""
    lower = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    pieces = F.filter(F.transform(F.split(lower, "[;|]"), lambda p: F.trim(p)), lambda p: p != "")
    shape = r"^([0-9]+(?:\.[0-9]+)?) *(km/h|kmh|kph|mph)?$"
    value = lambda p: F.regexp_extract(p, shape, 1).try_cast("double") * F.when(p.endswith("mph"), 1.609344).otherwise(1.0)
    known = (F.size(pieces) > 0) & F.forall(pieces, lambda p: p.rlike(shape))
    one = F.get(pieces, 0)
    kind = (F.when(lower == "", "missing").when(F.contains(lower, F.lit("@")), "conditional").when(~known, "named_or_non_numeric")
            .when(F.size(pieces) > 1, "multi_numeric").when(one.endswith("mph"), "mph").when(one.rlike("[a-z]$"), "kmh_unit").otherwise("numeric"))
    parsed = kind.isin("numeric", "kmh_unit", "mph", "multi_numeric")
    return {"format": kind, "values": F.when(parsed, F.transform(pieces, value)).otherwise(F.array().cast("array<double>"))}


def yes(text: Column) -> Column:
    """Whether a text means yes; missing means no."""
    return F.coalesce(F.lower(F.trim(text)).isin(*YES), F.lit(False))


def normal_oneway(text: Column, junction: Column, highway: Column) -> Column:
    """forward, reverse or both."""
    t = F.coalesce(F.lower(F.trim(text)), F.lit(""))
    return (F.when(t.isin("-1", "reverse"), "reverse")
            .when(yes(text) | F.coalesce(F.lower(junction) == "roundabout", F.lit(False)) | F.coalesce(F.lower(highway) == "motorway", F.lit(False)), "forward").otherwise("both"))


def normal_layer(text: Column, bridge: Column, tunnel: Column) -> Column:
    """The level; without a number 1 on bridges, -1 in tunnels, else 0."""
    return F.coalesce(F.trim(text).try_cast("double").cast("long"), F.when(yes(bridge), 1).when(yes(tunnel), -1).otherwise(0)).cast("long")


def directions(oneway: Column) -> Column:
    """Directions in which an edge may be driven, to explode."""
    return F.when(oneway == "forward", F.array(F.lit("F"))).when(oneway == "reverse", F.array(F.lit("R"))).otherwise(F.array(F.lit("F"), F.lit("R")))


def directed_id(uid: Column, direction: Column) -> Column:
    """``id:F`` or ``id:R``, whatever suffix the id had."""
    return F.concat_ws(":", F.regexp_replace(uid, ":[FR]$", ""), direction)


def reversed_id(uid: Column) -> Column:
    """The id of the opposite direction."""
    return directed_id(uid, F.when(uid.endswith(":R"), "F").otherwise("R"))


def unit_valid(value: Column, count: Column, least: int) -> Column:
    """Whether a target counts: enough observations and a value in [0, 1] (P5)."""
    return F.coalesce((count >= least) & ~F.isnan(value) & value.between(0, 1), F.lit(False))


def service_targets(source: Column, time_s: Column, distance_m: Column) -> dict[str, Column]:
    """Pace and its validity: directly observed rows of positive time and distance only."""
    ok = F.coalesce((source == "direct") & (time_s > 0) & (distance_m > 0), F.lit(False))
    return {"valid": ok, "time_s": F.when(ok, time_s), "pace": F.when(ok, time_s / distance_m)}


def timing_flags(gap: Column, raw: Column, corrected: Column, patience: float) -> dict[str, Column]:
    """Six comparisons of a gap, two travel times and a patience; all false where one is missing or negative."""
    valid = F.coalesce((gap >= 0) & (raw >= 0) & (corrected >= 0), F.lit(False))
    flag = lambda c: valid & F.coalesce(c, F.lit(False))
    return {"raw_fits": flag(raw <= gap), "corrected_fits": flag(corrected <= gap), "corrected_hold": flag((corrected <= gap) & (corrected > patience)),
            "raw_hold": flag((raw <= gap) & (raw > patience)), "only_corrected_late": flag((raw <= gap) & (corrected > gap)),
            "only_corrected_impatient": flag((raw <= patience) & (corrected > patience))}


def tier(strict: Column, analysis: Column) -> Column:
    """strict, analysis or rejected, where unknown doesn't pass."""
    return F.when(strict, "strict").when(analysis, "analysis").otherwise("rejected")


def risk_score(parts: list[tuple[Column, float, float]]) -> Column:
    """0 to 100: each part over its scale, clipped to [0, 1], times its weight; a missing part adds nothing."""
    total = F.lit(0.0)
    for value, scale, weight in parts:
        total = total + weight * F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / scale)), F.lit(0.0))
    return 100 * total / sum(w for _, _, w in parts)


def audit_class(eligible: Column, hard: Column, review: Column) -> Column:
    """Class from arrays of hard and review reasons; low information is set aside first (P10)."""
    return F.when(~eligible, "excluded_low_information").when(F.size(hard) > 0, "auto_fail").when(F.size(review) > 0, "manual_review").otherwise("auto_pass")


def unknown_reason(valid: Column, days: Column, reference: Column, count: Column, least_count: int, least_days: int) -> Column:
    """The one cause why a state is unknown."""
    few, short = count < least_count, days < least_days
    return F.coalesce(first_reason([
        ("invalid_prediction", ~F.coalesce(valid, F.lit(False))), ("no_reference", count.isNull()), ("invalid_reference", reference.isNull() | (reference <= 0)),
        ("low_count_and_days", few & short), ("low_count", few), ("low_days", short)]), F.lit("not_unknown"))


def turn_compatible(profile: Column, turn: Column, control: Column, roundabout: Column, prohibited: Column) -> Column:
    """COMPATIBLE, UNKNOWN or INCOMPATIBLE of a vehicle profile (A widest, then M, C) with a turn."""
    wide = profile.isin("M", "A")
    left = (F.when(wide | (control == "SIGNALIZED"), "COMPATIBLE").when(control == "STOP_OR_YIELD_CONTROLLED", "INCOMPATIBLE").otherwise("UNKNOWN"))
    return (F.when(prohibited | (roundabout & (profile == "C")), "INCOMPATIBLE").when(turn.isin("STRAIGHT", "RIGHT"), "COMPATIBLE")
            .when(turn == "LEFT", left).when(turn == "UTURN", F.when(profile == "A", "COMPATIBLE").otherwise("INCOMPATIBLE")).otherwise("UNKNOWN"))
