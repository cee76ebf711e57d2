"""Reading of map tags (``map<string,string>``): what a way or node means to a cyclist."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def tag(tags: Column, key: str) -> Column:
    """The value of a key; empty if there is none."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def is_truthy(v: Column) -> Column:
    return F.lower(F.trim(v)).isin(P.TRUTHY)


def is_falsy(v: Column) -> Column:
    return F.lower(F.trim(v)).isin(P.FALSY)


def tri_bool(v: Column) -> Column:
    """True, false, or null where the tag is absent or says neither."""
    return F.when(is_truthy(v), F.lit(True)).when(is_falsy(v), F.lit(False))


def max_speed_mph(v: Column) -> Column:
    """A speed limit in mph; a bare number is in km/h. Null for none, for names and for over 100."""
    text = F.trim(F.regexp_extract(F.lower(F.trim(v)), "^([^;@]*)", 1))
    number = F.regexp_extract(F.trim(F.regexp_replace(text, "mph|km/h|kmh|kph", "")), r"^(\S*)", 1).try_cast("double")
    mph = number * F.when(text.contains("mph"), F.lit(1.0)).otherwise(F.lit(0.621371))
    usable = ~text.isin("none", "signals", "walk") & ~text.startswith("variable") & (number > 0) & (mph <= 100)
    return F.when(usable, F.round(mph).cast("short"))


def lanes(v: Column) -> Column:
    """A number of lanes from 0 to 12, else null."""
    number = F.trim(F.split(v, ";")[0]).try_cast("double")
    return F.when(number.between(0, 12), F.round(number).cast("short"))


def directions(tags: Column) -> tuple[Column, Column]:
    """Whether a cyclist may ride the way forwards, and backwards."""
    oneway = F.lower(tag(tags, "oneway"))
    bike = tag(tags, "oneway:bicycle")
    only, against = is_truthy(oneway), oneway.isin("-1", "reverse")
    ring = tag(tags, "junction").isin("roundabout", "circular")
    forward = ~(against & ~only)
    backward = ~(only | ring)
    both = tag(tags, "cycleway").startswith("opposite")

    def last(general: Column, only_: bool, against_: bool) -> Column:
        return F.when(both, F.lit(True)).when(is_falsy(bike), F.lit(True)).when(is_truthy(bike), F.lit(only_)).when(bike.isin("-1", "reverse"), F.lit(against_)).otherwise(general)

    return last(forward, True, False), last(backward, False, True)


def node_control(tags: Column) -> Column:
    """How traffic is controlled at a node."""
    highway = tag(tags, "highway")
    crossing = tag(tags, "crossing")
    named = {"traffic_signals": "signal", "stop": "stop", "give_way": "yield", "crossing": "crossing"}
    out = F.when(F.lit(False), F.lit(""))
    for value, control in named.items():
        out = out.when(highway == value, F.lit(control))
    is_crossing = (crossing != "") | (tag(tags, "footway") == "crossing")
    return out.when(is_crossing & (is_truthy(tag(tags, "crossing:signals")) | (crossing == "traffic_signals")), F.lit("signal")).when(is_crossing, F.lit("crossing")).otherwise(F.lit("none"))


def routable(tags: Column) -> Column:
    """Whether a cyclist may ride the way. Classes in neither list are not routable."""
    highway, bicycle, access = tag(tags, "highway"), F.lower(tag(tags, "bicycle")), F.lower(tag(tags, "access"))
    allowed = bicycle.isin(P.BICYCLE_ALLOWED)
    barred = bicycle.isin(P.BICYCLE_BARRED) | (access.isin("no", "private") & ~allowed)
    barred |= (highway == "service") & F.lower(tag(tags, "service")).isin(P.EXCLUDED_SERVICE)
    return ~barred & F.when(highway.isin(P.PERMISSION_HIGHWAYS), allowed).otherwise(highway.isin(P.ALLOWED_HIGHWAYS))


def _cycleway_rank(tags: Column, key: str) -> Column:
    value = F.lower(F.trim(tag(tags, key)))
    marks = [tag(tags, k) for k in (f"{key}:buffer", f"{key}:separation", "cycleway:buffer", "cycleway:both:buffer", "cycleway:separation")]
    buffered = F.lit(False)
    for mark in marks:
        buffered |= (mark != "") & ~is_falsy(mark)
    rank = P.INFRA_RANK
    return (
        F.when(value.isin("track", "opposite_track", "sidepath"), F.lit(rank["protected_track"]))
        .when(value.isin("lane", "opposite_lane", "opposite"), F.when(buffered, F.lit(rank["buffered_lane"])).otherwise(F.lit(rank["painted_lane"])))
        .when(value.isin("shared_lane", "share_busway", "opposite_share_busway"), F.lit(rank["shared_lane"]))
        .otherwise(F.lit(0))
    )


def infra_class(tags: Column) -> Column:
    """The cycling facility of a way: by its class, else the best one attached to the road."""
    highway = tag(tags, "highway")
    best = F.greatest(*(_cycleway_rank(tags, k) for k in ("cycleway", "cycleway:both", "cycleway:left", "cycleway:right")))
    by_rank = F.array(*(F.lit(name) for name, _ in sorted(P.INFRA_RANK.items(), key=lambda x: x[1])))
    return (
        F.when(highway == "cycleway", F.lit("protected_track"))
        .when(highway.isin("path", "track"), F.lit("path"))
        .when(highway.isin(P.PERMISSION_HIGHWAYS), F.lit("pedestrian"))
        .otherwise(F.element_at(by_rank, best + 1))
    )


def way_attributes(tags: Column) -> list[Column]:
    """All attributes of a way that the safety model uses, named."""
    forward, backward = directions(tags)
    return [
        tag(tags, "highway").alias("highway"),
        F.nullif(tag(tags, "name"), F.lit("")).alias("name"),
        infra_class(tags).alias("infra_class"),
        F.nullif(F.lower(F.trim(tag(tags, "surface"))), F.lit("")).alias("surface"),
        max_speed_mph(tag(tags, "maxspeed")).alias("maxspeed_mph"),
        lanes(tag(tags, "lanes")).alias("lanes"),
        tri_bool(tag(tags, "lit")).alias("lit"),
        forward.alias("forward"),
        backward.alias("backward"),
    ]
