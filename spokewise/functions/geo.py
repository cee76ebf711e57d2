"""Geodesy on the sphere, as Column expressions. Positions are doubles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import EARTH_RADIUS_M, TILE_ZOOM


def lit(x) -> Column:
    return F.lit(float(x))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres (haversine)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((p2 - p1) / 2), lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), lit(2))
    return lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(s > 1, lit(1)).otherwise(s)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, clockwise from north, in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def turn_angle_deg(from_bearing: Column, to_bearing: Column) -> Column:
    """Change of direction in [-180, 180); negative is to the left."""
    return (to_bearing - from_bearing + 540) % 360 - 180


def is_position(lat: Column, lon: Column) -> Column:
    """Whether both are there and in range."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def shape_length_m(shape: Column) -> Column:
    """Length of an array of structs ``lat, lon``."""
    legs = F.zip_with(
        F.slice(shape, 1, F.greatest(F.size(shape) - 1, F.lit(0))),
        F.slice(shape, 2, F.greatest(F.size(shape) - 1, F.lit(0))),
        lambda a, b: distance_m(a["lat"], a["lon"], b["lat"], b["lon"]),
    )
    return F.aggregate(legs, lit(0), lambda a, x: a + x)


def end_bearings(shape: Column) -> tuple[Column, Column]:
    """Bearings at the start and the end of a shape; points equal to the end one are passed over; null if all are."""
    first, last = F.get(shape, F.lit(0)), F.try_element_at(shape, F.lit(-1))
    after = F.filter(shape, lambda p: (p["lat"] != first["lat"]) | (p["lon"] != first["lon"]))
    before = F.filter(shape, lambda p: (p["lat"] != last["lat"]) | (p["lon"] != last["lon"]))
    a, b = F.try_element_at(after, F.lit(1)), F.try_element_at(before, F.lit(-1))
    return bearing_deg(first["lat"], first["lon"], a["lat"], a["lon"]), bearing_deg(b["lat"], b["lon"], last["lat"], last["lon"])


def fraction_along(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Where on a straight segment the nearest point to a position lies, in 0..1, on a local plane."""
    k = F.cos(F.radians(lat))
    dx, dy = (lon2 - lon1) * k, lat2 - lat1
    square = dx * dx + dy * dy
    t = ((lon - lon1) * k * dx + (lat - lat1) * dy) / F.when(square > 0, square)
    return F.coalesce(F.greatest(lit(0), F.least(lit(1), t)), lit(0))


def segment_distance_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres from a position to a straight segment."""
    t = fraction_along(lat, lon, lat1, lon1, lat2, lon2)
    return distance_m(lat, lon, lat1 + (lat2 - lat1) * t, lon1 + (lon2 - lon1) * t)


def shape_distance_m(lat: Column, lon: Column, shape: Column) -> Column:
    """Distance in metres from a position to a polyline."""
    n = F.greatest(F.size(shape) - 1, F.lit(1))
    per = F.zip_with(F.slice(shape, 1, n), F.slice(shape, F.least(F.lit(2), F.size(shape)), n), lambda a, b: segment_distance_m(lat, lon, a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.array_min(per)


def shape_fraction(lat: Column, lon: Column, shape: Column) -> Column:
    """How far along a polyline, as a share of its length in degrees, the nearest point to a position lies."""
    n = F.greatest(F.size(shape) - 1, F.lit(1))

    def leg(a: Column, b: Column) -> Column:
        t = F.coalesce(F.greatest(lit(0), F.least(lit(1), ((lon - a["lon"]) * (b["lon"] - a["lon"]) + (lat - a["lat"]) * (b["lat"] - a["lat"])) / F.nullif(F.pow(b["lon"] - a["lon"], lit(2)) + F.pow(b["lat"] - a["lat"], lit(2)), lit(0)))), lit(0))
        gap = F.hypot(lon - a["lon"] - t * (b["lon"] - a["lon"]), lat - a["lat"] - t * (b["lat"] - a["lat"]))
        return F.struct(gap.alias("gap"), t.alias("t"), F.hypot(b["lon"] - a["lon"], b["lat"] - a["lat"]).alias("length"))

    legs = F.zip_with(F.slice(shape, 1, n), F.slice(shape, F.least(F.lit(2), F.size(shape)), n), leg)
    start = F.struct(lit(0).alias("done"), lit(float("inf")).alias("gap"), lit(0).alias("at"))
    walked = F.aggregate(
        legs,
        start,
        lambda s, x: F.struct(
            (s["done"] + x["length"]).alias("done"),
            F.least(s["gap"], x["gap"]).alias("gap"),
            F.when(x["gap"] < s["gap"], s["done"] + x["t"] * x["length"]).otherwise(s["at"]).alias("at"),
        ),
    )
    return F.coalesce(walked["at"] / F.nullif(walked["done"], lit(0)), lit(0))


def tile_position(lat: Column, lon: Column, zoom: int = TILE_ZOOM) -> tuple[Column, Column]:
    """Fractional x and y of a Web Mercator tile."""
    n = float(2**zoom)
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n


def saturate(x: Column, k: float) -> Column:
    """0 up to 0, rising to 1; about 0.63 at ``k``."""
    return F.when(x > 0, F.least(lit(1), 1 - F.exp(-x / k))).otherwise(lit(0))


def point_wkt(lat: Column, lon: Column, srid: int | None = 4326) -> Column:
    """``POINT(lon lat)`` with seven decimals."""
    text = F.format_string("POINT(%.7f %.7f)", lon, lat)
    return F.concat(F.lit(f"SRID={srid};"), text) if srid else text


def shape_wkt(shape: Column, kind: str = "LINESTRING", srid: int | None = 4326) -> Column:
    """An array of positions as WKT; null for an empty one."""
    points = F.array_join(F.transform(shape, lambda p: F.format_string("%.7f %.7f", p["lon"], p["lat"])), ",")
    text = F.concat(F.lit(f"{kind}("), points, F.lit(")"))
    return F.when(F.size(shape) > 0, F.concat(F.lit(f"SRID={srid};"), text) if srid else text)


def points_wkt(points: Column, srid: int | None = 4326) -> Column:
    """An array of positions as ``MULTIPOINT``, each in brackets of its own; null for an empty one."""
    inner = F.array_join(F.transform(points, lambda p: F.format_string("(%.7f %.7f)", p["lon"], p["lat"])), ",")
    text = F.concat(F.lit("MULTIPOINT("), inner, F.lit(")"))
    return F.when(F.size(points) > 0, F.concat(F.lit(f"SRID={srid};"), text) if srid else text)


def line_geojson(shape: Column) -> Column:
    """A GeoJSON LineString, longitude first."""
    coordinates = F.transform(shape, lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")))


def shape_from_geojson(text: Column) -> Column:
    """Positions of a GeoJSON LineString or MultiPoint; null for other kinds or bad text."""
    got = F.from_json(text, "type string, coordinates array<array<double>>")
    ok = got["type"].isin("LineString", "MultiPoint") & F.forall(got["coordinates"], lambda c: F.size(c) >= 2)
    return F.when(ok, F.transform(got["coordinates"], lambda c: F.struct(c[1].alias("lat"), c[0].alias("lon"))))


def parse_bbox(text: Column) -> Column:
    """``minLon,minLat,maxLon,maxLat`` as a struct with an ``error`` that is null if it is good."""
    parts = F.split(text, ",")
    at = lambda i: F.trim(F.try_element_at(parts, F.lit(i))).try_cast("double")
    lon1, lat1, lon2, lat2 = (at(i) for i in (1, 2, 3, 4))
    error = (
        F.when(text.isNull() | (F.trim(text) == ""), F.lit("missing"))
        .when(F.size(parts) != 4, F.lit("wrong count"))
        .when(lon1.isNull() | lat1.isNull() | lon2.isNull() | lat2.isNull(), F.lit("not a number"))
        .when(~is_position(lat1, lon1) | ~is_position(lat2, lon2), F.lit("out of range"))
        .when((lon1 > lon2) | (lat1 > lat2), F.lit("wrong order"))
    )
    return F.struct(lon1.alias("min_lon"), lat1.alias("min_lat"), lon2.alias("max_lon"), lat2.alias("max_lat"), error.alias("error"))
