"""Road classes and the level of traffic stress, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def named(value: Column, table: dict, other) -> Column:
    """A lookup in a small fixed table."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value), F.lit(other))


def road_class(highway: Column) -> Column:
    """The class of a highway tag; links count as their road."""
    return named(highway, {h: h for h in P.HIGHWAYS} | {f"{h}_link": h for h in P.LINKS}, "other")


def surface_class(surface: Column) -> Column:
    return named(surface, {tag: name for name, tags in P.SURFACES.items() for tag in tags}, "unknown")


def infra_name(infra: Column) -> Column:
    return F.when(infra.isin(P.INFRA), infra).otherwise(F.lit("none"))


def control_name(control: Column) -> Column:
    return F.when(control.isin(P.CONTROLS), control).otherwise(F.lit("none"))


def is_separated(infra: Column) -> Column:
    return F.coalesce(infra.isin(P.SEPARATED), F.lit(False))


def effective_speed(highway: Column, speed: Column) -> Column:
    return F.coalesce(F.when(speed > 0, speed.cast("int")), named(road_class(highway), P.DEFAULT_SPEED, P.OTHER_SPEED))


def effective_lanes(highway: Column, lanes: Column) -> Column:
    return F.coalesce(F.when(lanes > 0, lanes.cast("int")), named(road_class(highway), P.DEFAULT_LANES, P.OTHER_LANES))


def traffic_stress(infra: Column, highway: Column, surface: Column, speed: Column, lanes: Column) -> Column:
    """Level of traffic stress, 1 to 4: off-street ways, then lanes, then mixed traffic."""
    infra, road = infra_name(infra), road_class(highway)
    s, n = effective_speed(highway, speed), effective_lanes(highway, lanes)
    rough = surface_class(surface).isin("loose", "bad")
    level = lambda x: F.lit(x).cast("short")
    buffered = F.when((s <= 30) & (n <= 3), level(1)).when(s <= 35, level(2)).when(s <= 45, level(3)).otherwise(level(4))
    painted = F.when((s <= 25) & (n <= 2), level(1)).when((s <= 30) & (n <= 3), level(2)).when((s <= 35) & (n <= 4), level(3)).otherwise(level(4))
    mixed = (
        F.when(road == "living_street", level(1))
        .when((road == "service") & (s <= 20), level(2))
        .when((n >= 6) | (s >= 45), level(4))
        .when(s >= 35, F.when(n >= 4, level(4)).otherwise(level(3)))
        .when(s >= 26, F.when(n >= 4, level(3)).otherwise(level(2)))
        .otherwise(F.when(n >= 4, level(3)).otherwise(level(1)))
    )
    return (
        F.when(infra == "protected_track", level(1))
        .when(infra == "path", F.when(rough, level(2)).otherwise(level(1)))
        .when(infra == "pedestrian", level(2))
        .when(infra == "buffered_lane", buffered)
        .when(infra == "painted_lane", painted)
        .otherwise(mixed)
    )
