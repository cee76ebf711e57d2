"""What riding an edge or making a turn costs, in effective metres, as Column expressions.

Edges have ``length_m, lts, infra_class, surface, grade_pct, lit, crash_score`` and, where reports are taken
into account, ``hazard_score``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from ..profiles import Profile
from .geo import turn_angle_deg
from .roads import control_name, is_separated, named, surface_class


def by_level(lts: Column, values: list[float]) -> Column:
    """A value for each stress level; an unknown level counts as 0."""
    level = F.when(lts.between(1, 4), lts.cast("int")).otherwise(F.lit(0))
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), level + 1)


def grade_penalty(grade: Column) -> Column:
    """Climbs and descents beyond the deadband; steep descents cost more."""
    g = F.coalesce(grade.cast("double"), F.lit(0.0))
    climb = (g - P.GRADE_DEADBAND) * P.CLIMB_PER_PCT
    descent = (-g - P.GRADE_DEADBAND) * P.DESCENT_PER_PCT + F.when(-g >= P.STEEP_DESCENT, F.lit(P.STEEP_DESCENT_PENALTY)).otherwise(F.lit(0.0))
    return F.when(g > P.GRADE_DEADBAND, climb).when(g < -P.GRADE_DEADBAND, descent).otherwise(F.lit(0.0))


def is_over(p: Profile, lts: Column) -> Column:
    """Whether an edge is above the rider's level; an unscored one isn't."""
    return F.coalesce(lts > p.max_lts, F.lit(False))


def is_allowed(p: Profile, lts: Column) -> Column:
    return F.lit(p.stress_budget_m > 0) | ~is_over(p, lts)


def multiplier(p: Profile, night: bool = False, hazard: Column | None = None, prefix: str = "") -> Column:
    """Cost per metre, 1 at least."""
    c = lambda name: F.col(prefix + name)
    out = F.lit(1.0) + p.weight_lts * by_level(c("lts"), P.LTS_PENALTY)
    out = out + p.weight_crash * P.CRASH_SCALE * F.coalesce(c("crash_score").cast("double"), F.lit(0.0))
    out = out + F.when(is_over(p, c("lts")), F.lit(p.weight_lts * P.OVER_PENALTY)).otherwise(F.lit(0.0))
    out = out + p.weight_surface * named(surface_class(c("surface")), P.SURFACE_PENALTY, 0.0)
    out = out + p.weight_grade * grade_penalty(c("grade_pct"))
    if hazard is not None:
        out = out + p.weight_hazard * P.HAZARD_SCALE * F.coalesce(hazard.cast("double"), F.lit(0.0))
    if night:
        out = out + F.when(c("lit") == F.lit(False), F.lit(p.weight_lighting * P.UNLIT_PENALTY)).otherwise(F.lit(0.0))
    return out


def edge_cost(p: Profile, night: bool = False, hazard: Column | None = None, prefix: str = "") -> Column:
    return F.col(prefix + "length_m") * multiplier(p, night, hazard, prefix)


def turn_kind(is_uturn: Column, bearing_in: Column, bearing_out: Column) -> Column:
    angle = turn_angle_deg(F.coalesce(bearing_in, F.lit(0.0)), F.coalesce(bearing_out, F.lit(0.0)))
    return F.when(is_uturn, F.lit("u_turn")).when(angle <= -P.STRAIGHT_DEG, F.lit("left")).when(angle >= P.STRAIGHT_DEG, F.lit("right")).otherwise(F.lit("straight"))


def turn_cost(p: Profile, kind: Column, node_max_lts: Column, control: Column, infra_in: Column, infra_out: Column) -> Column:
    """A turn by its kind, what it crosses, its control, and whether it stays on separated ways."""
    cost = named(kind, P.TURN_BASE, P.TURN_BASE["straight"]) * by_level(node_max_lts, P.CROSSING_FACTOR) * named(control_name(control), P.CONTROL_FACTOR, 1.0)
    cost = cost * F.when(is_separated(infra_in) & is_separated(infra_out), F.lit(P.PROTECTED_FACTOR)).otherwise(F.lit(1.0))
    return p.weight_turn * F.when(kind == "u_turn", F.lit(P.UTURN_M)).otherwise(cost)


def duration_s(length_m: Column) -> Column:
    """Seconds at cruising speed, cut to whole ones."""
    return F.floor(length_m / 1000 / P.CRUISE_KMH * 3600).cast("int")


def round_places(x: Column, places: int) -> Column:
    """Half up, for values of 0 or more."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale
