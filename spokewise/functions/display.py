"""What riders are shown, as projections of numbers: bands, tones, distances, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def score_band(score: Column) -> Column:
    return F.when(score >= 80, F.lit("good")).when(score >= 60, F.lit("ok")).when(score >= 40, F.lit("warn")).when(score.isNotNull(), F.lit("bad"))


def budget_share(used_m: Column, budget_m: Column) -> Column:
    """Percent of the stress budget that is used, 100 at most; null without a budget."""
    return F.when(budget_m > 0, F.least(F.lit(100.0), used_m / budget_m * 100))


def budget_tone(share: Column) -> Column:
    return F.when(share >= 90, F.lit("bad")).when(share >= 60, F.lit("warn")).when(share.isNotNull(), F.lit("good"))


def extra_distance(length_m: Column, baseline_m: Column) -> Column:
    return F.when(length_m > baseline_m, length_m - baseline_m).when(length_m <= baseline_m, F.lit(0.0))


def snap_is_told(distance_m: Column) -> Column:
    """Whether a position was moved far enough to say so."""
    return distance_m >= P.SNAP_TOLD_M


def next_profile(name: Column) -> Column:
    """The next more tolerant profile, null at the top and for others."""
    return F.when(name == "cautious", F.lit("comfortable")).when(name == "comfortable", F.lit("confident"))


def padded(box: Column, share: float = 0.25) -> Column:
    """A box (``min_lon, min_lat, max_lon, max_lat``) grown by a share of its sides."""
    dx, dy = (box["max_lon"] - box["min_lon"]) * share, (box["max_lat"] - box["min_lat"]) * share
    return F.struct((box["min_lon"] - dx).alias("min_lon"), (box["min_lat"] - dy).alias("min_lat"), (box["max_lon"] + dx).alias("max_lon"), (box["max_lat"] + dy).alias("max_lat"))


def box_contains(outer: Column, inner: Column) -> Column:
    return (outer["min_lon"] <= inner["min_lon"]) & (outer["min_lat"] <= inner["min_lat"]) & (outer["max_lon"] >= inner["max_lon"]) & (outer["max_lat"] >= inner["max_lat"])


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def distance_text(m: Column, imperial: bool = False) -> Column:
    """Metres or feet when short, else kilometres or miles with a decimal below ten."""
    long = m / (P.M_PER_MILE if imperial else 1000.0)
    unit = "mi" if imperial else "km"
    text = F.when(long < 10, F.format_string(f"%.1f {unit}", long)).otherwise(F.format_string(f"%.0f {unit}", long))
    short = F.concat(_whole(m / P.M_PER_FOOT), F.lit(" ft")) if imperial else F.concat(_whole(m), F.lit(" m"))
    return F.when(long < 0.1 if imperial else m < 1000, short).otherwise(text)


def duration_text(seconds: Column) -> Column:
    mins = _whole(seconds / 60)
    hours, rest = F.floor(mins / 60), mins % 60
    return F.when(mins < 60, F.concat(mins, F.lit(" min"))).when(rest == 0, F.concat(hours, F.lit(" h"))).otherwise(F.concat(hours, F.lit(" h "), rest, F.lit(" min")))


def age_text(at: Column, as_of: Column) -> Column:
    """How long ago, at ``as_of``."""
    mins = _whole((F.unix_micros(as_of) - F.unix_micros(at)) / 6e7)
    hours = _whole(mins / 60)
    days = _whole(hours / 24)
    return (
        F.when(mins < 1, F.lit("just now")).when(mins < 60, F.concat(mins, F.lit(" min ago"))).when(hours < 24, F.concat(hours, F.lit(" h ago")))
        .when(days == 1, F.lit("yesterday")).otherwise(F.concat(days, F.lit(" days ago")))
    )


def expiry_text(at: Column, as_of: Column) -> Column:
    days = _whole((F.unix_micros(at) - F.unix_micros(as_of)) / 8.64e10)
    return F.when(days <= 0, F.lit("expiring now")).when(days == 1, F.lit("expires tomorrow")).otherwise(F.concat(F.lit("expires in "), days, F.lit(" days")))
