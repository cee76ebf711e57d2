"""Plan requests as a table: checked field by field, planned by profile, answered with a code each."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.updates import waypoint_problems
from ..profiles import DEFAULT, PROFILES, Profile, resolve
from .api import plan_route

REQUEST = "query_id long, waypoints array<struct<lat:double,lon:double>>, profile string, custom map<string,double>, night boolean"
#: The fields of a profile that a request may set.
FIELDS = [k for k in asdict(PROFILES[DEFAULT]) if k != "name"]
_ERROR = "struct<code:string,message:string,details:map<string,string>>"


def _custom_problems(custom: Column) -> Column:
    """What is wrong with the fields of a rider's own profile, as :meth:`Profile.problems` says it; fields that aren't
    given are those of ``shortest``."""
    bounds = {"max_lts": (1, 4), "stress_budget_m": (0, 20_000), "max_detour": (1, 10)}
    checks = []
    for k in FIELDS:
        low, high = bounds.get(k, (0, 10))
        value = F.try_element_at(custom, F.lit(k))
        bad = F.map_contains_key(custom, k) & ~F.coalesce(value.between(low, high) & ~F.isnan(value), F.lit(False))
        checks.append(F.when(bad, F.lit(f"{k} must be from {low} to {high}")))
    level = F.try_element_at(custom, F.lit("max_lts"))
    checks.append(F.when(level.between(1, 4) & (level != F.floor(level)), F.lit("max_lts must be a whole number")))
    unknown = F.array_sort(F.array_except(F.map_keys(custom), F.array(*map(F.lit, FIELDS))))
    return F.concat(F.array_compact(F.array(*checks)), F.transform(unknown, lambda k: F.concat(F.lit("unknown field "), k)))


def request_error() -> Column:
    """Null for a good request (``waypoints, profile, custom``), else ``code`` ``bad_request``, ``message`` and
    ``details``, which tell for each bad field what is wrong. An empty ``custom`` counts as none; with one the name of
    a profile isn't looked at."""
    own = F.coalesce(F.size("custom") > 0, F.lit(False))
    known = F.coalesce(F.col("profile"), F.lit("")).isin("", *PROFILES)
    said = {
        "waypoints": F.array_join(waypoint_problems(F.col("waypoints")), "; "),
        "profile": F.when(~own & ~known, F.concat(F.lit("unknown profile; known are "), F.lit(", ".join(sorted(PROFILES))))),
        "custom": F.when(own, F.array_join(_custom_problems(F.col("custom")), "; ")),
    }
    details = F.map_filter(F.create_map(*(x for k, v in said.items() for x in (F.lit(k), F.coalesce(v, F.lit(""))))), lambda _, v: v != "")
    return F.when(F.size(details) > 0, F.struct(F.lit("bad_request").alias("code"), F.lit("the request has fields that can't be used").alias("message"), details.alias("details")))


def not_found(asked: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` with ``error``: code ``not_found`` where the table has no row of the keys, else null."""
    there = table.select(*keys).distinct().withColumn("_there", F.lit(True))
    text = F.concat_ws(" ", *(F.concat_ws(" ", F.lit(k), F.col(k).cast("string")) for k in keys))
    gone = F.struct(F.lit("not_found").alias("code"), F.concat(F.lit("there is no "), text).alias("message"), F.lit(None).cast("map<string,string>").alias("details"))
    return asked.join(there, keys, "left").withColumn("error", F.when(F.col("_there").isNull(), gone)).drop("_there")


def _profiles(good: DataFrame, most: int) -> list[tuple[Profile, bool, Column]]:
    """Each different profile of the requests with the time of day, and the condition for its rows."""
    name, own = F.coalesce(F.nullif("profile", F.lit("")), F.lit(DEFAULT)), F.array_sort(F.map_entries(F.coalesce("custom", F.create_map().cast("map<string,double>"))))
    key = F.to_json(F.struct(F.when(F.size(own) == 0, name).alias("name"), own.alias("own"), F.coalesce("night", F.lit(False)).alias("night")))
    found = good.select(key.alias("key"), name.alias("name"), "custom", F.coalesce("night", F.lit(False)).alias("night")).dropDuplicates(["key"]).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} different profiles in one batch; plan them in several")
    out = []
    for r in found:
        custom = {k: int(v) if k == "max_lts" else v for k, v in (r.custom or {}).items()}
        out.append((resolve(r["name"], custom or None), r.night, key == r.key))
    return out


def plan_requests(requests: DataFrame, edges: DataFrame, nodes: DataFrame, hazards: DataFrame | None = None, main: DataFrame | None = None, n_alternatives: int = 0, most_profiles: int = 32) -> DataFrame:
    """The answer to each request (:data:`REQUEST`): :func:`~spokewise.plans.api.plan_route`'s row, or for one that
    fails its check a row with ``status`` ``bad_request`` and ``error``, all else null.

    Requests of one profile are planned together; a batch may hold ``most_profiles`` different ones, times of day
    included, and raises ``ValueError`` beyond that.
    """
    checked = requests.withColumn("_error", request_error())
    good = checked.where("_error IS NULL")
    bad = checked.where("_error IS NOT NULL").select("query_id", F.lit("bad_request").alias("status"), F.col("_error").cast(_ERROR).alias("error"))
    out = None
    for p, night, mine in _profiles(good, most_profiles):
        points = good.where(mine).select("query_id", F.posexplode("waypoints").alias("pos", "w")).select("query_id", "pos", "w.lat", "w.lon")
        got = plan_route(points, edges, nodes, p, night, hazards, main, n_alternatives)
        out = got if out is None else out.unionByName(got)
    return bad if out is None else out.withColumn("error", F.col("error").cast(_ERROR)).unionByName(bad, allowMissingColumns=True)
