"""Routes for riders, end to end: positions in, paths with scores, pieces and warnings out."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import duration_s, edge_cost, is_allowed, is_over, round_places, turn_cost
from ..operators import network, routes
from ..operators.landmarks import LANDMARKS, landmark_table
from ..operators.paths import route_requests
from ..operators.spatial import snap
from ..operators.ways import numbered
from ..profiles import PROFILES, Profile
from ..storage import stash


def cost_table(edges: DataFrame, p: Profile, night: bool = False, hazards: DataFrame | None = None) -> DataFrame:
    """``edge_id, from_node, to_node, length_m, cost, allowed, over`` for one rider."""
    score = None
    if hazards is not None:
        edges, score = edges.join(hazards.select("edge_id", "hazard_score"), "edge_id", "left"), F.col("hazard_score")
    return edges.select("edge_id", "from_node", "to_node", "length_m", edge_cost(p, night, score).alias("cost"), is_allowed(p, F.col("lts")).alias("allowed"), is_over(p, F.col("lts")).alias("over"))


def turn_table(edges: DataFrame, nodes: DataFrame, p: Profile) -> DataFrame:
    """``in_edge, out_edge, turn_cost`` for one rider."""
    c = F.col
    cost = turn_cost(p, c("kind"), c("node_max_lts"), c("control"), c("infra_in"), c("infra_out"))
    return network.turns(edges, nodes).select("in_edge", "out_edge", cost.alias("turn_cost"))


def plan_nodes(requests: DataFrame, edges: DataFrame, nodes: DataFrame, profile: str | Profile = "comfortable", night: bool = False, hazards: DataFrame | None = None, n_alternatives: int = 0, exact: bool = False, landmarks: DataFrame | None = None) -> DataFrame:
    """Routes between nodes (``query_id, from_node, to_node``): the columns of
    :func:`~spokewise.operators.paths.route_requests`. ``landmarks`` are those of the same profile, by day or night and
    with or without hazards (:func:`landmarks_for` makes them by day without any, which serves all)."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    return route_requests(requests, cost_table(edges, p, night, hazards), turn_table(edges, nodes, p), nodes, p.stress_budget_m, exact=exact, n_alternatives=n_alternatives, landmarks=landmarks)


def landmarks_for(edges: DataFrame, nodes: DataFrame, profile: str | Profile = "comfortable", n: int = LANDMARKS, main: DataFrame | None = None) -> DataFrame:
    """``edge_id, marks``: what bounds a rider's long trips; to be written once and given to every plan."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    return landmark_table(cost_table(edges, p), turn_table(edges, nodes, p), nodes, n, main)


#: What a leg may come to, from good to bad: a wider search may mend the second, another profile the third.
STATUSES = ["ok", "search_limit", "unroutable", "unknown_node"]


def worst_status(status: Column) -> Column:
    """Of several legs' statuses the worst, in the order of ``STATUSES``."""
    order = F.array(*map(F.lit, STATUSES))
    return F.element_at(order, F.max(F.array_position(order, status)).cast("int"))


def legs_of(snapped: DataFrame) -> DataFrame:
    """``query_id, pos, from_node, to_node`` of neighbouring waypoints (``query_id, pos, node``)."""
    a = snapped.select("query_id", "pos", F.col("node").alias("from_node"))
    b = snapped.select("query_id", (F.col("pos") - 1).alias("pos"), F.col("node").alias("to_node"))
    return a.join(b, ["query_id", "pos"])


def failure(p: Profile, status: Column) -> Column:
    """What a plan that isn't ``ok`` failed by: ``code, message, details``, naming the constraint; null for ``ok``.

    ``unroutable`` is the code of all failures that another request may mend.
    """
    limit = f"at most {p.stress_budget_m:.0f} m above stress level {p.max_lts}" if p.stress_budget_m > 0 else f"no edge above stress level {p.max_lts}"
    said = {
        "unroutable": f"no way was found with {limit}",
        "search_limit": f"the search with {limit} was given up at its limit of labels",
        "unknown_node": "a waypoint is no node of the graph",
        "snap_failed": "a waypoint is too far from every edge",
        "same_point": "all waypoints are at one node",
    }
    details = {"max_lts": str(p.max_lts), "stress_budget_m": f"{p.stress_budget_m:.0f}", "hint": "a larger stress_budget_m, or a profile that bears more traffic stress"}
    message = F.element_at(F.create_map(*(F.lit(x) for kv in said.items() for x in kv)), status)
    constrained = F.when(status.isin("unroutable", "search_limit"), F.create_map(*(F.lit(x) for kv in details.items() for x in kv)))
    return F.when(status != "ok", F.struct(F.lit("unroutable").alias("code"), message.alias("message"), constrained.alias("details")))


def random_pairs(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``query_id, from_node, to_node``: ``n`` pairs of different nodes with edges out of them, the same for a seed."""
    starts = numbered(edges.select("from_node").distinct(), "i", ["from_node"]).select("i", F.col("from_node").alias("node"))
    total = starts.count()
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(max(total, 1)))
    drawn = edges.sparkSession.range(2 * n + 20).select("id", draw(0).alias("a"), draw(1).alias("b")).where("a <> b").orderBy("id").limit(n)
    a, b = (starts.select(F.col("i").alias(k), F.col("node").alias(c)) for k, c in (("a", "from_node"), ("b", "to_node")))
    return drawn.join(a, "a").join(b, "b").select(F.col("id").alias("query_id"), "from_node", "to_node")


def bench_routing(edges: DataFrame, nodes: DataFrame, n: int = 100, profile: str = "comfortable", seed: int = 42) -> DataFrame:
    """One row for each form of the search, guided or not and with the stress budget or not: ``form, seconds`` of the
    whole batch, ``ms_a_route``, and :func:`~spokewise.operators.routes.search_summary` of the labels met."""
    p = PROFILES[profile]
    pairs = stash(random_pairs(edges, n, seed), "pairs")
    costs, turns = stash(cost_table(edges, p), "costs"), stash(turn_table(edges, nodes, p), "turns")
    out = None
    for name, places, budget in (("plain", None, p.stress_budget_m), ("guided", nodes, p.stress_budget_m), ("plain, no budget", None, 0.0), ("guided, no budget", nodes, 0.0)):
        begun = time.perf_counter()
        found = route_requests(pairs, costs, turns, places, budget)
        took = time.perf_counter() - begun
        row = routes.search_summary(found).select(F.lit(name).alias("form"), F.lit(took).alias("seconds"), (F.lit(took * 1000) / F.nullif("routed", F.lit(0))).alias("ms_a_route"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def plan_route(waypoints: DataFrame, edges: DataFrame, nodes: DataFrame, profile: str | Profile = "comfortable", night: bool = False, hazards: DataFrame | None = None, main: DataFrame | None = None, n_alternatives: int = 0, exact: bool = False, landmarks: DataFrame | None = None) -> DataFrame:
    """One row for each ``query_id`` of ``waypoints`` (``query_id, pos`` from 0, ``lat, lon``), with ``choice`` 0, and
    up to ``n_alternatives`` more for those of two waypoints.

    Waypoints are put at nodes, neighbours joined by legs, each with the whole stress budget and no turn
    between them. ``status`` is ``ok``, ``snap_failed``, ``same_point`` or the worst of the legs, with ``error``
    (:func:`failure`); then totals, score, breakdown, segments, geometry, and the length and score of the
    shortest route beside (null if there is none). ``landmarks`` of the profile (:func:`landmarks_for`) guide the legs.
    """
    p = PROFILES[profile] if isinstance(profile, str) else profile
    points = waypoints.withColumn("point_id", F.struct("query_id", "pos"))
    put = snap(points, edges, main).select("point_id.query_id", "point_id.pos", "node", "distance_m")
    wanted = waypoints.groupBy("query_id").agg(F.count("*").alias("_points"))
    found = put.groupBy("query_id").agg(F.count("*").alias("_put"), F.max("distance_m").alias("snap_m"))
    legs = legs_of(put).withColumn("leg_id", F.xxhash64("query_id", "pos"))
    legs = legs.join(wanted, "query_id").withColumn("with_alternatives", F.col("_points") == 2).drop("_points")
    ask = legs.select(F.col("leg_id").alias("query_id"), "from_node", "to_node", "with_alternatives")
    own = ["leg_id", "choice", "status", "edges", "cost", "length_m", "budget_used_m"]
    got = plan_nodes(ask, edges, nodes, p, night, hazards, n_alternatives, exact, landmarks).withColumnRenamed("query_id", "leg_id").select(*own).join(legs.select("leg_id", "query_id", "pos"), "leg_id")
    shortest = plan_nodes(ask, edges, nodes, "shortest").select(F.col("query_id").alias("leg_id"), "edges", F.col("length_m").alias("base_m")).join(legs.select("leg_id", "query_id", "pos"), "leg_id")
    base = shortest.groupBy("query_id").agg(F.when(F.count("base_m") == F.count("*"), F.sum("base_m")).alias("baseline_m"))
    beside = shortest.where("edges IS NOT NULL").select("query_id", F.posexplode("edges").alias("pos", "edge_id"))
    base = base.join(routes.safety_score(beside, edges).withColumnRenamed("score", "baseline_score"), "query_id", "left")
    whole = got.groupBy("query_id", "choice").agg(
        worst_status(F.col("status")).alias("_status"),
        F.sum("cost").alias("cost"), F.sum("length_m").alias("length_m"), F.sum("budget_used_m").alias("budget_used_m"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "edges"))), lambda x: x["edges"])).alias("edges"),
    )
    out = wanted.join(found, "query_id", "left").join(whole, "query_id", "left").join(base, "query_id", "left")
    failed = F.coalesce(F.col("_put"), F.lit(0)) < F.col("_points")
    state = F.when(failed, F.lit("snap_failed")).when((F.col("_status") == "ok") & (F.size("edges") == 0), F.lit("same_point"))
    out = out.withColumn("status", state.otherwise(F.coalesce("_status", F.lit("unroutable"))))
    good = F.col("status") == "ok"
    # a route's key is the pair of both until the end
    key = F.struct("query_id", F.coalesce("choice", F.lit(0)).alias("choice")).alias("query_id")
    out = out.select(key, "status", failure(p, F.col("status")).alias("error"), "snap_m", *(F.when(good, F.col(c)).alias(c) for c in ("edges", "cost", "length_m", "budget_used_m", "baseline_m", "baseline_score")))
    out = stash(out, "plans")
    path = routes.long_form(out.where("edges IS NOT NULL"))
    shapes = edges.select("edge_id", F.size("shape").alias("n_points"))
    runs = routes.segments(path, edges, shapes)
    runs = runs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("run", "start", "end", "lts", "infra_class", "length_m"))).alias("segments"))
    for part in (routes.safety_score(path, edges), routes.breakdown(path, edges, hazards), runs, routes.geometry(path, edges)):
        out = out.join(part, "query_id", "left")
    detour = round_places(F.col("length_m") / F.nullif(F.col("baseline_m"), F.lit(0.0)), 2)
    warning = F.when(detour > p.max_detour, F.format_string("%.2f times the shortest route; %.2f was asked for", detour, F.lit(p.max_detour)))
    rest = [c for c in out.columns if c != "query_id"]
    return out.select("query_id.query_id", "query_id.choice", *rest, duration_s(F.col("length_m")).alias("duration_s"), detour.alias("detour"), warning.alias("warning"))
