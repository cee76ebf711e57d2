"""Routes as tables, ``query_id, pos, edge_id``, and what is said about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.costs import by_level, is_over, round_places
from ..functions.geo import line_geojson
from ..profiles import Profile


def long_form(routes: DataFrame, *keys: str) -> DataFrame:
    """One row for each edge of a route: its keys, ``pos`` from 0, ``edge_id``."""
    return routes.select(*(keys or ("query_id",)), F.posexplode("edges").alias("pos", "edge_id"))


def ridden(path: DataFrame, edges: DataFrame) -> DataFrame:
    """The path with the attributes of its edges."""
    return path.join(edges, "edge_id")


def safety_score(path: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, score``: 100 for a wholly quiet route, 0 for one at level 4 or of no length."""
    l = F.col("length_m")  # noqa: E741
    score = 100 * F.sum(l * by_level(F.col("lts"), P.LTS_QUALITY)) / F.nullif(F.sum(l), F.lit(0.0))
    return ridden(path, edges).groupBy("query_id").agg(F.coalesce(score, F.lit(0.0)).alias("score"))


def breakdown(path: DataFrame, edges: DataFrame, hazards: DataFrame | None = None) -> DataFrame:
    """Metres of each route by level and facility, climbing, and exposure, to 0.1 m."""
    r = ridden(path, edges)
    r = r.join(hazards.select("edge_id", "hazard_score"), "edge_id", "left") if hazards is not None else r.withColumn("hazard_score", F.lit(0.0))
    level = F.element_at(F.array(*map(F.lit, P.LTS_NAMES)), F.when(F.col("lts").between(1, 4), F.col("lts").cast("int")).otherwise(F.lit(0)) + 1)
    l, grade = F.col("length_m"), F.coalesce(F.col("grade_pct").cast("double"), F.lit(0.0))  # noqa: E741
    rise = grade / 100 * l
    one = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 1)
    totals = r.groupBy("query_id").agg(
        one(l * F.coalesce(F.col("crash_score").cast("double"), F.lit(0.0))).alias("crash_exposure_m"),
        one(F.when(rise > 0, rise)).alias("climb_m"),
        one(F.when(rise <= 0, -rise)).alias("descent_m"),
        one(F.when(F.abs(grade) > P.GRADE_DEADBAND, l)).alias("steep_m"),
        one(F.when(F.col("hazard_score") > 0, l)).alias("hazard_m"),
    )

    def by(key, name: str) -> DataFrame:
        groups = r.groupBy("query_id", key.alias("k")).agg(F.round(F.sum(l), 1).alias("m"))
        return groups.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "m")))).alias(name))

    return totals.join(by(level, "by_lts_m"), "query_id").join(by(F.col("infra_class"), "by_infra_m"), "query_id")


def over_metres(path: DataFrame, edges: DataFrame, p: Profile) -> DataFrame:
    return ridden(path, edges).groupBy("query_id").agg(F.sum(F.when(is_over(p, F.col("lts")), F.col("length_m")).otherwise(0.0)).alias("over_m"))


def offsets(path: DataFrame, shapes: DataFrame) -> DataFrame:
    """Where each edge's points start and end in the joined geometry; neighbours share a point.

    ``shapes``: ``edge_id, n_points``. An edge of no points has a range of no length.
    """
    w = Window.partitionBy("query_id").orderBy("pos")
    joined = path.join(shapes, "edge_id").withColumn("_new", F.greatest(F.col("n_points") - 1, F.lit(0)))
    end = F.sum("_new").over(w)
    return joined.select("query_id", "pos", "edge_id", (end - F.col("_new")).cast("int").alias("start"), end.cast("int").alias("end"))


def missing_shapes(path: DataFrame, shapes: DataFrame) -> DataFrame:
    """Edges of routes that have no geometry."""
    return path.join(shapes.select("edge_id"), "edge_id", "left_anti")


def geometry(path: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, shape, geojson``: all edges' points in order, shared ones once."""
    joined = path.join(edges.select("edge_id", "shape"), "edge_id")
    ordered = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "shape"))).alias("parts"))
    filled = F.filter(F.transform("parts", lambda p: p["shape"]), lambda s: F.size(s) > 0)
    shape = F.flatten(F.transform(filled, lambda s, i: F.when(i == 0, s).otherwise(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))))))
    return ordered.select("query_id", shape.alias("shape")).withColumn("geojson", line_geojson(F.col("shape")))


def segments(path: DataFrame, edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """Runs of edges of one level and facility: ``query_id, run, start, end, lts, infra_class, length_m``.

    An edge without points of its own goes to the run before; such edges at the very start are dropped.
    """
    placed = offsets(path, shapes).join(edges.select("edge_id", F.coalesce("lts", F.lit(0)).cast("int").alias("lts"), "infra_class", "length_m"), "edge_id")
    w = Window.partitionBy("query_id").orderBy("pos")
    real = F.col("end") > F.col("start")
    kind = F.when(real, F.struct("lts", "infra_class"))
    placed = placed.withColumn("_kind", kind).withColumn("_before", F.last("_kind", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = real & (F.col("_before").isNull() | ~F.col("_kind").eqNullSafe(F.col("_before")))
    placed = placed.withColumn("run", F.sum(new.cast("int")).over(w)).where("run > 0")
    runs = placed.groupBy("query_id", "run").agg(
        F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.min_by("lts", "pos").alias("lts"), F.min_by("infra_class", "pos").alias("infra_class"), F.sum("length_m").alias("m")
    )
    return runs.select("query_id", (F.col("run") - 1).cast("int").alias("run"), "start", "end", "lts", "infra_class", round_places(F.col("m"), 1).alias("length_m"))


def shared_length(routes_a: DataFrame, routes_b: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, share``: the part of each route of ``routes_a`` whose edges its namesake in ``routes_b`` has."""
    other = routes_b.select("query_id", "edge_id").distinct().withColumn("_in", F.lit(True))
    joined = routes_a.join(edges.select("edge_id", "length_m"), "edge_id").join(other, ["query_id", "edge_id"], "left")
    share = F.sum(F.when(F.col("_in"), F.col("length_m")).otherwise(0.0)) / F.nullif(F.sum("length_m"), F.lit(0.0))
    return joined.groupBy("query_id").agg(share.alias("share"))


def path_cost(path: DataFrame, costs: DataFrame, turns: DataFrame) -> DataFrame:
    """``query_id, cost, length_m``: edges and the turns between them, added up."""
    w = Window.partitionBy("query_id").orderBy("pos")
    steps = path.withColumn("in_edge", F.lag("edge_id").over(w)).join(costs.select("edge_id", "cost", "length_m"), "edge_id")
    joined = steps.join(turns.select("in_edge", F.col("out_edge").alias("edge_id"), "turn_cost"), ["in_edge", "edge_id"], "left")
    return joined.groupBy("query_id").agg(F.sum(F.col("cost") + F.coalesce("turn_cost", F.lit(0.0))).alias("cost"), F.sum("length_m").alias("length_m"))


def search_summary(found: DataFrame) -> DataFrame:
    """One row on searches (``status, expansions``): routed, and mean, middle and 95th expansions of those.

    Of ``n`` searches in order, counted from 0, the middle one is number n / 2 and the 95th is 0.95 n, rounded down.
    """
    ok = "CASE WHEN status = 'ok' THEN expansions END"
    at = lambda share, name: F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {ok} DESC)").cast("long").alias(name)
    return found.agg(
        F.count("*").alias("requests"), F.count(F.expr(ok)).alias("routed"), F.avg(F.expr(ok)).alias("mean_expansions"), at(0.5, "p50_expansions"), at(0.05, "p95_expansions"),
    )
