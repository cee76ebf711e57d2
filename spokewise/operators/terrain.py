"""Elevation of nodes from raster tiles, and the gradient of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.geo import tile_position
from ..storage import apart


def extent(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))


def cover(boxes: DataFrame, zoom: int = P.TILE_ZOOM) -> DataFrame:
    """``x, y`` of all tiles that boxes touch."""
    x1, y1 = tile_position(F.col("max_lat"), F.col("min_lon"), zoom)
    x2, y2 = tile_position(F.col("min_lat"), F.col("max_lon"), zoom)
    whole = lambda c: F.floor(c).cast("int")
    return boxes.select(F.explode(F.sequence(whole(x1), whole(x2))).alias("x"), whole(y1).alias("y1"), whole(y2).alias("y2")).select("x", F.explode(F.sequence("y1", "y2")).alias("y")).distinct()


def sample_heights(nodes: DataFrame, tiles: DataFrame, zoom: int = P.TILE_ZOOM) -> DataFrame:
    """``node_id, elevation_m``, between the four samples around each node.

    ``tiles``: ``x, y, heights`` (256 x 256, row by row; null or a wrong size counts as absent). A node whose
    first sample alone is there gets that one; without it the height is null. Nodes meet tiles by key; a
    tile's heights stay on its own row.
    """
    size = P.TILE_SIZE
    fx, fy = tile_position(F.col("lat"), F.col("lon"), zoom)
    at = nodes.select("node_id", (fx * size - 0.5).alias("px"), (fy * size - 0.5).alias("py"))
    at = at.withColumns({"x0": F.floor("px"), "y0": F.floor("py")})
    corners = F.array(*(F.struct(F.lit(n).alias("n"), (F.col("x0") + dx).alias("gx"), (F.col("y0") + dy).alias("gy")) for n, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))))
    wanted = at.select("node_id", (F.col("px") - F.col("x0")).alias("dx"), (F.col("py") - F.col("y0")).alias("dy"), F.explode(corners).alias("c")).where("c.gx >= 0 AND c.gy >= 0")
    wanted = wanted.select("node_id", "dx", "dy", "c.n", F.expr("cast(c.gx div 256 as int)").alias("x"), F.expr("cast(c.gy div 256 as int)").alias("y"), F.expr("cast((c.gy % 256) * 256 + c.gx % 256 as int)").alias("i"))
    good = tiles.where(F.size("heights") == size * size)
    values = wanted.join(good, ["x", "y"]).select("node_id", "dx", "dy", "n", F.element_at("heights", F.col("i") + 1).cast("double").alias("v"))
    v = [F.max(F.when(F.col("n") == n, F.col("v"))) for n in range(4)]
    got = values.groupBy("node_id", "dx", "dy").agg(*(x.alias(f"v{n}") for n, x in enumerate(v)))
    mix = lambda a, b, t: a * (1 - F.col(t)) + b * F.col(t)
    full = mix(mix(F.col("v0"), F.col("v1"), "dx"), mix(F.col("v2"), F.col("v3"), "dx"), "dy")
    return nodes.select("node_id").join(got.select("node_id", F.coalesce(full, "v0").alias("elevation_m")), "node_id", "left")


def edge_grades(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with ``grade_pct``, signed in the direction of travel.

    Edges under 20 m and edges with an unknown height count as level; grades stay within 25 %.
    """
    a = nodes.select(F.col("node_id").alias("from_node"), F.col("elevation_m").cast("double").alias("_a"))
    b = nodes.select(F.col("node_id").alias("to_node"), F.col("elevation_m").cast("double").alias("_b"))
    grade = F.greatest(F.lit(-P.GRADE_CLAMP_PCT), F.least(F.lit(P.GRADE_CLAMP_PCT), (F.col("_b") - F.col("_a")) / F.col("length_m") * 100))
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = F.when(known, F.when(F.col("length_m") < P.GRADE_MIN_LENGTH_M, F.lit(0.0)).otherwise(grade)).otherwise(F.lit(0.0))
    return edges.drop("grade_pct").join(apart(a), "from_node", "left").join(apart(b), "to_node", "left").withColumn("grade_pct", out).drop("_a", "_b")


def grade_stats(edges: DataFrame) -> DataFrame:
    """One row: mean of absolute grades, extremes, and edges over 8 %."""
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return edges.agg(F.round(none(F.avg(F.abs("grade_pct"))), 2).alias("mean_abs_pct"), none(F.max("grade_pct")).alias("steepest_up"), none(F.min("grade_pct")).alias("steepest_down"), F.count_if(F.col("grade_pct") > 8).alias("over_8"))
