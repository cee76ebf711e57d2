"""From map ways and nodes to the directed road graph.

``ways``: ``way_id, tags map<string,string>, nodes array<bigint>``; ``map_nodes``: ``osm_node_id, lat, lon,
tags``. All steps are joins and windows; a way's nodes are exploded, never gathered over ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.geo import end_bearings, shape_length_m
from ..storage import stash


def usable_ways(ways: DataFrame) -> DataFrame:
    """Ways that cyclists may ride, of two nodes at least."""
    return ways.where(T.routable(F.col("tags")) & (F.size("nodes") >= 2))


def node_uses(ways: DataFrame) -> DataFrame:
    """``osm_node_id, uses, is_split``: how often ways refer to a node; ends count twice, so that ways are cut there.

    References are counted, not ways: a node that a way passes twice is a split point.
    """
    seen = ways.select(F.size("nodes").alias("n"), F.posexplode("nodes").alias("i", "osm_node_id"))
    end = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    uses = F.least(F.lit(2), F.sum(F.when(end, 2).otherwise(1)))
    return seen.groupBy("osm_node_id").agg(uses.cast("int").alias("uses")).withColumn("is_split", F.col("uses") >= 2)


def referenced_nodes(map_nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """The map nodes that ways refer to, with their traffic control (read at split points only)."""
    joined = map_nodes.join(uses, "osm_node_id")
    control = F.when(F.col("is_split"), T.node_control(F.col("tags"))).otherwise(F.lit("none"))
    return joined.select("osm_node_id", "lat", "lon", "is_split", control.alias("control"))


def split_ways(ways: DataFrame, places: DataFrame) -> DataFrame:
    """``way_id, segment, points``: ways cut at split points; a cut node ends one piece and begins the next.

    ``places``: ``osm_node_id, is_split``, and further columns that go with the points. Each way's nodes meet
    their places in one join and come together in one grouping by way.
    """
    more = [c for c in places.columns if c not in ("osm_node_id", "is_split")]
    steps = ways.select("way_id", F.posexplode("nodes").alias("i", "osm_node_id")).join(places, "osm_node_id", "left")
    point = F.struct("i", "osm_node_id", F.coalesce("is_split", F.lit(False)).alias("is_split"), *more)
    lines = steps.groupBy("way_id").agg(F.array_sort(F.collect_list(point)).alias("line"))
    n = F.size("line")
    cuts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (i == n - 1) | F.get(F.col("line"), i)["is_split"])
    lines = lines.withColumn("cuts", cuts)
    pairs = F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), F.slice("cuts", 2, F.size("cuts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # not outer, Spark would filter by the array before, and so make it twice
    pieces = lines.select("way_id", "line", F.posexplode_outer(pairs).alias("segment", "cut")).where("segment IS NOT NULL")
    kept = F.slice("line", F.col("cut.a") + 1, F.col("cut.b") - F.col("cut.a") + 1)
    return pieces.select("way_id", F.col("segment").cast("int").alias("segment"), kept.alias("points"))


def shaped(pieces: DataFrame) -> DataFrame:
    """Pieces (their points with ``lat, lon``) as ``way_id, segment, nodes, shape, length_m, problem``: ``missing``
    nodes, or ``degenerate`` (a loop, or no length)."""
    shape = F.transform("points", lambda p: F.struct(p["lat"].cast("double").alias("lat"), p["lon"].cast("double").alias("lon")))
    out = pieces.select("way_id", "segment", F.transform("points", lambda p: p["osm_node_id"]).alias("nodes"), shape.alias("shape"))
    known = F.forall("shape", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    out = out.withColumn("length_m", F.when(known, shape_length_m(F.col("shape"))))
    loop = F.col("nodes")[0] == F.element_at("nodes", -1)
    problem = F.when(loop, F.lit("degenerate")).when(F.col("length_m").isNull(), F.lit("missing")).when(F.col("length_m") <= 0, F.lit("degenerate"))
    return out.withColumn("problem", problem)


def build_edges(pieces: DataFrame, ways: DataFrame) -> DataFrame:
    """Directed edges between map nodes, one for each direction that may be ridden."""
    good = pieces.where("problem IS NULL").join(ways.select("way_id", *T.way_attributes(F.col("tags"))), "way_id")
    first, last = F.col("nodes")[0], F.element_at("nodes", -1)
    forward = F.when(F.col("forward"), F.struct(F.lit(0).alias("back"), first.alias("from_osm"), last.alias("to_osm"), F.col("shape").alias("shape")))
    back = F.when(F.col("backward"), F.struct(F.lit(1).alias("back"), last.alias("from_osm"), first.alias("to_osm"), F.reverse("shape").alias("shape")))
    out = good.withColumn("way", F.explode_outer(F.array(forward, back))).where("way IS NOT NULL")
    start, end = end_bearings(F.col("way.shape"))
    kept = ["highway", "name", "infra_class", "surface", "maxspeed_mph", "lanes", "lit"]
    return out.select(F.col("way_id").alias("osm_way_id"), "segment", "way.back", "way.from_osm", "way.to_osm", "way.shape", "length_m", *kept, start.alias("bearing_start"), end.alias("bearing_end"))


def build_graph(ways: DataFrame, map_nodes: DataFrame, dense: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, and one row of counts of what was left out.

    With ``dense``, ids count from 0: nodes in the order in which pieces first end at them, edges by way; this sorts
    all nodes and edges once. Without
    it, map node ids are the node ids and edges have a hash of way, piece and direction.
    """
    usable = stash(usable_ways(ways), "usable")
    uses = node_uses(usable)
    seen = referenced_nodes(map_nodes, uses)
    # written once: a filter on what is made of lists would make them again, and nodes, edges and counts each read all
    pieces = stash(shaped(split_ways(usable, uses.select("osm_node_id", "is_split").join(map_nodes.select("osm_node_id", "lat", "lon"), "osm_node_id", "left"))), "pieces")
    left_out = pieces.agg(F.count_if(F.col("problem") == "missing").alias("skipped_missing"), F.count_if(F.col("problem") == "degenerate").alias("skipped_degenerate"))
    edges = build_edges(pieces, usable)
    along = F.when(F.col("back") == 0, F.array("from_osm", "to_osm")).otherwise(F.array("to_osm", "from_osm"))
    ends = edges.select("osm_way_id", "segment", F.posexplode(along).alias("end", "osm_node_id"))
    ends = ends.groupBy("osm_node_id").agg(F.min(F.struct("osm_way_id", "segment", "end")).alias("_first"))
    nodes = seen.join(ends, "osm_node_id").select("osm_node_id", "lat", "lon", "control", "_first")
    if dense:
        nodes = numbered(nodes, "node_id", ["_first"]).drop("_first")
        edges = numbered(edges, "edge_id", ["osm_way_id", "segment", "back"])
        a = nodes.select(F.col("node_id").alias("from_node"), F.col("osm_node_id").alias("from_osm"))
        b = nodes.select(F.col("node_id").alias("to_node"), F.col("osm_node_id").alias("to_osm"))
        edges = edges.join(a, "from_osm").join(b, "to_osm").drop("from_osm", "to_osm")
    else:
        nodes = nodes.drop("_first").withColumn("node_id", F.col("osm_node_id"))
        edges = edges.withColumn("edge_id", F.xxhash64("osm_way_id", "segment", "back")).withColumnsRenamed({"from_osm": "from_node", "to_osm": "to_node"})
    return nodes, edges, left_out


def numbered(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Numbers from 0 in the order of ``by``: sorted by ranges, each range's rows counted, then numbered within."""
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    parts = stash(parts, "numbered")
    before = parts.groupBy("_part").agg(F.count("*").alias("n"))
    before = before.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return parts.withColumn(name, within.cast("long")).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
