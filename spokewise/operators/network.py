"""The road graph as tables: nodes (``node_id, lat, lon, control, elevation_m``) and directed edges
(``edge_id, from_node, to_node, length_m, ...``), and what is derived from both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import turn_kind
from ..functions.roads import traffic_stress
from ..storage import apart
from .components import connected_components


def score_edges(edges: DataFrame) -> DataFrame:
    """The edges with their level of traffic stress."""
    c = F.col
    return edges.withColumn("lts", traffic_stress(c("infra_class"), c("highway"), c("surface"), c("maxspeed_mph"), c("lanes")))


def node_max_lts(edges: DataFrame) -> DataFrame:
    """``node, max_lts``: the highest level of any edge that starts or ends at a node; 0 if none is scored."""
    both = edges.select(F.explode(F.array("from_node", "to_node")).alias("node"), F.coalesce("lts", F.lit(0)).alias("lts"))
    return both.groupBy("node").agg(F.max("lts").alias("max_lts"))


def node_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("from_node").alias("node")).agg(F.count("*").alias("out_degree"))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ends = edges.select("edge_id", F.explode(F.array("from_node", "to_node")).alias("node_id"))
    return ends.join(nodes.select("node_id"), "node_id", "left_anti").select("edge_id", "node_id").distinct()


def graph_problems(edges: DataFrame, nodes: DataFrame) -> list[str]:
    """What keeps the graph from being used; empty if nothing does."""
    n, low, high, distinct = nodes.agg(F.count("*"), F.min("node_id"), F.max("node_id"), F.count_distinct("node_id")).first()
    m = edges.count()
    out = []
    if not n:
        out.append("there are no nodes")
    elif (low, high, distinct) != (0, n - 1, n):
        out.append("node ids are not dense from 0")
    if not m:
        out.append("there are no edges")
    if not dangling_edges(edges, nodes).isEmpty():
        out.append("edges end at unknown nodes")
    return out


def reverse_pairs(edges: DataFrame) -> DataFrame:
    """``edge_id, reverse_id`` of edges between the same nodes the other way."""
    a, b = edges.select("edge_id", "from_node", "to_node"), edges.select(F.col("edge_id").alias("reverse_id"), F.col("from_node").alias("to_node"), F.col("to_node").alias("from_node"))
    return a.join(b, ["from_node", "to_node"]).select("edge_id", "reverse_id")


def turns(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every movement from an edge to one that starts where it ends: ``in_edge, out_edge, node, kind,
    node_max_lts, control, infra_in, infra_out``."""
    into = edges.select(F.col("edge_id").alias("in_edge"), F.col("from_node").alias("a"), F.col("to_node").alias("node"), F.col("bearing_end"), F.col("infra_class").alias("infra_in"))
    out = edges.select(F.col("edge_id").alias("out_edge"), F.col("from_node").alias("node"), F.col("to_node").alias("b"), F.col("bearing_start"), F.col("infra_class").alias("infra_out"))
    at = node_max_lts(edges).join(apart(nodes.select(F.col("node_id").alias("node"), "control")), "node", "left")
    moves = into.join(apart(out), "node").join(apart(at), "node")
    kind = turn_kind(F.col("a") == F.col("b"), F.col("bearing_end"), F.col("bearing_start"))
    return moves.select("in_edge", "out_edge", "node", kind.alias("kind"), F.col("max_lts").alias("node_max_lts"), "control", "infra_in", "infra_out")


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, kilometres, mean length, edges a node."""
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), (F.coalesce(F.sum("length_m"), F.lit(0.0)) / 1000).alias("km"), F.coalesce(F.avg("length_m"), F.lit(0.0)).alias("mean_length_m"))
    return e.crossJoin(n).withColumn("edges_per_node", F.col("edges") / F.when(F.col("nodes") > 0, F.col("nodes")))


def lts_distribution(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges, kilometres and share of the length at each level (0: unscored)."""
    keys = [F.coalesce("lts", F.lit(0)).cast("int").alias("lts"), *map(F.col, by or [])]
    groups = edges.groupBy(*keys).agg(F.count("*").alias("edges"), (F.sum("length_m") / 1000).alias("km"))
    total = edges.agg((F.sum("length_m") / 1000).alias("total"))
    return groups.crossJoin(total).select("lts", *(by or []), "edges", "km", (100 * F.col("km") / F.col("total")).alias("pct"))


def components(edges: DataFrame, nodes: DataFrame, max_lts: int | None = None) -> DataFrame:
    """``node, component`` of all nodes, over edges that are unscored or at ``max_lts`` at most."""
    kept = edges if max_lts is None else edges.where(F.coalesce("lts", F.lit(0)) <= max_lts)
    found = connected_components(kept, "from_node", "to_node")
    return nodes.select(F.col("node_id").alias("node")).join(apart(found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("component").agg(F.count("*").alias("nodes"))


def component_summary(found: DataFrame) -> DataFrame:
    """One row: components, the largest and its share, components of one node, and a verdict."""
    return _summary(component_sizes(found).groupBy())


def _summary(sizes) -> DataFrame:
    share = 100.0 * F.max("nodes") / F.sum("nodes")
    out = sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("nodes"), F.lit(0)).alias("largest"), F.coalesce(share, F.lit(0.0)).alias("largest_pct"), F.count_if(F.col("nodes") == 1).alias("singletons"))
    return out.withColumn("verdict", F.when(F.col("largest_pct") < 80, "warning").when(F.col("largest_pct") < 95, "note").otherwise("ok"))


def largest_components(found: DataFrame, n: int = 10) -> DataFrame:
    return component_sizes(found).orderBy(F.desc("nodes"), "component").limit(n)


def main_component(found: DataFrame) -> DataFrame:
    """``node`` of the largest component."""
    largest = largest_components(found, 1).select("component")
    return found.join(F.broadcast(largest), "component").select("node")


def connectivity_by_lts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The component summary when riders keep to each level; all levels go through the same rounds."""
    level = F.explode(F.sequence(F.greatest(F.coalesce("lts", F.lit(0)).cast("int"), F.lit(1)), F.lit(4)))
    at = lambda node: F.struct("max_lts", F.col(node).alias("node"))
    pairs = edges.withColumn("max_lts", level).select(at("from_node").alias("a"), at("to_node").alias("b"))
    found = connected_components(pairs)
    every = nodes.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("max_lts"), "node_id").select(at("node_id").alias("node"))
    labels = every.join(apart(found), "node", "left").select("node.max_lts", F.coalesce("component", "node")["node"].alias("component"))
    sizes = labels.groupBy("max_lts", "component").agg(F.count("*").alias("nodes"))
    return _summary(sizes.groupBy("max_lts"))
