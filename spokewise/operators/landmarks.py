"""Bounds on what is left of a trip, from the costs between some landmarks and all edges.

A way from a landmark to a goal is no dearer than the one by an edge: what is left from the edge costs at least the
landmark's cost to the goal less that to the edge. So with ways that lead to a landmark. Turns count, as costs
are those of edges and not of nodes. The table is made once for a rider, by the search that it guides later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NODES
from .paths import relax

#: Landmarks; an edge has two numbers for each.
LANDMARKS = 8


def rim(costs: DataFrame, nodes: DataFrame, n: int = LANDMARKS) -> DataFrame:
    """``query_id, node``: the node furthest from the middle in each of ``n`` sectors around it, of those that allowed
    edges lead to and from; sectors without any have none, and ties go to the smaller id."""
    ends = lambda c: costs.where("allowed").select(F.col(c).cast("long").alias("node")).distinct()
    places = nodes.select(F.col("node_id").cast("long").alias("node"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")
    places = places.join(ends("from_node"), "node").join(ends("to_node"), "node")
    middle = places.agg(F.coalesce(F.avg("lat"), F.lit(0.0)), F.coalesce(F.avg("lon"), F.lit(0.0))).first()
    x, y = (F.col("lon") - middle[1]) * F.cos(F.radians(F.lit(middle[0]))), F.col("lat") - middle[0]
    sector = F.least(F.floor((F.atan2(y, x) / (2 * F.pi()) + 0.5) * n), F.lit(n - 1)).cast("long")
    placed = places.select("node", sector.alias("sector"), (x * x + y * y).alias("far"))
    chosen = placed.groupBy("sector").agg(F.max_by("node", F.struct("far", -F.col("node"))).alias("node"))
    return chosen.select(F.col("sector").alias("query_id"), "node")


def landmark_table(costs: DataFrame, turns: DataFrame | None, nodes: DataFrame, n: int = LANDMARKS, main: DataFrame | None = None, block_nodes: int = NODES) -> DataFrame:
    """``edge_id, marks``: for each edge and landmark the least cost from the landmark to the edge's end, and the least
    cost on from there to the landmark with its sign turned; infinite where no way leads.

    What is left from an edge ``e`` to a goal is at least ``min(marks of the goal's edges) - marks(e)``, entry by
    entry. The bounds hold for the ``costs`` given and for dearer ones, as of night, hazards, budgets and penalties.
    Landmarks are taken of ``main`` (``node_id``), if given: of a part of the graph that is cut off they tell little.
    Edges that no landmark is joined to have no row; so it is with all where there are no landmarks.
    """
    chosen = rim(costs, nodes if main is None else nodes.join(main.select("node_id"), "node_id", "left_semi"), n)
    there = relax(chosen, costs, turns, block_nodes=block_nodes)
    # the same on the graph turned round: what an edge costs itself has been paid at its end
    turned = costs.withColumns({"from_node": F.col("to_node"), "to_node": F.col("from_node")})
    back = turns if turns is None else turns.select(F.col("out_edge").alias("in_edge"), F.col("in_edge").alias("out_edge"), "turn_cost")
    own = costs.select("edge_id", F.col("cost").alias("_own"))
    home = relax(chosen, turned, back, block_nodes=block_nodes).join(own, "edge_id").select("query_id", "edge_id", (F.col("_own") - F.col("cost")).alias("cost"))
    inf = float("inf")
    of = lambda df, at, none: df.select("edge_id", (F.col("query_id") + at).alias("i"), "cost", F.lit(none).alias("none"))
    both = of(there, 0, inf).unionByName(of(home, n, -inf))
    entry = lambda i: F.coalesce(F.min(F.when(F.col("i") == i, F.col("cost"))), F.lit(inf if i < n else -inf))
    return both.groupBy("edge_id").agg(F.array(*(entry(i) for i in range(2 * n))).alias("marks"))
