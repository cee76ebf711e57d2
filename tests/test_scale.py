"""What steps read, make and send, which is what grows with their tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spokewise.operators import blocks
from spokewise.operators import components as C
from spokewise.storage import name_of


def line(spark, n):
    """A line of ``n`` nodes, ridden both ways, each edge of one metre."""
    e = spark.range(n - 1).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("d"), "id")
    a, b = F.col("id") + F.col("d"), F.col("id") + 1 - F.col("d")
    return e.select((2 * F.col("id") + F.col("d")).alias("edge_id"), a.alias("from_node"), b.alias("to_node"), F.lit(1.0).alias("length_m"), F.lit(1.0).alias("cost"), F.lit(True).alias("allowed"), F.lit(False).alias("over"))


def test_moves_are_made_for_edges_taken_only():
    names = ("in_edge", "edge_id", "to_node", "cost", "turn_cost", "spent", "length_m", "block", "lat", "lon")
    rows = [dict(zip(names, (i % 500, i, i + 1, 1.0, 0.0, 0.0, 2.0, 0, None, 3.5 if i % 2 else None))) for i in range(1000)]
    moves = blocks.Moves(pa.array(rows))
    assert moves.get(7) == [tuple(rows[i][c] for c in names[1:]) for i in (7, 507)] and moves.get(1000, ()) == ()
    assert set(moves.made) == {7, 1000}


def test_costs_are_made_once_and_buckets_stay_small(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    costs = line(spark, 60)
    b = blocks.blocks_of(costs.mapInArrow(count, costs.schema), size=3)
    assert seen.value == 118
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name_of(b.table)}").collect()}
    assert b.table.count() == 20 and int(said["Num Buckets"]) >= 20 // blocks.IN_BUCKET


def test_components_meet_nodes_by_shuffle(spark):
    out = C.connected_components(line(spark, 9), "from_node", "to_node")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().toString()
    assert {tuple(r) for r in out.collect()} == {(i, 0) for i in range(9)}


def test_nodes_of_several_fields_are_ranked_as_numbers():
    nodes = pa.array([{"a": 2, "b": "x"}, {"a": 1, "b": "y"}, {"a": 1, "b": "x"}, {"a": 2, "b": "x"}, {"a": 1, "b": "y"}])
    rank, where = C.ranked(nodes)
    assert rank.dtype == np.int64 and rank.tolist() == [2, 1, 0, 2, 1] and where.tolist() == [2, 1, 0]


def test_ways_are_read_once(spark):
    from spokewise.operators import ways

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    w = spark.createDataFrame([(i, {"highway": "residential"}, [i, i + 1, i + 2]) for i in range(0, 40, 2)], "way_id long, tags map<string,string>, nodes array<long>")
    at = spark.range(42).select(F.col("id").alias("osm_node_id"), (30 + F.col("id") / 1000).alias("lat"), F.lit(-97.0).alias("lon"), F.create_map(F.lit("a"), F.lit("b")).alias("tags"))
    nodes, edges, left_out = ways.build_graph(w.mapInArrow(count, w.schema), at, dense=False)
    assert (nodes.count(), edges.count(), tuple(left_out.first())) == (21, 40, (0, 0))
    assert seen.value == 20
    short = spark.createDataFrame([(1, [5]), (2, [5, 6])], "way_id long, nodes array<long>")
    pieces = ways.split_ways(short, ways.node_uses(short).select("osm_node_id", "is_split"))
    assert [tuple(r) for r in pieces.select("way_id", "segment").collect()] == [(2, 0)]
