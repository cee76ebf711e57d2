"""Operators on small inputs made by hand, and against plain Python versions."""

import collections
import heapq
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spokewise.operators import components as C
from spokewise.operators import blocks, near, network, paths, pressure, routes, spatial, terrain, updates, ways
from spokewise.functions.geo import points_wkt
from spokewise.plans.api import bench_routing, cost_table, failure, plan_route, random_pairs, turn_table, worst_status
from spokewise.plans.fixture import Network
from spokewise.profiles import PROFILES

SF = "/root/testdata/sf0.001"
COST = "edge_id long, from_node long, to_node long, length_m double, cost double, allowed boolean, over boolean"


def cost_rows(spark, edges):
    """Edges ``(from, to, length[, cost[, over]])``."""
    rows = [(i, e[0], e[1], float(e[2]), float(e[3] if len(e) > 3 else e[2]), True, bool(e[4]) if len(e) > 4 else False) for i, e in enumerate(edges)]
    return spark.createDataFrame(rows, COST)


def asked(spark, *pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "query_id long, from_node long, to_node long")


def found(spark, edges, *pairs, turns=None, **more):
    t = spark.createDataFrame(turns, "in_edge long, out_edge long, turn_cost double") if turns else None
    got = paths.route_requests(asked(spark, *pairs), cost_rows(spark, edges), t, **more).collect()
    return {(r.query_id, r.choice): r for r in got}


def test_search(spark):
    edges = [(0, 1, 10), (1, 3, 10), (0, 2, 5), (2, 3, 5), (4, 5, 1)]
    got = found(spark, edges, (0, 3), (3, 0), (0, 0), (0, 4), (0, 99))
    assert got[0, 0].edges == [2, 3] and got[0, 0].cost == 10
    assert [got[i, 0].status for i in range(5)] == ["ok", "unroutable", "ok", "unroutable", "unknown_node"] and got[2, 0].edges == []
    got = found(spark, edges, (0, 3), turns=[(2, 3, 100.0), (0, 1, 3.0)])
    assert got[0, 0].edges == [0, 1] and got[0, 0].cost == 23 and got[0, 0].length_m == 20


def test_budget(spark):
    chain = [(i, i + 1, 100, 100, True) for i in range(5)] + [(0, 5, 5000)]
    for budget, length in ((100, 5000), (400, 5000), (500, 500), (1000, 500)):
        for exact in (False, True):
            r = found(spark, chain, (0, 5), budget_m=float(budget), exact=exact)[0, 0]
            assert r.length_m == length and r.budget_used_m <= budget
    # a cheap label that spends much must not hide one that spends less
    trap = [(0, 1, 100, 100, True), (0, 1, 110, 500), (1, 2, 100, 100, True)]
    assert found(spark, trap, (0, 2), budget_m=150.0, exact=True)[0, 0].edges == [1, 2]


def test_alternatives(spark):
    lanes = [(0, 1, 100), (1, 9, 100), (0, 2, 115), (2, 9, 115), (0, 3, 130), (3, 9, 130), (0, 4, 5000), (4, 9, 5000)]
    got = found(spark, lanes, (0, 9), n_alternatives=3)
    assert sorted(got) == [(0, 0), (0, 1), (0, 2)] and [got[0, k].cost for k in range(3)] == [200, 230, 260]
    assert sorted(found(spark, [(0, 1, 100), (1, 9, 100)], (0, 9), n_alternatives=2)) == [(0, 0)]


def test_search_limit(spark):
    chain = [(i, i + 1, 10) for i in range(9)]
    got = found(spark, chain, (0, 9), (0, 3), most_labels=5)
    assert got[0, 0].status == "search_limit" and got[0, 0].edges is None and got[1, 0].status == "ok"


def plain_costs(edges, turn, start):
    """Least cost to each edge, by a plain heap."""
    best, heap = {}, [(e[3], i) for i, e in enumerate(edges) if e[0] == start]
    heapq.heapify(heap)
    while heap:
        c, i = heapq.heappop(heap)
        if i in best:
            continue
        best[i] = c
        for j, f in enumerate(edges):
            if f[0] == edges[i][1] and j not in best:
                heapq.heappush(heap, (c + f[3] + turn[i, j], j))
    return best


def test_against_plain_search(spark):
    r = random.Random(6)
    edges = []
    for a, b in itertools.permutations(range(12), 2):
        if r.random() < 0.25:
            edges.append((a, b, r.randrange(5, 50), r.randrange(50, 99), r.random() < 0.4))
    turn = {(i, j): float(r.randrange(9)) for i, e in enumerate(edges) for j, f in enumerate(edges) if e[1] == f[0]}
    turns = [(i, j, t) for (i, j), t in turn.items()]
    want = plain_costs(edges, turn, 0)
    costs = cost_rows(spark, edges)
    table = spark.createDataFrame(turns, "in_edge long, out_edge long, turn_cost double")
    source = spark.createDataFrame([(0, 0)], "query_id long, node long")
    loop = {x.edge_id: x for x in paths.relax(source, costs, table, keep_paths=True).collect()}
    assert {e: x.cost for e, x in loop.items()} == want
    for e, x in loop.items():
        assert x.edges[-1] == e and sum(edges[k][3] for k in x.edges) + sum(turn[p] for p in zip(x.edges, x.edges[1:])) == x.cost
    goals = [g for g in range(1, 12)]
    got = found(spark, edges, *((0, g) for g in goals), turns=turns)
    for q, g in enumerate(goals):
        least = min((c for e, c in want.items() if edges[e][1] == g), default=None)
        assert got[q, 0].cost == least
    # with a budget: all cheapest ways of every amount spent
    limit = 60
    least = plain_budget(edges, turn, 0, limit)
    by_loop = paths.relax(source, costs, table, budget_m=float(limit)).groupBy("to_node").agg(F.min("cost").alias("c")).collect()
    assert {x.to_node: x.c for x in by_loop} == least
    got = found(spark, edges, *((0, g) for g in goals), turns=turns, budget_m=float(limit), exact=True)
    assert {g: got[q, 0].cost for q, g in enumerate(goals) if got[q, 0].cost is not None} == {g: c for g, c in least.items() if g}
    # buckets lose no feasible way but dearer ones at most
    near = found(spark, edges, *((0, g) for g in goals), turns=turns, budget_m=float(limit))
    for q, g in enumerate(goals):
        r = near[q, 0]
        assert r.cost is None or (r.cost >= least[g] and r.budget_used_m <= limit)
        assert r.status == "unroutable" or sum(edges[k][3] for k in r.edges) + sum(turn[p] for p in zip(r.edges, r.edges[1:])) == r.cost


def plain_buckets(edges, turn, start, goal, limit, buckets):
    """Least cost to a goal by a plain heap in order of cost that keeps the first label of each edge and bucket."""
    spent = [e[2] if e[4] else 0 for e in edges]
    bucket = lambda u: min(buckets - 1, int(u / (limit / buckets)))
    done, heap = set(), [(e[3], spent[i], i) for i, e in enumerate(edges) if e[0] == start and spent[i] <= limit]
    heapq.heapify(heap)
    while heap:
        c, u, i = heapq.heappop(heap)
        if (i, bucket(u)) in done:
            continue
        done.add((i, bucket(u)))
        if edges[i][1] == goal:
            return c
        for j, f in enumerate(edges):
            if f[0] == edges[i][1] and u + spent[j] <= limit:
                heapq.heappush(heap, (c + f[3] + turn[i, j], u + spent[j], j))
    return None


@pytest.mark.parametrize("block_nodes", [3, 100])
def test_blocks_and_buckets(spark, block_nodes):
    """However small the blocks are, buckets keep what a search in order of cost keeps, and paths are whole."""
    r = random.Random(11)
    place = {k: (50 + r.random() / 100, 8 + r.random() / 100) for k in range(24)}
    edges, at = [], {}
    for a, b in itertools.permutations(range(24), 2):
        if r.random() < 0.12:
            m = 1 + int(geo_metres(*place[a], *place[b]))
            at[len(edges)] = (a, b)
            edges.append((a, b, m, m + r.randrange(2000) + r.random() / 8, r.random() < 0.5))
    turn = {(i, j): r.random() for i, e in enumerate(edges) for j, f in enumerate(edges) if e[1] == f[0]}
    turns = [(i, j, t) for (i, j), t in turn.items()]
    nodes = spark.createDataFrame([(k, *v) for k, v in place.items()], "node_id long, lat double, lon double")
    pairs = [(a, b) for a in (0, 5) for b in range(24) if a != b]
    for limit in (700, 2500):
        got = found(spark, edges, *pairs, turns=turns, nodes=nodes, budget_m=float(limit), buckets=4, block_nodes=block_nodes)
        for q, (a, b) in enumerate(pairs):
            want, r = plain_buckets(edges, turn, a, b, limit, 4), got[q, 0]
            assert (r.cost is None) == (want is None) and (want is None or r.cost == pytest.approx(want)), (a, b, limit)
            if r.edges:
                assert edges[r.edges[0]][0] == a and edges[r.edges[-1]][1] == b and all(at[x][1] == at[y][0] for x, y in zip(r.edges, r.edges[1:]))
                assert sum(edges[k][3] for k in r.edges) + sum(turn[p] for p in zip(r.edges, r.edges[1:])) == pytest.approx(r.cost)
                assert sum(edges[k][2] for k in r.edges) == pytest.approx(r.length_m)


def geo_metres(*places):
    from spokewise.operators.blocks import metres

    return metres(*places)


def test_graph_is_not_shuffled_by_a_round(spark):
    """A round joins its letters with the bucketed table, which has no exchange of its own."""
    costs = cost_rows(spark, [(k, k + 1, 10) for k in range(40)])
    b = paths.blocks_of(costs, size=4)
    letters = spark.range(1000).select(F.col("id").cast("int").alias("block"), F.lit("x").alias("asks"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = letters.join(b.table, "block")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert b.table.count() == 10  # 41 nodes, the last without a move


def test_dead_ends_ties_and_repeats(spark):
    twins = [(0, 1, 5), (0, 1, 5), (1, 2, 5), (1, 2, 5), (2, 0, 1)]
    for block_nodes in (1, 50):
        got = found(spark, twins, (0, 2), (2, 1), (1, 1), block_nodes=block_nodes)
        assert got[0, 0].cost == 10 and len(got[0, 0].edges) == 2 and got[1, 0].cost == 6 and got[2, 0].edges == []
    assert paths.route_requests(asked(spark, (0, 1)).limit(0), cost_rows(spark, twins)).collect() == []
    assert found(spark, [], (0, 1))[0, 0].status == "unknown_node"


def plain_budget(edges, turn, start, limit):
    """Least cost to each node within a budget of whole metres, by a plain heap over (edge, spent)."""
    spent = [e[2] if e[4] else 0 for e in edges]
    done, heap = {}, [(e[3], i, spent[i]) for i, e in enumerate(edges) if e[0] == start and spent[i] <= limit]
    heapq.heapify(heap)
    while heap:
        c, i, u = heapq.heappop(heap)
        if (i, u) in done:
            continue
        done[i, u] = c
        for j, f in enumerate(edges):
            if f[0] == edges[i][1] and u + spent[j] <= limit:
                heapq.heappush(heap, (c + f[3] + turn[i, j], j, u + spent[j]))
    least = {}
    for (i, _), c in done.items():
        least[edges[i][1]] = min(c, least.get(edges[i][1], math.inf))
    return least


@pytest.mark.parametrize("last", [C.LAST, 0])
def test_components_by_contraction(spark, last):
    r = random.Random(last)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, k) for k in range(2001, 2300)] + [(7, 7), (5000, 5000), (None, 3)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None:
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {(x.node, x.component) for x in C.connected_components(df, last=last).collect()} == set(want.items())
    if last:
        texts = C.connected_components(df.select(F.concat(F.lit("n"), "a").alias("a"), F.concat(F.lit("n"), "b").alias("b")), last=last)
        assert texts.groupBy("component").count().count() == len(set(want.values()))
        pairs = df.select(F.struct(F.lit(1).alias("k"), F.col("a").alias("x")).alias("a"), F.struct(F.lit(1).alias("k"), F.col("b").alias("x")).alias("b")).where("a.x IS NOT NULL")
        assert {(x.node.x, x.component.x) for x in C.connected_components(pairs, last=last).collect()} == set(want.items())


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 300 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_labels_without_paths_name_no_edges():
    moves = {i: [(i + 1, i + 2, 1.0, 0.0, 0.0, 1.0, 0, None, None)] for i in range(50)}
    ask = {"factors": None, "goal": None, "goal_lat": None, "goal_lon": None, "bound": None, "horizon": None, "marks": None, "letters": [{"edge": 0, "to_node": 1, "cost": 1.0, "used": 0.0, "length": 1.0, "src": -1}]}
    whole, bare = (blocks.search(0, moves, ask, blocks.Limits(keep_labels=True, keep_paths=k), {}, np.zeros((0, 0))).labels for k in (True, False))
    assert [(x["edge"], x["cost"]) for x in whole] == [(x["edge"], x["cost"]) for x in bare] == [(i, i + 1.0) for i in range(51)]
    assert sum(len(x["seg"]) for x in whole) == 51 * 50 // 2 and not any(x["seg"] for x in bare)


def test_rounds_move_letters_by_shuffle(spark, monkeypatch):
    """The labels of a round aren't read for its letters, which are met by shuffle, whatever the size of their files;
    requests that crowd a block are dealt out to tasks of their own, with equal results."""
    edges = [(i, i + 1, 10 + i % 3) for i in range(12)] + [(i + 1, i, 11) for i in range(12)]
    asks = [(i, 12 - i) for i in range(13) if i != 6]
    costs = lambda: {k: (x.status, x.cost, x.edges) for k, x in found(spark, edges, *asks, block_nodes=4).items()}
    want, plans, inputs = costs(), [], paths._inputs

    def kept(*args):
        out = inputs(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(paths, "_inputs", kept)
    monkeypatch.setattr(paths, "ASKS", 2)
    assert costs() == want and all(x[0] == "ok" for x in want.values())
    assert len(plans) > 2 and not any(re.search(r"BroadcastHashJoin [^\n]*(Inner|LeftOuter)", x) for x in plans)
    assert not any(re.search(r"ReadSchema: [^\n]*labels:", x) for x in plans)


def test_radius_join_against_all_pairs(spark):
    n = Network(spark, SF)
    points = n.crashes.withColumnRenamed("crash_id", "point_id")
    got = {(x.point_id, x.edge_id): x.distance_m for x in spatial.radius_join(points, n.edges, 25.0).collect()}
    gap = F.expr("1.0")
    both = points.select("point_id", "lat", "lon").crossJoin(n.edges.select("edge_id", "shape"))
    from spokewise.functions.geo import shape_distance_m

    gap = shape_distance_m(F.col("lat"), F.col("lon"), F.col("shape"))
    want = {(x.point_id, x.edge_id): x.gap for x in both.withColumn("gap", gap).where("gap <= 25").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in got)
    far = spark.createDataFrame([(1, 69.9, 20.0), (2, None, 20.0)], "point_id long, lat double, lon double")
    line = spark.createDataFrame([(1, [(69.9, 20.0005), (69.95, 20.0005)]), (2, [])], "edge_id long, shape array<struct<lat:double,lon:double>>")
    assert [(x.point_id, x.edge_id) for x in spatial.radius_join(far, line, 25.0).collect()] == [(1, 1)]


def test_crowded_cells(spark):
    """Nine in ten reports in one block, a third of all at one place: equal pairs, no part over four times the median."""
    r = random.Random(3)
    places = [(30.0005, -97.0)] * 3000 + [(30.0 + r.random() / 1500, -97.0 + r.random() / 1500) for _ in range(5100)] + [(30.01 + r.random() / 20, -97.0 + r.random() / 20) for _ in range(900)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "point_id long, lat double, lon double")
    edges = spark.createDataFrame([(i, [(30.0 + 0.0002 * i, -97.0), (30.0 + 0.0002 * i, -96.999)]) for i in range(40)], "edge_id long, shape array<struct<lat:double,lon:double>>")
    pairs = lambda few: {(x.point_id, x.edge_id, x.distance_m) for x in spatial.radius_join(points, edges, 30.0, few=few).collect()}
    assert len(pairs(10**9)) > 3000 and pairs(10**9) == pairs(50)
    placed = spatial.point_cells(points.select("point_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "_lat", "_lon", 30.0, 120.0)
    p, legs = spatial.dealt(placed, spatial.leg_cells(spatial.edge_legs(edges), 30.0, 120.0), 50, "point_id")
    whole = max(x["count"] for x in placed.groupBy("_row", "_col").count().collect())
    sizes = {(x._row, x._col, x._part): x["count"] for x in p.groupBy("_row", "_col", "_part").count().collect()}
    assert whole > 2000 and sum(sizes.values()) == 9000
    here = points.where("point_id < 3000").join(placed, "point_id").select("_row", "_col").distinct().collect()
    crowd = sorted(n for (row, col, _), n in sizes.items() if n > 20)
    assert len(here) == 1 and len({k for k in sizes if k[:2] == (here[0]._row, here[0]._col)}) > 20 and crowd[-1] <= 4 * crowd[len(crowd) // 2]
    assert legs.groupBy("edge_id", "_row", "_col", "_part").count().where("count > 1").isEmpty()


def test_pressure_edges(spark):
    n = Network(spark, SF)
    as_of = n.as_of("2024-02-15")
    late = n.as_of("2030-01-01")
    assert pressure.hazard_pressure(n.hazards, n.edges, late).count() == 0
    assert all(0 < x.hazard_score < 1 for x in pressure.hazard_pressure(n.hazards, n.edges, as_of).collect())
    rows = [(1, 30.0, -97.0, "debris", None), (2, 91.0, 0.0, "debris", "x"), (3, 0.0, 0.0, "Debris", "é" * 251), (4, None, 0.0, None, "")]
    got = spark.createDataFrame(rows, "i int, lat double, lon double, kind string, notes string").select("i", pressure.hazard_problems().alias("p")).orderBy("i").collect()
    assert [len(x.p) for x in got] == [0, 1, 2, 2]


def test_nearest_join_looks_further(spark):
    line = lambda lon: [(30.0, lon), (30.0001, lon)]
    edges = spark.createDataFrame([(i, line(-97.0 + 0.0005 * i)) for i in range(20)], "edge_id long, shape array<struct<lat:double,lon:double>>")
    points = spark.createDataFrame([(1, 30.0, -97.0), (2, 30.0, -96.9952), (3, 30.0, -96.981), (4, 30.0, -96.0)], "point_id long, lat double, lon double")
    got = {}
    for x in spatial.nearest_join(points, edges, 5, 1000.0).orderBy("point_id", "rank").collect():
        got.setdefault(x.point_id, []).append(x.edge_id)
    assert got == {1: [0, 1, 2, 3, 4], 2: [10, 9, 11, 8, 12], 3: [19, 18]}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distances_are_taken_once(spark):
    """No part of the distance is in the join or in a filter, where it would be evaluated again wherever it stands."""
    n = Network(spark, SF)
    points = n.hazards.withColumnRenamed("hazard_id", "point_id")
    lines = [x for x in optimized(spatial.radius_join(points, n.edges, 30.0)).splitlines() if "ASIN(" in x]
    assert len(lines) == 1 and "Aggregate" in lines[0]


def test_pairs_stay_where_they_met(spark):
    """Neither pairs nor candidates are shuffled by position once their cell has been met."""
    n = Network(spark, SF)
    points = n.hazards.withColumnRenamed("hazard_id", "point_id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spatial.radius_join(points, n.edges, 30.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "hashpartitioning(_row" in plan and "hashpartitioning(point_id" not in plan


def test_snap_takes_the_first_of_main(spark):
    edge = lambda i, lon: (i, i, i + 100, [(30.0, lon), (30.0001, lon)])
    edges = spark.createDataFrame([edge(i, -97.0 + 0.0001 * i) for i in range(20)], "edge_id long, from_node long, to_node long, shape array<struct<lat:double,lon:double>>")
    points = spark.createDataFrame([(1, 30.0, -97.0), (2, 30.0001, -96.9981), (3, 30.0, -96.99), (4, 30.0, -96.0)], "point_id long, lat double, lon double")
    main = spark.createDataFrame([(4,), (4,), (3,), (7,)], "node long")
    got = {x.point_id: (x.edge_id, x.node, x.main) for x in spatial.snap(points, edges, main).collect()}
    assert got == {1: (3, 3, True), 2: (19, 119, False), 3: (19, 19, False)}
    assert {x.point_id: x.edge_id for x in spatial.snap(points, edges).collect()} == {1: 0, 2: 19, 3: 19}


def test_crash_scores(spark):
    edges = spark.createDataFrame([(1, 100.0, "none"), (2, 10.0, "path"), (3, 100.0, "none")], "edge_id long, length_m double, infra_class string")
    weights = spark.createDataFrame([(1, 6.0), (2, 0.6)], "edge_id long, weighted double")
    got = [x.crash_score for x in pressure.apply_crashes(edges, weights).orderBy("edge_id").collect()]
    assert got == pytest.approx([1 - math.exp(-1), 1 - math.exp(-2 / 6), 0.0])


def test_weights_need_no_second_meeting(spark):
    """Matches carry what weighs them: the reports and crashes are not joined to the pairs again, by their ids."""
    n = Network(spark, SF)
    as_of = n.as_of("2002-01-01")
    own = pressure.match_crashes(n.crashes, n.edges)
    by_id = pressure.crash_weights(own.drop("severity", "occurred_at"), n.crashes, n.edges, as_of)
    carried = pressure.crash_weights(own, n.crashes, n.edges, as_of)
    sums = lambda df: {x.edge_id: x.weighted for x in df.collect()}
    assert sums(carried) == pytest.approx(sums(by_id), rel=1e-12)
    joined = lambda df, key: re.search(rf"Join [^\n]*{key}#\d+L? = {key}#", optimized(df))
    assert joined(by_id, "crash_id") and not joined(carried, "crash_id")
    assert not joined(pressure.hazard_pressure(n.hazards, n.edges, n.as_of("2024-02-15")), "hazard_id")


def test_confirmations(spark):
    day = lambda n: F.timestamp_seconds(F.lit(n * 86400))
    reports = spark.createDataFrame([(1, 30.0, -97.0, "debris", ""), (2, 30.0, -97.0, "other", "n")], "hazard_id long, lat double, lon double, kind string, notes string").withColumn("created_at", day(0))
    confirms = spark.createDataFrame([(1, 89), (1, 95), (1, 200), (2, 90)], "hazard_id long, d int").select("hazard_id", F.timestamp_seconds(F.col("d") * 86400).alias("confirmed_at"))
    got = {x.hazard_id: (x.confirmations, x.t, x.notes) for x in pressure.fold_reports(reports, confirms).withColumn("t", F.unix_seconds("expires_at")).collect()}
    assert got == {1: (2, 118 * 86400, None), 2: (0, 90 * 86400, "n")}


def test_terrain(spark):
    nodes = spark.createDataFrame([(i, lat, lon) for i, (lat, lon) in enumerate([(30.25, -97.75), (30.26, -97.74), (10.0, 10.0)])], "node_id long, lat double, lon double")
    tiles = terrain.cover(terrain.extent(nodes.where("node_id < 2")))
    flat = tiles.withColumn("heights", F.transform(F.sequence(F.lit(0), F.lit(65_535)), lambda i: (i % 256 + F.col("x") * 256).cast("float")))
    got = {x.node_id: x.elevation_m for x in terrain.sample_heights(nodes, flat).collect()}
    px = lambda lon: (lon + 180) / 360 * 8192 * 256 - 0.5
    assert got[0] == pytest.approx(px(-97.75), abs=0.3) and got[1] == pytest.approx(px(-97.74), abs=0.3) and got[2] is None
    heights = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, None)], "node_id long, elevation_m double")
    edges = spark.createDataFrame([(0, 0, 1, 100.0), (1, 1, 0, 100.0), (2, 0, 1, 10.0), (3, 0, 2, 100.0), (4, 0, 1, 25.0)], "edge_id long, from_node long, to_node long, length_m double")
    assert [x.grade_pct for x in terrain.edge_grades(edges, heights).orderBy("edge_id").collect()] == [10.0, -10.0, 0.0, 0.0, 25.0]


def lay(spark, way_nodes, tags=None, missing=()):
    tags = tags or [{"highway": "residential"}] * len(way_nodes)
    w = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(zip(way_nodes, tags))], "way_id long, tags map<string,string>, nodes array<long>")
    ids = sorted({x for n in way_nodes for x in n} - set(missing))
    m = spark.createDataFrame([(x, 30.27, -97.74 + x * 0.001, {}) for x in ids], "osm_node_id long, lat double, lon double, tags map<string,string>")
    return ways.build_graph(w, m)


def test_build_graph(spark):
    nodes, edges, out = lay(spark, [[10, 11, 12]])
    rows = edges.orderBy("edge_id").collect()
    assert nodes.count() == 2 and len(rows) == 2 and all(len(x.shape) == 3 for x in rows)
    assert (rows[0].from_node, rows[0].to_node, rows[1].from_node, rows[1].to_node) == (0, 1, 1, 0) and rows[0].length_m == pytest.approx(192, abs=1)
    assert rows[0].bearing_start == pytest.approx(90, abs=0.1) and rows[1].bearing_start == pytest.approx(270, abs=0.1)
    nodes, edges, out = lay(spark, [[10, 11, 12], [11, 20]])
    assert (nodes.count(), edges.count()) == (4, 6)
    assert sorted(x.edge_id for x in edges.collect()) == list(range(6)) and network.graph_problems(edges, nodes) == []
    _, edges, _ = lay(spark, [[10, 11]], [{"highway": "residential", "oneway": "yes"}])
    assert edges.count() == 1
    _, edges, out = lay(spark, [[10, 11, 12]], missing=[12])
    assert edges.count() == 0 and out.first().skipped_missing == 1
    _, edges, out = lay(spark, [[10, 11, 12, 10]])
    assert edges.count() == 0 and out.first().skipped_degenerate == 1
    nodes, edges, out = lay(spark, [[10, 11]], [{"highway": "motorway"}])
    assert edges.count() == 0 and network.graph_problems(edges, nodes) == ["there are no nodes", "there are no edges"]


def test_segments_tile_the_line(spark):
    path = spark.createDataFrame([(1, i, i) for i in range(6)], "query_id long, pos int, edge_id long")
    edges = spark.createDataFrame([(0, 1, "path", 10.0), (1, 2, "none", 10.0), (2, 2, "none", 5.0), (3, 2, "none", 1.0), (4, 3, "none", 7.0), (5, None, "none", 2.25)], "edge_id long, lts short, infra_class string, length_m double")
    shapes = spark.createDataFrame([(0, 0), (1, 3), (2, 0), (3, 3), (4, 2), (5, 4)], "edge_id long, n_points int")
    got = [(x.start, x.end, x.lts, x.length_m) for x in routes.segments(path, edges, shapes).orderBy("run").collect()]
    assert got == [(0, 4, 2, 16.0), (4, 5, 3, 7.0), (5, 8, 0, 2.3)]
    assert routes.missing_shapes(path, shapes.where("edge_id < 5")).count() == 1


def test_updates(spark):
    table = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "k int, v int")
    new = spark.createDataFrame([(1, 1), (2, None), (3, None), (9, 9)], "k int, v int")
    assert [(x.k, x.v) for x in updates.changed_rows(table, new, "k", "v").collect()] == [(3, None)]
    assert sorted((x.k, x.v) for x in updates.updated(table, new, "k", "v").collect()) == [(1, 1), (2, None), (3, None)]
    points = lambda n: [(30.0, -97.0)] * n
    saved = spark.createDataFrame([], "route_id string, user_id string, name string, waypoints array<struct<lat:double,lon:double>>, created_at int")
    fresh = spark.createDataFrame([("a", "u", "home", points(2), 1), ("b", "u", " ", points(2), 2), ("c", "u", "x", points(1), 3), ("d", "v", "y" * 120, points(10), 4), ("e", "u", "z", [(99.0, 0.0)] * 2, 5)], saved.schema)
    kept = updates.save_routes(saved, fresh)
    assert sorted(x.route_id for x in kept.collect()) == ["a", "d"]
    assert [x.route_id for x in updates.list_routes(kept, "u", 0).collect()] == ["a"]
    assert updates.get_route(kept, "u", "d").count() == 0 and updates.delete_route(kept, "v", "d").count() == 1 and updates.delete_route(kept, "u", "d").count() == 2


def test_plan_route(spark):
    n = Network(spark, SF)
    rows = [(1, 0, 30.25, -97.75), (1, 1, 30.2518, -97.7473), (2, 0, 30.25, -97.75), (2, 1, 50.0, 0.0)]
    points = spark.createDataFrame(rows, "query_id long, pos int, lat double, lon double")
    got = {x.query_id: x for x in plan_route(points, n.edges, n.nodes).collect()}
    a = got[1]
    assert a.status == "ok" and got[2].status == "snap_failed" and got[2].edges is None
    assert a.length_m >= a.baseline_m > 0 and a.detour == pytest.approx(a.length_m / a.baseline_m, abs=0.006) and 0 <= a.score <= 100
    assert a.segments[0].start == 0 and all(x.end == y.start for x, y in zip(a.segments, a.segments[1:])) and a.segments[-1].end == len(a.shape) - 1
    assert sum(s.length_m for s in a.segments) == pytest.approx(a.length_m) == pytest.approx(sum(a.by_lts_m.values()))
    assert a.budget_used_m <= PROFILES["comfortable"].stress_budget_m
    assert a.choice == 0 and a.error is None and got[2].error.code == "unroutable" and got[2].error.details is None and 0 <= a.baseline_score <= 100


def test_plan_alternatives_and_failures(spark):
    n = Network(spark, SF)
    rows = [(1, 0, 30.25, -97.75), (1, 1, 30.2518, -97.7473), (2, 0, 30.25, -97.75), (2, 1, 30.25, -97.75), (3, 0, 30.25, -97.75), (3, 1, 30.2509, -97.7491), (3, 2, 30.2518, -97.7473)]
    points = spark.createDataFrame(rows, "query_id long, pos int, lat double, lon double")
    got = {(x.query_id, x.choice): x for x in plan_route(points, n.edges, n.nodes, n_alternatives=2).collect()}
    assert got[2, 0].status == "same_point" and got[2, 0].error.code == "unroutable" and got[3, 0].status == "ok" and (3, 1) not in got
    more = [x for (q, c), x in got.items() if q == 1 and c > 0]
    assert more and all(got[1, 0].cost <= x.cost <= 1.6 * got[1, 0].cost and x.segments[-1].end == len(x.shape) - 1 for x in more)
    p = PROFILES["cautious"]
    told = spark.createDataFrame([("ok",), ("unroutable",)], "status string").select(failure(p, F.col("status")).alias("e")).collect()
    assert told[0].e is None and told[1].e.details["max_lts"] == str(p.max_lts) and str(p.max_lts) in told[1].e.message


def test_worst_status(spark):
    rows = [(1, "ok"), (1, "ok"), (2, "ok"), (2, "search_limit"), (3, "unroutable"), (3, "search_limit"), (4, "unroutable"), (4, "unknown_node"), (4, "ok")]
    got = spark.createDataFrame(rows, "q long, status string").groupBy("q").agg(worst_status(F.col("status")).alias("s")).collect()
    assert {r.q: r.s for r in got} == {1: "ok", 2: "search_limit", 3: "unroutable", 4: "unknown_node"}


def test_bench_routing(spark):
    n = Network(spark, SF)
    pairs = [tuple(x) for x in random_pairs(n.stored, 5).collect()]
    starts = {x.from_node for x in n.stored.select("from_node").distinct().collect()}
    assert len(pairs) == 5 and sorted(pairs) == sorted(tuple(x) for x in random_pairs(n.stored, 5).collect()) and all(a != b and {a, b} <= starts for _, a, b in pairs)
    corner = n.stored.where("from_node < 160 AND to_node < 160 AND from_node % 40 < 5 AND to_node % 40 < 5")
    rows = {x.form: x for x in bench_routing(corner, n.nodes, 2).collect()}
    assert len(rows) == 4 and all(x.requests == 2 for x in rows.values())
    assert rows["guided, no budget"].mean_expansions <= rows["plain, no budget"].mean_expansions


def test_loads(spark):
    nodes = spark.createDataFrame([(1, 5.0), (2, None)], "node_id long, elevation_m double")
    new = spark.createDataFrame([(2, 7.126), (9, 1.0)], "node_id long, elevation_m double")
    assert sorted(map(tuple, updates.update_elevations(nodes, new).collect())) == [(1, 5.0), (2, 7.13)]
    schema = "hazard_id long, lat double, lon double, kind string, notes string, created_at timestamp"
    fresh = spark.createDataFrame([(1, 30.0, -97.0, "debris", "", None), (2, 99.0, -97.0, "debris", "x", None), (3, 30.0, -97.0, "pothole", "deep", None)], schema)
    assert [(x.hazard_id, x.notes) for x in pressure.add_reports(fresh.limit(0), fresh).orderBy("hazard_id").collect()] == [(1, None), (3, "deep")]
    point = spark.sql("SELECT array(named_struct('lat', 1.5D, 'lon', 2.0D), named_struct('lat', -1D, 'lon', 0D)) AS p, filter(array(named_struct('lat', 1D, 'lon', 2D)), x -> false) AS e")
    assert tuple(point.select(points_wkt(F.col("p"), None), points_wkt(F.col("e"))).first()) == ("MULTIPOINT((2.0000000 1.5000000),(0.0000000 -1.0000000))", None)


def test_statistics(spark):
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW counted_source AS SELECT id FROM range(7)")
    spark.sql("DROP TABLE IF EXISTS counted")
    spark.table("counted_source").write.saveAsTable("counted")
    try:
        updates.refresh_statistics(spark, "counted")
        said = {x.col_name: x.data_type for x in spark.sql("DESCRIBE EXTENDED counted").collect()}
        assert "7 rows" in said["Statistics"]
    finally:
        spark.sql("DROP TABLE IF EXISTS counted")


def test_nodes_in_order_of_first_use(spark):
    nodes, edges, _ = lay(spark, [[12, 10], [10, 11]])
    assert [x.osm_node_id for x in nodes.orderBy("node_id").collect()] == [12, 10, 11]


def test_near_trips(spark, monkeypatch):
    """Short trips take no rounds; those that leave their region are handed back, and get the same routes."""
    n, p, rounds, spread = Network(spark, SF), PROFILES["comfortable"], [], paths.spread
    asks = n.requests.orderBy("query_id").limit(3).unionByName(spark.createDataFrame([(901, 0, 0), (902, 0, 10**9)], "query_id long, from_node long, to_node long"))
    costs, turns = cost_table(n.stored, p), turn_table(n.stored, n.nodes, p)
    monkeypatch.setattr(paths, "spread", lambda *a: rounds.append(1) or spread(*a))

    def routed():
        got = paths.route_requests(asks, costs, turns, n.nodes, p.stress_budget_m, n_alternatives=1, block_nodes=60)
        return sorted((x.query_id, x.choice, x.status, x.edges, x.cost and round(x.cost, 6), x.length_m) for x in got.collect())

    at_once = routed()
    assert not rounds and [x[:4] for x in at_once[-2:]] == [(901, 0, "ok", []), (902, 0, "unknown_node", None)] and any(x[1] for x in at_once)
    monkeypatch.setattr(near, "REACH", 0.01)
    assert routed() == at_once and rounds


@pytest.mark.parametrize("exact", [True, False])
def test_a_request_that_no_way_serves_is_told_nearby(exact):
    """A goal that is dear to come to from all sides, in a graph that goes on around the region."""
    size, dear = 20, {(5, 5), (8, 7)}
    places = [(x, y) for x in range(size) for y in range(size)]
    edges = [(a, b, 100.0 + (7 * a[0] + b[1]) % 20) for a in places for b in places if abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1]
    number = {x: k for k, x in enumerate(places)}
    spent = [e[2] if dear & {e[0], e[1]} else 0.0 for e in edges]
    out = {x: [i for i, e in enumerate(edges) if e[0] == x] for x in places}
    move = lambda i, j: {"in_edge": i, "edge_id": j, "to_node": number[edges[j][1]], "cost": edges[j][2], "turn_cost": 0.0, "spent": spent[j], "length_m": edges[j][2], "block": 0, "lat": None, "lon": None}
    moves = blocks.Moves(pa.array([move(i, j) for i, e in enumerate(edges) if max(e[1]) < 12 for j in out[e[1]]]))
    moves.enclose(0)

    def told(start, goal, budget):
        limits = blocks.Limits(budget, 1 if exact else 4, exact, alone=True)
        letters = [{"src": -1, "edge": i, "to_node": number[edges[i][1]], "cost": edges[i][2], "used": spent[i], "length": edges[i][2]} for i in out[start]]
        ask = {"query_id": 1, "from_node": number[start], "goal": number[goal], "goal_lat": None, "goal_lon": None, "letters": letters, "ends": [i for i, e in enumerate(edges) if e[1] == goal]}
        rows = near.routes(moves, ask, limits, 0, 10**6)
        return rows and [(x["status"], x["cost"]) for x in rows]

    assert told((3, 3), (5, 5), 90.0) == [("unroutable", None)] == told((5, 5), (8, 7), 150.0)
    least = plain_budget([(number[a], number[b], m, m, spent[i] > 0) for i, (a, b, m) in enumerate(edges)], collections.defaultdict(float), number[4, 4], 150)
    assert told((4, 4), (5, 5), 150.0) == [("ok", least[number[5, 5]])]
    # ways outside may serve these, as far as is known here
    assert told((3, 3), (15, 15), 90.0) is None and told((3, 3), (11, 11), 150.0) != [("unroutable", None)]
    assert moves.spent_back([i for i, e in enumerate(edges) if e[1] == (5, 5)]) == min(m for a, b, m in edges if b == (5, 5))
    assert moves.spent_back([i for i, e in enumerate(edges) if e[1] == (15, 15)]) == 0.0


@pytest.mark.parametrize("lat", [30.0, 88.0, 91.5, 150.0, -60.0])
def test_nearest_anywhere(spark, lat):
    """The nearest edges of some positions against all pairs, also beyond a pole, where a fixture of many rows goes."""
    r = random.Random(3)
    step = 0.0009 / max(0.02, abs(math.cos(math.radians(lat))))
    shapes = [[(lat + 0.0009 * r.uniform(0, 30), r.uniform(0, 30) * step)] for _ in range(300)]
    for s in shapes:  # of two legs, so that an edge is met more than once
        s += [(s[0][0] + 0.0005, s[0][1] + step), (s[0][0], s[0][1] + 2 * step)]
    edges = spark.createDataFrame([(i, s, i % 3 == 0) for i, s in enumerate(shapes)], "edge_id long, shape array<struct<lat:double,lon:double>>, liked boolean")
    points = [(i, lat + 0.0009 * r.uniform(-3, 33), r.uniform(-3, 33) * step) for i in range(60)]
    want, legs = {}, np.array([(i, *a, *b) for i, s in enumerate(shapes) for a, b in zip(s, s[1:])])
    for i, *at in points:
        gaps = {}
        for e, *ends in legs.tolist():
            gap = float(spatial.segment_distances(np.array(at[:1]), np.array(at[1:]), *(np.array([x]) for x in ends))[0, 0])
            gaps[int(e)] = min(gap, gaps.get(int(e), math.inf))
        want[i] = sorted((g, e) for e, g in gaps.items() if g <= 400.0)[:5]
    df = spark.createDataFrame(points, "point_id long, lat double, lon double")
    got: dict = {i: [] for i, *_ in points}
    for x in spatial.nearest_join(df, edges, 5, 400.0).orderBy("point_id", "rank").collect():
        got[x.point_id].append((x.distance_m, x.edge_id))
        assert x.rank == len(got[x.point_id])
    assert got == want
    one = {x.point_id: x.edge_id for x in spatial._nearest(df, edges, 5, 400.0, "lat", "lon", "point_id", "edge_id", "shape", "liked").collect()}
    assert one == {i: next((e for _, e in w if e % 3 == 0), w[0][1]) for i, w in want.items() if w}


def test_cells_are_as_wide_beyond_a_pole(spark):
    """A row of cells at 110 degrees is one at 70, so a leg is in as few of them."""
    counts = []
    for lat in (70.0, 110.0):
        legs = spark.createDataFrame([(1, lat, 10.0, lat, 10.001)], "edge_id long, lat1 double, lon1 double, lat2 double, lon2 double")
        cells = spatial.leg_cells(legs, 100.0, 200.0)
        wide = cells.select(F.max(F.col("_east") - F.col("_west"))).first()[0]
        counts.append((cells.count() <= 9, wide < 0.01))
    assert counts == [(True, True)] * 2


def test_distances_as_by_expression(spark):
    r = random.Random(1)
    rows = [tuple(r.uniform(-1, 1) / 100 + x for x in (57.0, 8.0) * 3) for _ in range(300)] + [(30.0, 8.0, 30.001, 8.0, 30.001, 8.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    from spokewise.functions.geo import segment_distance_m

    want = [x[0] for x in df.select(segment_distance_m(*(F.col(c) for c in "abcdef"))).collect()]
    for x, w in zip(rows, want):
        got = spatial.segment_distances(*(np.array([v]) for v in x))[0, 0]
        assert got == pytest.approx(w, abs=1e-8)


@pytest.mark.parametrize("lat", [30.0, 100.0])
def test_blocks_hold_neighbours_beyond_a_pole(spark, lat):
    """A fixture of many rows goes beyond a pole; its blocks are as square there, so trips stay near their block."""
    n = 32
    nodes = spark.range(n * n).select(F.col("id").alias("node_id"), (F.lit(lat) + 0.0009 * F.floor(F.col("id") / n)).alias("lat"), (F.lit(-97.75) + 0.0009 * (F.col("id") % n)).alias("lon"))
    edges = nodes.select(F.col("node_id").alias("from_node"), ((F.col("node_id") + 1) % (n * n)).alias("to_node"))
    spans = blocks.homes(edges, nodes, 64).groupBy("block").agg(F.count("*").alias("n"), ((F.max("lat") - F.min("lat")) / 0.0009).alias("high"), ((F.max("lon") - F.min("lon")) / 0.0009).alias("wide")).collect()
    assert len(spans) == 16 and all(x.n == 64 and x.high < 17 and x.wide < 17 for x in spans)


def test_short_trips_beyond_a_pole_take_no_rounds(spark, monkeypatch):
    n = 24
    nodes = spark.range(n * n).select(F.col("id").alias("node_id"), (F.lit(100.0) + 0.0009 * F.floor(F.col("id") / n)).alias("lat"), (F.lit(8.0) + 0.005 * (F.col("id") % n)).alias("lon"))
    at = lambda x, y: x * n + y
    edges = [(a, b, 120 + (a + b) % 9) for x in range(n) for y in range(n) for i, j in ((x + 1, y), (x, y + 1)) if i < n and j < n for a, b in ((at(x, y), at(i, j)), (at(i, j), at(x, y)))]
    monkeypatch.setattr(paths, "spread", None)
    got = found(spark, edges, (at(5, 5), at(6, 6)), (at(15, 3), at(15, 4)), (at(8, 20), at(7, 20)), nodes=nodes, block_nodes=144)
    assert [got[q, 0].status for q in range(3)] == ["ok"] * 3
