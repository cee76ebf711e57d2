"""Searches with landmarks find what a plain heap finds, and meet fewer labels."""

import heapq
import itertools
import random

import pytest

from spokewise.operators import crossing, landmarks, paths
from spokewise.plans import registry
from spokewise.plans.api import cost_table, turn_table
from spokewise.plans.fixture import Network
from spokewise.profiles import PROFILES

from .test_operators import asked, cost_rows, found, plain_buckets, plain_costs

SF = "/root/testdata/sf0.001"


def made(seed, n=24, share=0.1):
    r = random.Random(seed)
    place = {k: (50 + r.random() / 100, 8 + r.random() / 100) for k in range(n)}
    edges = [(a, b, r.randrange(10, 900), r.randrange(2000) + r.random() / 8, r.random() < 0.5) for a, b in itertools.permutations(range(n), 2) if r.random() < share]
    turn = {(i, j): 50 * r.random() for i, e in enumerate(edges) for j, f in enumerate(edges) if e[1] == f[0]}
    return place, edges, turn


def costs_after(edges, turn, first):
    """Least cost from the end of an edge to each other one, the turns counted."""
    best, heap = {}, [(0.0, first)]
    while heap:
        c, i = heapq.heappop(heap)
        if i in best:
            continue
        best[i] = c
        for j, f in enumerate(edges):
            if f[0] == edges[i][1] and j not in best:
                heapq.heappush(heap, (c + f[3] + turn[i, j], j))
    return best


@pytest.mark.parametrize("block_nodes", [12, 100])
def test_bounds_and_routes(spark, block_nodes):
    place, edges, turn = made(5)
    nodes = spark.createDataFrame([(k, *v) for k, v in place.items()], "node_id long, lat double, lon double")
    costs = cost_rows(spark, edges)
    turns = [(i, j, t) for (i, j), t in turn.items()]
    table = landmarks.landmark_table(costs, spark.createDataFrame(turns, "in_edge long, out_edge long, turn_cost double"), nodes, 4, block_nodes=block_nodes)
    marks = {r.edge_id: r.marks for r in table.collect()}
    chosen = {r.query_id: r.node for r in landmarks.rim(costs, nodes, 4).collect()}
    assert 1 < len(chosen) <= 4 and len(set(chosen.values())) == len(chosen)
    for at, node in chosen.items():
        want = plain_costs(edges, turn, node)
        assert {e: m[at] for e, m in marks.items() if m[at] < float("inf")} == pytest.approx(want)
    # what is left from each edge is never less than the bound
    least = 0
    for i, e in enumerate(edges):
        left = costs_after(edges, turn, i)
        for g in range(24):
            ends = [k for k, f in enumerate(edges) if f[1] == g and k in marks]
            if i in marks and g != e[1] and ends:
                gaps = [min(marks[k][c] for k in ends) - marks[i][c] for c in range(8)]
                bound = max((x for x in gaps if x == x), default=0.0)
                real = min((left[k] for k in ends if k in left), default=float("inf"))
                assert bound <= real + 1e-6, (i, g)
                least += bound > 0.5 * real
    assert least > 100
    pairs = [(a, b) for a in (0, 5, 11) for b in range(24) if a != b]
    for limit in (None, 700) if block_nodes == 12 else (2500,):
        more = {} if limit is None else {"budget_m": float(limit), "buckets": 4}
        got = found(spark, edges, *pairs, turns=turns, block_nodes=block_nodes, landmarks=table, **more)
        for q, (a, b) in enumerate(pairs):
            want = plain_buckets(edges, turn, a, b, limit or 1e9, 4 if limit else 1)
            assert (got[q, 0].cost is None) == (want is None) and (want is None or got[q, 0].cost == pytest.approx(want)), (a, b, limit)


def test_parts_and_one_way_streets(spark):
    """Parts that no way joins, a street that only leads out, and no landmarks at all."""
    edges = [(0, 1, 10), (1, 0, 10), (1, 2, 10), (3, 4, 10), (4, 3, 10), (2, 5, 10)]
    nodes = spark.createDataFrame([(k, 50.0 + k / 1000, 8.0 + (k % 2) / 1000) for k in range(6)], "node_id long, lat double, lon double")
    costs = cost_rows(spark, edges)
    pairs = [(0, 2), (2, 0), (0, 4), (3, 4), (0, 5), (5, 0), (1, 1)]
    plain = {k: (r.status, r.cost) for k, r in found(spark, edges, *pairs).items()}
    for some in (nodes, nodes.where("node_id > 2"), nodes.limit(0)):
        table = landmarks.landmark_table(costs, None, some, 3)
        assert {k: (r.status, r.cost) for k, r in found(spark, edges, *pairs, landmarks=table).items()} == plain
    assert landmarks.landmark_table(costs, None, nodes.limit(0)).count() == 0
    assert landmarks.landmark_table(costs.limit(0), None, nodes).count() == 0


def test_long_trips_meet_fewer_labels(spark):
    n, p = Network(spark, SF), PROFILES["comfortable"]
    costs, turns = cost_table(n.stored, p), turn_table(n.stored, n.nodes, p)
    last = n.size - 1
    trips = asked(spark, (0, last), (last, 0), (39, last - 39), (last - 39, 39))
    table = landmarks.landmark_table(costs, turns, n.nodes)
    for more in ({}, {"budget_m": p.stress_budget_m, "n_alternatives": 1}):
        plain, guided = (paths.route_requests(trips, costs, turns, n.nodes, landmarks=t, **more).collect() for t in (None, table))
        assert {(r.query_id, r.choice): (r.status, r.cost and round(r.cost, 6)) for r in plain} == {(r.query_id, r.choice): (r.status, r.cost and round(r.cost, 6)) for r in guided}
        spent = [sum(r.expansions for r in rows if r.choice == 0) for rows in (plain, guided)]
        assert spent[1] * 2 <= spent[0], spent


@pytest.mark.parametrize("block_nodes", [1, 5, 100])
def test_crossings_cost_what_a_search_costs(spark, block_nodes):
    """Trips by crossings of blocks, also those that leave a block and come back, against a plain heap."""
    place, edges, turn = made(7, 20, 0.12)
    edges.append((3, 50, 10, 10.0, False))  # a dead end in a place of its own
    turn |= {(i, len(edges) - 1): 1.0 for i, e in enumerate(edges) if e[1] == 3}
    nodes = spark.createDataFrame([(k, *v) for k, v in place.items()], "node_id long, lat double, lon double")
    turns = spark.createDataFrame([(i, j, t) for (i, j), t in turn.items()], "in_edge long, out_edge long, turn_cost double")
    pairs = [(a, b) for a in (0, 3, 5, 11) for b in (*range(20), 50)] + [(0, 99), (99, 99), (50, 0)]
    got = {r.query_id: r for r in crossing.trip_costs(asked(spark, *pairs), cost_rows(spark, edges), turns, nodes, block_nodes).collect()}
    assert len(got) == len(pairs)
    ends = {k for e in edges for k in e[:2]}
    for q, (a, b) in enumerate(pairs):
        if a == b:
            assert (got[q].status, got[q].cost) == ("ok", 0.0)
        else:
            least = min((c for e, c in plain_costs(edges, Turns(turn), a).items() if edges[e][1] == b), default=None)
            status = "ok" if least is not None else "unroutable" if {a, b} <= ends else "unknown_node"
            assert got[q].status == status and got[q].cost == (least if least is None else pytest.approx(least)), (a, b)


class Turns(dict):
    def __missing__(self, key):
        return 0.0


def test_long_trips_take_no_rounds(spark, monkeypatch):
    """A query of long trips sweeps each block once, however many trips meet it."""
    monkeypatch.setattr(paths, "spread", None)
    n = Network(spark, SF)
    assert registry.QUERIES["route_cost_long"](spark, SF).count() == n.requests_far.count() > 0
