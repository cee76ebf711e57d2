"""Requests that are good, bad in one field or several, or about something that isn't there."""

import pytest

from spokewise.plans import requests as Q
from spokewise.plans.fixture import Network
from spokewise.profiles import PROFILES, resolve

SF = "/root/testdata/sf0.001"
A, B = (30.25, -97.75), (30.2518, -97.7473)

GOOD = [
    (1, [A, B], "cautious", None, False),
    (2, [A, B], None, {}, None),
    (3, [A, B], "no such", {"max_lts": 3.0, "weight_turn": 0.0}, True),
]
BAD = [
    (10, [A], "comfortable", None, False, {"waypoints"}),
    (11, None, "Cautious", None, False, {"waypoints", "profile"}),
    (12, [A, (91.0, 0.0)], None, {"weight_lts": -1.0}, False, {"waypoints", "custom"}),
    (13, [A, B], None, {"max_lts": 2.5, "speed": 1.0}, False, {"custom"}),
    (14, [A, B], None, {"max_detour": float("nan")}, False, {"custom"}),
    (15, [A, B], None, {"stress_budget_m": None}, False, {"custom"}),
    (16, [A] * 11, None, None, False, {"waypoints"}),
]


def test_request_errors(spark):
    rows = GOOD + [b[:5] for b in BAD]
    got = {r.query_id: r.e for r in spark.createDataFrame(rows, Q.REQUEST).withColumn("e", Q.request_error()).collect()}
    assert all(got[g[0]] is None for g in GOOD)
    for b in BAD:
        assert got[b[0]].code == "bad_request" and set(got[b[0]].details) == b[5], b
    assert got[13].details["custom"] == "max_lts must be a whole number; unknown field speed"


def test_same_checks_as_profiles(spark):
    cases = [{k: v} for k in Q.FIELDS for v in (-1.0, 0.0, 1.0, 4.0, 5.0, 10.0, 10.5, 20_000.0, 20_001.0)]
    got = spark.createDataFrame([(i, [A, B], None, c, False) for i, c in enumerate(cases)], Q.REQUEST).withColumn("e", Q.request_error()).orderBy("query_id").collect()
    for c, r in zip(cases, got):
        try:
            resolve(custom=c)
            assert r.e is None, c
        except ValueError as wrong:
            assert r.e.details == {"custom": str(wrong)}


def test_plan_requests(spark):
    n = Network(spark, SF)
    rows = [GOOD[0], GOOD[2]] + [b[:5] for b in BAD[:2]]
    made = spark.createDataFrame(rows, Q.REQUEST)
    got = {r.query_id: r for r in Q.plan_requests(made, n.edges, n.nodes).collect()}
    assert sorted(got) == [1, 3, 10, 11]
    assert all(got[i].status == "ok" and got[i].error is None and got[i].length_m > 0 for i in (1, 3))
    assert got[1].budget_used_m <= PROFILES["cautious"].stress_budget_m
    assert all(got[i].status == got[i].error.code == "bad_request" and got[i].edges is None for i in (10, 11))
    with pytest.raises(ValueError):
        Q.plan_requests(made, n.edges, n.nodes, most_profiles=1)
    only_bad = Q.plan_requests(made.where("query_id = 10"), n.edges, n.nodes).collect()
    assert [r.error.code for r in only_bad] == ["bad_request"]


def test_not_found(spark):
    saved = spark.createDataFrame([("u", "a"), ("u", "a"), ("v", "b")], "user_id string, route_id string")
    asked = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, None, "a")], "n int, user_id string, route_id string")
    got = {r.n: r.error for r in Q.not_found(asked, saved, ["user_id", "route_id"]).collect()}
    assert got[1] is None and got[2].code == got[3].code == "not_found" and got[2].message == "there is no user_id u route_id b"
