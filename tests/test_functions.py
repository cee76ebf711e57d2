"""Column functions against small tables of inputs and results."""

import math

import pytest
from pyspark.sql import functions as F

from spokewise import params as P
from spokewise.functions import costs, geo, roads
from spokewise.functions import tags as T
from spokewise.profiles import PROFILES, Profile, resolve


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_speed(spark):
    cases = {"35 mph": 35, "50": 31, "30 mph;40 mph": 30, "40 km/h": 25, "none": None, "signals": None, "walk": None, "variable": None, "mph": None, "km/h": None, ";30": None, "200": None, "0": None, "-5": None, "": None, None: None, "45mph": 45, "25 MPH": 25, "x": None, "30 mph @ night": 30}
    assert [v for (v,) in values(spark, [(k,) for k in cases], "v string", T.max_speed_mph(F.col("v")))] == list(cases.values())


def test_lanes_and_lit(spark):
    cases = [("2", 2), ("4;2", 4), ("2.5", 3), ("13", None), ("-1", None), ("x", None), ("", None), ("0", 0)]
    assert [v for (v,) in values(spark, [(k,) for k, _ in cases], "v string", T.lanes(F.col("v")))] == [v for _, v in cases]
    cases = [("yes", True), (" YES ", True), ("designated", True), ("no", False), ("0", False), ("24/7", None), ("", None), (None, None)]
    assert [v for (v,) in values(spark, [(k,) for k, _ in cases], "v string", T.tri_bool(F.col("v")))] == [v for _, v in cases]


def tagged(spark, cases, *columns):
    return values(spark, [(k,) for k, _ in cases], "tags map<string,string>", *columns)


def test_directions(spark):
    cases = [
        ({}, (True, True)), ({"oneway": "yes"}, (True, False)), ({"oneway": "-1"}, (False, True)), ({"oneway": "Reverse"}, (False, True)), ({"junction": "roundabout"}, (True, False)),
        ({"junction": "circular", "oneway": "-1"}, (False, False)), ({"oneway": "yes", "oneway:bicycle": "no"}, (True, True)), ({"oneway:bicycle": "yes"}, (True, False)), ({"oneway:bicycle": "-1"}, (False, True)),
        ({"oneway": "yes", "cycleway": "opposite_lane"}, (True, True)), ({"oneway": "yes", "cycleway": "Opposite"}, (True, False)), ({"oneway": "no"}, (True, True)),
    ]
    assert tagged(spark, cases, *T.directions(F.col("tags"))) == [v for _, v in cases]


def test_routable(spark):
    cases = [
        ({"highway": "residential"}, True), ({"highway": "motorway"}, False), ({"highway": "steps"}, False), ({"highway": "footway"}, False), ({"highway": "footway", "bicycle": "yes"}, True),
        ({"highway": "residential", "bicycle": "no"}, False), ({"highway": "residential", "bicycle": "Dismount"}, False), ({"highway": "residential", "access": "private"}, False),
        ({"highway": "residential", "access": "private", "bicycle": "permissive"}, True), ({"highway": "service", "service": "driveway"}, False), ({"highway": "service", "service": "alley"}, True),
        ({"highway": "service"}, True), ({}, False), ({"highway": "Residential"}, False), ({"highway": "path", "access": "no"}, False), ({"highway": "trunk_link"}, True), ({"highway": "unknown"}, False),
    ]
    assert [v for (v,) in tagged(spark, cases, T.routable(F.col("tags")))] == [v for _, v in cases]


def test_infra_and_control(spark):
    cases = [
        ({"highway": "cycleway"}, "protected_track"), ({"highway": "track"}, "path"), ({"highway": "bridleway"}, "pedestrian"), ({"highway": "primary"}, "none"), ({"highway": "primary", "cycleway": "lane"}, "painted_lane"),
        ({"highway": "primary", "cycleway:right": "lane", "cycleway:right:buffer": "yes"}, "buffered_lane"), ({"highway": "primary", "cycleway:right": "lane", "cycleway:right:buffer": "no"}, "painted_lane"),
        ({"highway": "primary", "cycleway:left": "track", "cycleway:right": "lane"}, "protected_track"), ({"highway": "primary", "cycleway": "share_busway"}, "shared_lane"), ({"highway": "primary", "cycleway:both": "separate"}, "none"),
        ({"highway": "primary", "cycleway": " Lane ", "cycleway:separation": "bollard"}, "buffered_lane"),
    ]
    assert [v for (v,) in tagged(spark, cases, T.infra_class(F.col("tags")))] == [v for _, v in cases]
    cases = [({"highway": "traffic_signals"}, "signal"), ({"highway": "give_way"}, "yield"), ({"highway": "crossing", "crossing": "traffic_signals"}, "crossing"), ({"crossing": "traffic_signals"}, "signal"), ({"crossing": "zebra", "crossing:signals": "yes"}, "signal"), ({"footway": "crossing"}, "crossing"), ({}, "none")]
    assert [v for (v,) in tagged(spark, cases, T.node_control(F.col("tags")))] == [v for _, v in cases]


def stress(spark, rows):
    c = F.col
    return [v for (v,) in values(spark, rows, "infra string, highway string, surface string, speed short, lanes short", roads.traffic_stress(c("infra"), c("highway"), c("surface"), c("speed"), c("lanes")))]


def test_traffic_stress(spark):
    cases = [
        (("protected_track", "primary", None, 55, 6), 1), (("path", "path", None, None, None), 1), (("path", "path", "gravel", None, None), 2), (("pedestrian", "footway", None, None, None), 2),
        (("buffered_lane", "primary", None, 30, 2), 1), (("buffered_lane", "primary", None, 45, 4), 3), (("buffered_lane", "primary", None, 50, 4), 4), (("painted_lane", "residential", None, 25, 2), 1),
        (("painted_lane", "tertiary", None, None, None), 3), (("painted_lane", "primary", None, None, None), 4), (("none", "living_street", None, None, None), 1), (("none", "service", None, None, None), 2),
        (("none", "residential", None, None, None), 2), (("none", "residential", None, 25, 2), 1), (("none", "tertiary", None, None, None), 3), (("none", "secondary", None, None, None), 4), (("shared_lane", "tertiary_link", None, 30, 6), 4), (("none", "cycleway", None, None, None), 2),
    ]
    assert stress(spark, [k for k, _ in cases]) == [v for _, v in cases]


def test_stress_properties(spark):
    infra = [i for i in P.INFRA if i not in ("path", "pedestrian")]
    rows = [(i, h, None, s, n) for i in infra for h in P.HIGHWAYS for s in range(10, 66, 5) for n in (1, 2, 3, 4, 6)]
    got = dict(zip(rows, stress(spark, rows)))
    assert set(got.values()) <= {1, 2, 3, 4}
    order = ["painted_lane", "buffered_lane", "protected_track"]
    for (i, h, x, s, n), v in got.items():
        if (i, h, x, s + 5, n) in got and h != "service":  # a service road has a rule of its own up to 20
            assert got[i, h, x, s + 5, n] >= v  # faster is never calmer
        if i in order[:-1]:
            assert got[order[order.index(i) + 1], h, x, s, n] <= v  # a better lane is never worse


def test_geodesy(spark):
    c = F.col
    rows = [(30.0, -97.0, 31.0, -97.0), (30.0, -97.0, 30.0, -96.0), (30.0, -97.0, 29.0, -97.0), (30.0, -97.0, 30.0, -98.0), (30.0, -97.0, None, -97.0)]
    got = values(spark, rows, "a double, b double, c double, d double", geo.distance_m(c("a"), c("b"), c("c"), c("d")), geo.bearing_deg(c("a"), c("b"), c("c"), c("d")))
    assert got[0][0] == pytest.approx(111_195, abs=1) and got[4] == (None, None)
    assert [g[1] for g in got[:4]] == pytest.approx([0, 90, 180, 270], abs=0.3)
    turns = [(350, 10, 20), (10, 350, -20), (0, 180, -180), (90, 90, 0), (0, 270, -90)]
    assert [v for (v,) in values(spark, [(float(a), float(b)) for a, b, _ in turns], "a double, b double", geo.turn_angle_deg(c("a"), c("b")))] == [t for *_, t in turns]
    shape = "array<struct<lat:double,lon:double>>"
    rows = [([(30.0, -97.0), (30.0, -97.0), (30.001, -97.0), (30.001, -97.001)],), ([(30.0, -97.0)],), ([],)]
    got = values(spark, rows, f"s {shape}", geo.shape_length_m(c("s")), *geo.end_bearings(c("s")), geo.shape_wkt(c("s"), srid=None), geo.line_geojson(c("s")))
    assert got[0][0] == pytest.approx(111.195 + 96.3, abs=0.3) and got[0][1] == pytest.approx(0, abs=0.01) and got[0][2] == pytest.approx(270, abs=0.01)
    assert got[1][:3] == (0.0, None, None) and got[2][3] is None and got[1][3] == "LINESTRING(-97.0000000 30.0000000)"
    back = values(spark, [(g[4],) for g in got] + [("{}",), ("x",)], "t string", geo.shape_from_geojson(c("t")))
    assert [[tuple(p) for p in b] if b else b for (b,) in back] == [r[0] for r in rows] + [None, None]


def test_box_and_distance(spark):
    c = F.col
    cases = [("-97.8,30.2,-97.7,30.3", None), ("1,2,3", "wrong count"), ("a,1,2,3", "not a number"), ("-197,0,1,1", "out of range"), ("2,1,1,2", "wrong order"), ("", "missing"), (None, "missing")]
    assert [v for (v,) in values(spark, [(k,) for k, _ in cases], "t string", geo.parse_bbox(c("t"))["error"])] == [v for _, v in cases]
    rows = [(30.0005, -97.0, [(30.0, -97.001), (30.0, -96.999)]), (30.0, -97.002, [(30.0, -97.001), (30.0, -96.999)]), (30.0, -97.0, [(30.0, -97.0)])]
    got = values(spark, rows, "a double, b double, s array<struct<lat:double,lon:double>>", geo.shape_distance_m(c("a"), c("b"), c("s")), geo.shape_fraction(c("a"), c("b"), c("s")))
    assert got[0] == pytest.approx((55.6, 0.5), abs=0.1) and got[1] == pytest.approx((96.3, 0.0), abs=0.1) and got[2] == pytest.approx((0, 0))


EDGE = "length_m double, lts short, infra_class string, surface string, grade_pct double, lit boolean, crash_score double, hazard_score double"


def test_edge_cost(spark):
    p = PROFILES["comfortable"]
    base = (100.0, 1, "none", "asphalt", 0.0, None, 0.0, 0.0)
    change = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(EDGE.split(", "), base))
    rows = [base, change(lts=2), change(lts=4), change(lts=None), change(surface="gravel"), change(surface="weird"), change(grade_pct=5.0), change(grade_pct=-5.0), change(grade_pct=-8.0), change(crash_score=0.5), change(hazard_score=1.0), change(lit=False), change(lit=True), change(grade_pct=None)]
    got = [v for (v,) in values(spark, rows, EDGE, costs.edge_cost(p, night=True, hazard=F.col("hazard_score")))]
    assert got == pytest.approx([100, 135, 100 * (1 + 5 + 12), 400, 220, 100, 124, 112, 190, 225, 250, 180, 100, 100])
    assert [v for (v,) in values(spark, rows[:3], EDGE, costs.edge_cost(PROFILES["shortest"]))] == [100, 100, 100]
    for q in PROFILES.values():
        assert all(v >= 1 for (v,) in values(spark, rows, EDGE, costs.multiplier(q, True, F.col("hazard_score"))))


def test_turn_cost(spark):
    p = PROFILES["comfortable"]
    c = F.col
    rows = [("left", 1, "none", "none", "none"), ("right", 4, "signal", "none", "none"), ("straight", 0, "stop", "path", "protected_track"), ("u_turn", 4, "signal", "path", "path"), ("left", 3, "odd", "none", "path")]
    got = values(spark, rows, "k string, l short, c string, a string, b string", costs.turn_cost(p, c("k"), c("l"), c("c"), c("a"), c("b")))
    assert [v for (v,) in got] == pytest.approx([12, 10, 4 * 1.5 * 0.7 * 0.15, 300, 60])
    kinds = values(spark, [(False, 0.0, 270.0), (False, 0.0, 90.0), (False, 0.0, 34.0), (True, 0.0, 180.0), (False, 10.0, 335.0)], "u boolean, a double, b double", costs.turn_kind(c("u"), c("a"), c("b")))
    assert [k for (k,) in kinds] == ["left", "right", "straight", "u_turn", "left"]


def test_profiles():
    assert resolve().name == "comfortable" and all(not p.problems() for p in PROFILES.values())
    with pytest.raises(ValueError, match="unknown"):
        resolve("fast")
    with pytest.raises(ValueError, match="weight_lts"):
        resolve(custom={"weight_lts": 11})
    assert len(Profile("x", 0, -1, 0, 0, 0, 0, 0, 0, -1, 0.5).problems()) == 4
    assert math.isclose(resolve(custom={"max_lts": 2, "max_detour": 2}).max_detour, 2)
