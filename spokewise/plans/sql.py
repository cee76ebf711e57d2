"""DuckDB SQL over the same tables: the fixture network and pieces of formulas, written on their own."""

from __future__ import annotations

from .. import params as P
from ..profiles import Profile

R2 = 2 * P.EARTH_RADIUS_M


def case(value: str, table: dict, other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table.items()) + f" ELSE {other} END"


def by_level(lts: str, values: list[float]) -> str:
    return f"CASE coalesce({lts}, 0) " + " ".join(f"WHEN {n} THEN {v}::DOUBLE" for n, v in enumerate(values)) + " END"


def distance(a: str, b: str, c: str, d: str) -> str:
    return f"({R2}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def fraction(lat: str, lon: str, e: str = "e") -> str:
    k = f"cos(radians({lat}))"
    dx, dy = f"(({e}.lon2 - {e}.lon1) * {k})", f"({e}.lat2 - {e}.lat1)"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({lon} - {e}.lon1) * {k} * {dx} + ({lat} - {e}.lat1) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"


def to_edge(lat: str, lon: str, e: str = "e") -> str:
    t = fraction(lat, lon, e)
    return distance(lat, lon, f"({e}.lat1 + ({e}.lat2 - {e}.lat1) * {t})", f"({e}.lon1 + ({e}.lon2 - {e}.lon1) * {t})")


#: Common tables ``node``, ``edge`` and ``request``; to be followed by more of them, or by a SELECT after
#: dropping the last comma.
GRAPH = f"""
n AS (SELECT count(*) AS n FROM part),
node AS (
  SELECT p_partkey AS node_id, 30.25::DOUBLE + (p_partkey // 40) * 0.0009::DOUBLE AS lat, -97.75::DOUBLE + (p_partkey % 40) * 0.0009::DOUBLE AS lon,
         ['none', 'signal', 'stop', 'yield', 'crossing', 'roundabout'][p_size % 6 + 1] AS control, p_retailprice % 50 AS elevation_m FROM part),
seg AS (
  SELECT p_partkey AS i, 0 AS d, p_partkey + 1 AS other, * FROM part, n WHERE p_partkey % 40 < 39 AND p_partkey + 1 < n
  UNION ALL SELECT p_partkey, 1, p_partkey + 40, * FROM part, n WHERE p_partkey + 40 < n),
way AS (
  SELECT i, d, other, CAST(101 + (i * 7 + d * 13) % 40 AS DOUBLE) AS length_m,
         CASE p_type WHEN 'ECONOMY' THEN 'residential' WHEN 'LARGE' THEN 'primary' WHEN 'MEDIUM' THEN 'tertiary' WHEN 'PROMO' THEN 'service' WHEN 'SMALL' THEN 'living_street' WHEN 'STANDARD' THEN 'secondary' END AS highway,
         ['none', 'pedestrian', 'shared_lane', 'painted_lane', 'buffered_lane', 'path', 'protected_track'][(i + 3 * d) % 7 + 1] AS infra_class,
         ['asphalt', 'compacted', 'gravel', 'sand', NULL][i % 5 + 1] AS surface,
         CASE WHEN i % 4 = 0 THEN 20 + 5 * (p_size % 8) END AS maxspeed_mph, CASE WHEN i % 4 = 1 THEN 1 + p_size % 6 END AS lanes,
         CASE i % 3 WHEN 0 THEN true WHEN 1 THEN false END AS lit
  FROM seg WHERE (i * 11 + d) % 17 <> 0),
directed AS (
  SELECT (i * 2 + d) * 2 AS edge_id, i AS from_node, other AS to_node, * FROM way
  UNION ALL SELECT (i * 2 + d) * 2 + 1, other, i, * FROM way WHERE (i * 5 + d) % 9 <> 0),
placed AS (
  SELECT directed.*, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, a.elevation_m AS up1, b.elevation_m AS up2,
         coalesce(maxspeed_mph, CASE highway WHEN 'living_street' THEN 15 WHEN 'service' THEN 15 WHEN 'residential' THEN 30 WHEN 'tertiary' THEN 35 WHEN 'secondary' THEN 40 WHEN 'primary' THEN 45 END) AS s,
         coalesce(lanes, CASE highway WHEN 'secondary' THEN 4 WHEN 'primary' THEN 4 ELSE 2 END) AS l
  FROM directed JOIN node a ON a.node_id = from_node JOIN node b ON b.node_id = to_node),
edge AS (
  SELECT *, CASE
      WHEN infra_class = 'protected_track' THEN 1
      WHEN infra_class = 'path' THEN CASE WHEN surface IN ('gravel', 'sand') THEN 2 ELSE 1 END
      WHEN infra_class = 'pedestrian' THEN 2
      WHEN infra_class = 'buffered_lane' THEN CASE WHEN s <= 30 AND l <= 3 THEN 1 WHEN s <= 35 THEN 2 WHEN s <= 45 THEN 3 ELSE 4 END
      WHEN infra_class = 'painted_lane' THEN CASE WHEN s <= 25 AND l <= 2 THEN 1 WHEN s <= 30 AND l <= 3 THEN 2 WHEN s <= 35 AND l <= 4 THEN 3 ELSE 4 END
      WHEN highway = 'living_street' THEN 1
      WHEN highway = 'service' AND s <= 20 THEN 2
      WHEN l >= 6 OR s >= 45 THEN 4
      WHEN s >= 35 THEN CASE WHEN l >= 4 THEN 4 ELSE 3 END
      WHEN s >= 26 THEN CASE WHEN l >= 4 THEN 3 ELSE 2 END
      ELSE CASE WHEN l >= 4 THEN 3 ELSE 1 END END AS lts,
    CASE WHEN length_m < 20 THEN 0.0::DOUBLE ELSE greatest(-25.0::DOUBLE, least(25.0::DOUBLE, (up2 - up1) / length_m * 100)) END AS grade_pct,
    (degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360 AS bearing
  FROM placed),
request AS (
  SELECT s_suppkey AS query_id, s_suppkey * 19 % n AS from_node, s_suppkey * 19 % n + 83 AS to_node FROM supplier, n
  WHERE (s_suppkey * 19 % n) % 40 <= 36 AND s_suppkey * 19 % n + 83 < n),
walk AS (
  SELECT query_id, p.pos, edge_id FROM request r, (SELECT unnest(range(0, 12)) AS pos) p JOIN edge e ON e.from_node = r.from_node + p.pos AND e.to_node = e.from_node + 1
  WHERE (r.from_node + p.pos) // 40 = r.from_node // 40),
crash AS (
  SELECT o_orderkey AS crash_id, lat + (o_orderkey % 11 - 5) * 0.00003::DOUBLE AS lat, lon + (o_orderkey % 11 - 5) * 0.00003::DOUBLE AS lon,
         5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS severity, o_orderdate AS occurred_at, o_orderkey % 35 <> 0 AS cyclist_involved
  FROM orders, n JOIN node ON node_id = o_custkey % n),
hazard AS (
  SELECT event_id AS hazard_id, lat + (event_id % 7 - 3) * 0.00004::DOUBLE AS lat, lon + (event_id % 7 - 3) * 0.00004::DOUBLE AS lon,
         CASE WHEN event_id % 100 = 0 THEN 'other' WHEN event_type = 'click' THEN 'debris' WHEN event_type = 'error' THEN 'dangerous_junction' WHEN event_type = 'purchase' THEN 'construction' WHEN event_type = 'signup' THEN 'pothole' ELSE 'blocked_lane' END AS kind,
         CAST(json_extract_string(props, '$.k') AS INT) % 10 AS confirmations, ts AS created_at, ts + INTERVAL 90 DAYS AS expires_at
  FROM events, n JOIN node ON node_id = (user_id * 13 + event_id) % n),
"""


def with_graph(rest: str, select: str = "", recursive: bool = False) -> str:
    """A query over the common tables; ``rest`` has more of them."""
    tables = GRAPH + rest if rest else GRAPH.rstrip().rstrip(",")
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables}\n{select}"


def multiplier(p: Profile) -> str:
    over = f"CASE WHEN lts > {p.max_lts} THEN {p.weight_lts * P.OVER_PENALTY}::DOUBLE ELSE 0.0::DOUBLE END"
    surface = "CASE surface WHEN 'compacted' THEN 0.25::DOUBLE WHEN 'gravel' THEN 1.2::DOUBLE WHEN 'sand' THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END"
    grade = "CASE WHEN grade_pct > 3 THEN (grade_pct - 3) * 0.12::DOUBLE WHEN grade_pct < -3 THEN (-grade_pct - 3) * 0.06::DOUBLE + CASE WHEN grade_pct <= -8 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END"
    return f"(1.0::DOUBLE + {p.weight_lts}::DOUBLE * ({by_level('lts', P.LTS_PENALTY)}) + {over} + {p.weight_surface}::DOUBLE * ({surface}) + {p.weight_grade}::DOUBLE * ({grade}))"


MAX_LTS = """max_lts AS (SELECT node, max(lts) AS max_lts FROM (SELECT from_node AS node, lts FROM edge UNION ALL SELECT to_node, lts FROM edge) GROUP BY node),
move AS (
  SELECT a.edge_id AS in_edge, b.edge_id AS out_edge, b.from_node AS node, a.infra_class AS infra_in, b.infra_class AS infra_out, max_lts, control,
         CASE WHEN a.from_node = b.to_node THEN 'u_turn' WHEN turn <= -35 THEN 'left' WHEN turn >= 35 THEN 'right' ELSE 'straight' END AS kind
  FROM edge a JOIN edge b ON b.from_node = a.to_node JOIN max_lts ON max_lts.node = b.from_node JOIN node ON node_id = b.from_node,
       LATERAL (SELECT (b.bearing - a.bearing + 540) % 360 - 180 AS turn))
"""


def turn(p: Profile) -> str:
    base = "CASE kind WHEN 'left' THEN 40.0::DOUBLE WHEN 'right' THEN 10.0::DOUBLE ELSE 4.0::DOUBLE END"
    control = "CASE control WHEN 'signal' THEN 0.25::DOUBLE WHEN 'stop' THEN 0.7::DOUBLE WHEN 'yield' THEN 0.85::DOUBLE WHEN 'crossing' THEN 0.5::DOUBLE WHEN 'roundabout' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"
    separated = "CASE WHEN infra_in IN ('path', 'protected_track') AND infra_out IN ('path', 'protected_track') THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END"
    return f"({p.weight_turn}::DOUBLE * CASE WHEN kind = 'u_turn' THEN 300.0::DOUBLE ELSE {base} * ({by_level('max_lts', P.CROSSING_FACTOR)}) * {control} * {separated} END)"
