"""A road network made by rule from the star-schema tables, so that any engine can make the same one.

Parts are nodes of a grid 40 wide, orders are crashes, events are hazard reports, suppliers ask for routes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions.geo import bearing_deg
from ..operators.network import score_edges
from ..operators.terrain import edge_grades
from ..storage import apart, stash

HIGHWAY_OF = {"ECONOMY": "residential", "LARGE": "primary", "MEDIUM": "tertiary", "PROMO": "service", "SMALL": "living_street", "STANDARD": "secondary"}
SURFACE_OF = ["asphalt", "compacted", "gravel", "sand", None]
KIND_OF = {"click": "debris", "error": "dangerous_junction", "purchase": "construction", "signup": "pothole", "view": "blocked_lane"}
CRASH_AS_OF, HAZARD_AS_OF = "2002-01-01", "2024-02-15"


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


@dataclass(frozen=True)
class Network:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def size(self) -> int:
        return self.read("part").count()

    @cached_property
    def nodes(self) -> DataFrame:
        i = F.col("p_partkey")
        return self.read("part").select(
            i.alias("node_id"),
            (F.lit(30.25) + F.expr("p_partkey div 40") * F.lit(0.0009)).alias("lat"),
            (F.lit(-97.75) + (i % 40) * F.lit(0.0009)).alias("lon"),
            pick(P.CONTROLS, F.col("p_size") % 6).alias("control"),
            (F.col("p_retailprice") % 50).alias("elevation_m"),
        )

    @cached_property
    def raw_edges(self) -> DataFrame:
        """Directed edges before any score."""
        part = self.read("part").withColumn("id", F.col("p_partkey"))
        step = F.explode(F.array(F.struct(F.lit(0).alias("dir"), (F.col("id") + 1).alias("other")), F.struct(F.lit(1).alias("dir"), (F.col("id") + 40).alias("other"))))
        seg = part.withColumn("s", step).select("*", "s.dir", "s.other").where((F.col("other") < self.size) & ((F.col("dir") == 1) | (F.col("id") % 40 < 39)) & ((F.col("id") * 11 + F.col("dir")) % 17 != 0))
        i, d, size = F.col("id"), F.col("dir"), F.col("p_size")
        seg = seg.select(
            i, d, "other",
            (F.lit(101.0) + (i * 7 + d * 13) % 40).alias("length_m"),
            F.element_at(F.create_map(*(F.lit(x) for kv in HIGHWAY_OF.items() for x in kv)), F.col("p_type")).alias("highway"),
            pick(P.INFRA, (i + 3 * d) % 7).alias("infra_class"),
            pick(SURFACE_OF, i % 5).alias("surface"),
            F.when(i % 4 == 0, (20 + 5 * (size % 8)).cast("short")).alias("maxspeed_mph"),
            F.when(i % 4 == 1, (1 + size % 6).cast("short")).alias("lanes"),
            F.when(i % 3 == 0, F.lit(True)).when(i % 3 == 1, F.lit(False)).alias("lit"),
        )
        ends = lambda n: (F.col("id"), F.col("other")) if n == 0 else (F.col("other"), F.col("id"))
        ways = [F.when(F.lit(n == 0) | ((i * 5 + d) % 9 != 0), F.struct(((i * 2 + d) * 2 + n).alias("edge_id"), ends(n)[0].alias("from_node"), ends(n)[1].alias("to_node"))) for n in (0, 1)]
        seg = seg.withColumn("w", F.explode(F.array_compact(F.array(*ways)))).select("w.*", *[c for c in seg.columns if c not in ("id", "dir", "other")])
        place = lambda end: self.nodes.select(F.col("node_id").alias(f"{end}_node"), F.struct("lat", "lon").alias(f"_{end}"))
        edges = seg.join(apart(place("from")), "from_node").join(apart(place("to")), "to_node")
        bearing = bearing_deg(F.col("_from.lat"), F.col("_from.lon"), F.col("_to.lat"), F.col("_to.lon"))
        return edges.select("*", F.array("_from", "_to").alias("shape"), bearing.alias("bearing_start"), bearing.alias("bearing_end")).drop("_from", "_to")

    @cached_property
    def edges(self) -> DataFrame:
        """Edges with stress levels, gradients, and no crashes."""
        return edge_grades(score_edges(self.raw_edges), self.nodes).withColumn("crash_score", F.lit(0.0))

    @cached_property
    def stored(self) -> DataFrame:
        """The edges, written once, for queries that use them again and again."""
        return stash(self.edges, "edges")

    def _at(self, df: DataFrame, node: Column, offset: Column) -> DataFrame:
        placed = df.withColumn("node_id", node).join(self.nodes.select("node_id", "lat", "lon"), "node_id")
        return placed.withColumns({"lat": F.col("lat") + offset, "lon": F.col("lon") + offset})

    @cached_property
    def crashes(self) -> DataFrame:
        k = F.col("o_orderkey")
        found = self._at(self.read("orders"), F.col("o_custkey") % self.size, (k % 11 - 5) * F.lit(0.00003))
        return found.select(
            k.alias("crash_id"), "lat", "lon", (F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int")).cast("short").alias("severity"),
            F.col("o_orderdate").cast("timestamp").alias("occurred_at"), (k % 35 != 0).alias("cyclist_involved"),
        )

    @cached_property
    def hazards(self) -> DataFrame:
        e = F.col("event_id")
        found = self._at(self.read("events"), (F.col("user_id") * 13 + e) % self.size, (e % 7 - 3) * F.lit(0.00004))
        kind = F.element_at(F.create_map(*(F.lit(x) for kv in KIND_OF.items() for x in kv)), F.col("event_type"))
        return found.select(
            e.alias("hazard_id"), "lat", "lon", F.when(e % 100 == 0, F.lit("other")).otherwise(kind).alias("kind"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("confirmations"),
            F.col("ts").cast("timestamp").alias("created_at"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 90 DAYS")).alias("expires_at"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        s = F.col("s_suppkey")
        start = s * 19 % self.size
        return self.read("supplier").select(s.alias("query_id"), start.alias("from_node"), (start + 83).alias("to_node")).where((F.col("from_node") % 40 <= 36) & (F.col("to_node") < self.size))

    @cached_property
    def requests_far(self) -> DataFrame:
        """From each supplier's node to the one as far from the other end of the grid."""
        s = F.col("s_suppkey") * 19 % self.size
        return self.read("supplier").select(F.col("s_suppkey").alias("query_id"), s.alias("from_node"), (F.lit(self.size - 1) - s).alias("to_node")).where("from_node <> to_node")

    @staticmethod
    def as_of(day: str) -> Column:
        return F.lit(day).cast("timestamp")

    @cached_property
    def walks(self) -> DataFrame:
        """``query_id, pos, edge_id``: for each request, the row of edges east of its start."""
        east = self.edges.where("to_node = from_node + 1").select("edge_id", "from_node")
        steps = self.requests.select("query_id", F.col("from_node").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos"))
        inside = steps.withColumn("from_node", F.col("s") + F.col("pos")).where("from_node div 40 = s div 40")
        return inside.join(east, "from_node").select("query_id", "pos", "edge_id")
