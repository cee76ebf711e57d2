"""The graph and its companions as Parquet tables, and rows as text for other databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import point_wkt, shape_wkt

WAYS = "way_id long, tags map<string,string>, nodes array<long>"
MAP_NODES = "osm_node_id long, lat double, lon double, tags map<string,string>"
TILES = "x int, y int, heights array<float>"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def copy_text(value: Column) -> Column:
    r"""A field of a tab-separated load file: ``\N`` for null, escapes for tab, newline, return and backslash."""
    text = value.cast("string")
    for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.coalesce(text, F.lit("\\N"))


def copy_bool(value: Column) -> Column:
    return F.when(value, F.lit("t")).when(~value, F.lit("f"))


def decimals(value: Column, places: int) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value.cast("double")))


def node_lines(nodes: DataFrame) -> DataFrame:
    """Nodes as lines of a load file."""
    fields = [F.col("node_id"), F.col("osm_node_id"), point_wkt(F.col("lat"), F.col("lon")), F.col("control")]
    return nodes.select(F.concat_ws("\t", *map(copy_text, fields)).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """Edges as lines of a load file: lengths with three decimals, bearings with two, empty texts as null."""
    c = F.col
    text = lambda name: F.nullif(c(name), F.lit(""))
    fields = [c("edge_id"), c("osm_way_id"), c("from_node"), c("to_node"), shape_wkt(c("shape")), decimals(c("length_m"), 3), text("highway"), text("name"), text("infra_class"), c("maxspeed_mph"), c("lanes"), text("surface"), copy_bool(c("lit")), decimals(c("bearing_start"), 2), decimals(c("bearing_end"), 2)]
    return edges.select(F.concat_ws("\t", *map(copy_text, fields)).alias("value"))


def strict_json(text: Column, schema: str, known: list[str], most_bytes: int = 1 << 20) -> Column:
    """A struct ``value, error``: a JSON object of known keys only, of bounded size."""
    value = F.from_json(text, schema)
    keys = F.json_object_keys(text)
    error = (
        F.when(text.isNull() | (F.trim(text) == ""), F.lit("empty"))
        .when(F.octet_length(text) > most_bytes, F.lit("too large"))
        .when(keys.isNull(), F.lit("not an object"))
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0, F.lit("unknown field"))
    )
    return F.struct(value.alias("value"), error.alias("error"))
