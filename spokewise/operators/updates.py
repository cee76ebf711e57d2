"""Tables that change: updates by key, loads without duplicates, a snapshot in place, saved routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def changed_rows(table: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` where the new value differs from the table's, nulls counting as values."""
    joined = table.select(key, F.col(value).alias("_old")).join(new.select(key, value), key)
    return joined.where(~F.col(value).eqNullSafe(F.col("_old"))).select(key, value)


def updated(table: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """The table with the values of ``new`` where it has the key."""
    joined = table.join(new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_has")), key, "left")
    return joined.withColumn(value, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(value))).select(*table.columns)


def load_crashes(table: DataFrame, fetched: DataFrame, source: str) -> DataFrame:
    """The table with the source's rows replaced by the fetched ones, one for each ``source_id``: the earliest,
    then the one of the smallest hash."""
    kept = table.where(F.col("source") != source)
    columns = [c for c in table.columns if c not in ("source", "source_id")]
    one = fetched.where(F.col("source") == source).groupBy("source", "source_id").agg(F.min_by(F.struct(*columns), F.struct("occurred_at", F.xxhash64(*columns).alias("h"))).alias("row"))
    return kept.unionByName(one.select("source", "source_id", "row.*").select(*table.columns))


def publish(df: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Writes a snapshot to replace the one at ``path``; ``key`` keeps rows of a key in one file, in order.

    Spark commits an overwrite as one job: readers that pinned files of the old snapshot must reread.
    """
    (df.repartition(*key).sortWithinPartitions(*key) if key else df).write.mode("overwrite").parquet(path)


def refresh_statistics(spark: SparkSession, *tables: str) -> None:
    """Counts anew the rows of catalog tables and the values of their columns, from which Spark plans joins."""
    for t in tables:
        spark.catalog.refreshTable(t)
        spark.sql(f"ANALYZE TABLE {t} COMPUTE STATISTICS FOR ALL COLUMNS")


def update_elevations(nodes: DataFrame, measured: DataFrame) -> DataFrame:
    """Nodes with the measured heights (``node_id, elevation_m``), to a hundredth of a metre."""
    return updated(nodes, measured.select("node_id", F.round("elevation_m", 2).alias("elevation_m")), "node_id", "elevation_m")


def waypoint_problems(waypoints: Column) -> Column:
    """What is wrong with an array of ``lat, lon``, as an array; empty if it is good."""
    from ..functions.geo import is_position

    checks = [
        (F.coalesce(F.size(waypoints), F.lit(0)) < 2, "at least 2 waypoints"),
        (F.coalesce(F.size(waypoints), F.lit(0)) > 10, "at most 10 waypoints"),
        (~F.coalesce(F.forall(waypoints, lambda w: is_position(w["lat"], w["lon"])), F.lit(True)), "a waypoint is out of range"),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in checks)))


def save_routes(saved: DataFrame, new: DataFrame) -> DataFrame:
    """The saved routes with new ones (``route_id, user_id, name, waypoints, ...``); bad ones are left out."""
    good = (F.size(waypoint_problems(F.col("waypoints"))) == 0) & F.char_length(F.trim("name")).between(1, 120)
    return saved.unionByName(new.where(good), allowMissingColumns=True)


def list_routes(saved: DataFrame, user_id: str, limit: int = 50) -> DataFrame:
    """An owner's routes without geometry, newest first; a limit out of 1..200 counts as 50."""
    own = saved.where(F.col("user_id") == user_id).drop("shape", "geojson")
    return own.orderBy(F.desc("created_at"), "route_id").limit(limit if 0 < limit <= 200 else 50)


def get_route(saved: DataFrame, user_id: str, route_id: str) -> DataFrame:
    return saved.where((F.col("user_id") == user_id) & (F.col("route_id") == route_id))


def delete_route(saved: DataFrame, user_id: str, route_id: str) -> DataFrame:
    return saved.where(~((F.col("user_id") == user_id) & (F.col("route_id") == route_id)))
