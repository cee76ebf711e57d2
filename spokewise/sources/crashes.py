"""Collision records from landed JSON files, read tolerantly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import is_position

FIELDS = ["cris_crash_id", "case_id", "latitude", "longitude", "crash_timestamp", "death_cnt", "sus_serious_injry_cnt", "nonincap_injry_cnt", "poss_injry_cnt", "units_involved"]
MOST_RECORDS = 50_000


def read_crashes(spark: SparkSession, path: str, since: Column | None = None, limit: int | None = MOST_RECORDS, multiline: bool = False) -> DataFrame:
    """Usable records of cyclists' crashes at ``path``, oldest first, up to ``limit`` (a feature of the feed)."""
    raw = spark.read.schema(", ".join(f"{f} string" for f in FIELDS)).option("multiLine", multiline).json(path)
    raw = raw.where(F.col("units_involved").contains("Bicycle") & F.col("latitude").isNotNull())
    found = parse_crashes(raw)
    if since is not None:
        found = found.where(F.col("occurred_at") > since)
    return found.orderBy("occurred_at", "source_id").limit(limit) if limit else found


def number(c: Column) -> Column:
    """A number or a quoted number; anything else is 0."""
    return F.coalesce(F.trim(c, F.lit('"')).try_cast("double"), F.lit(0.0))


def severity() -> Column:
    """Severity 4 (fatal) to 0 (no injury), from the counts."""
    counts = ["death_cnt", "sus_serious_injry_cnt", "nonincap_injry_cnt", "poss_injry_cnt"]
    out = F.when(F.lit(False), F.lit(0))
    for level, name in zip((4, 3, 2, 1), counts):
        out = out.when(number(F.col(name)).cast("int") > 0, F.lit(level))
    return out.otherwise(F.lit(0)).cast("short")


def occurred_at(c: Column) -> Column:
    """A time with or without an offset; null for other forms."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))


def parse_crashes(raw: DataFrame, source: str = "austin") -> DataFrame:
    """Rows with a position, a time and an id; others are dropped."""
    lat, lon = number(F.col("latitude")), number(F.col("longitude"))
    key = F.coalesce(F.nullif(F.trim("cris_crash_id"), F.lit("")), F.nullif(F.trim("case_id"), F.lit("")))
    out = raw.select(
        F.lit(source).alias("source"), key.alias("source_id"), lat.alias("lat"), lon.alias("lon"), occurred_at(F.col("crash_timestamp")).alias("occurred_at"),
        severity().alias("severity"), F.coalesce(F.col("units_involved").contains("Bicycle"), F.lit(False)).alias("cyclist_involved"), F.to_json(F.struct(*FIELDS)).alias("raw"),
    )
    return out.where(is_position(F.col("lat"), F.col("lon")) & (F.col("lat") != 0) & (F.col("lon") != 0) & F.col("occurred_at").isNotNull() & F.col("source_id").isNotNull())
