from pyspark.sql import functions as F

from spokewise.functions import display as D
from spokewise.operators.routes import search_summary


def shown(spark, rows, column, schema="x double"):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_texts(spark):
    x = F.col("x")
    assert shown(spark, [12.4, 999.4, 1000.0, 9_949.0, 12_600.0], D.distance_text(x)) == ["12 m", "999 m", "1.0 km", "9.9 km", "13 km"]
    assert shown(spark, [30.48, 1609.344, 20_000.0], D.distance_text(x, True)) == ["100 ft", "1.0 mi", "12 mi"]
    assert shown(spark, [29.0, 600.0, 3600.0, 5400.0], D.duration_text(x)) == ["0 min", "10 min", "1 h", "1 h 30 min"]
    at = F.timestamp_seconds(F.lit(1_000_000) - x * 60)
    assert shown(spark, [0.0, 5.0, 90.0, 1440.0, 4320.0], D.age_text(at, F.timestamp_seconds(F.lit(1_000_000)))) == ["just now", "5 min ago", "2 h ago", "yesterday", "3 days ago"]
    later = F.timestamp_seconds(F.lit(1_000_000) + x * 86_400)
    assert shown(spark, [-1.0, 1.0, 12.0], D.expiry_text(later, F.timestamp_seconds(F.lit(1_000_000)))) == ["expiring now", "expires tomorrow", "expires in 12 days"]


def test_bands(spark):
    x = F.col("x")
    assert shown(spark, [80.0, 79.9, 40.0, 39.0, None], D.score_band(x)) == ["good", "ok", "warn", "bad", None]
    share = D.budget_share(x, F.lit(400.0))
    assert shown(spark, [100.0, 240.0, 360.0, 900.0], D.budget_tone(share)) == ["good", "warn", "bad", "bad"] and shown(spark, [1.0], D.budget_share(x, F.lit(0.0))) == [None]
    assert shown(spark, ["cautious", "comfortable", "confident", "x"], D.next_profile(x), "x string") == ["comfortable", "confident", None, None]
    assert shown(spark, [24.9, 25.0], D.snap_is_told(x)) == [False, True] and shown(spark, [5.0, 30.0], D.extra_distance(x, F.lit(10.0))) == [0.0, 20.0]
    box = F.struct(*((x + n).alias(k) for k, n in (("min_lon", 0), ("min_lat", 0), ("max_lon", 4), ("max_lat", 8))))
    assert shown(spark, [0.0], D.padded(box)) == [(-1.0, -2.0, 5.0, 10.0)] and shown(spark, [0.0], D.box_contains(D.padded(box), box)) == [True]


def test_search_summary(spark):
    rows = [("ok", 10), ("ok", 20), ("ok", 90), ("unroutable", 500)]
    got = search_summary(spark.createDataFrame(rows, "status string, expansions long")).first()
    assert (got.requests, got.routed, got.mean_expansions, got.p50_expansions, got.p95_expansions) == (4, 3, 40.0, 20, 90)
