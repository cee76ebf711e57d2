"""Versions: together, by one publisher each, by bucket, pinned, cleaned."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from spokewise.operators import versions
from spokewise.storage import create_once


def graph(spark, k):
    return {"nodes": spark.range(k).select(F.col("id").alias("node_id"), F.lit(1.0).alias("elevation_m")), "edges": spark.range(2 * k).select(F.col("id").alias("edge_id"), F.lit(1).alias("lts"))}


KEYS = {"nodes": "node_id", "edges": "edge_id"}


def sizes(spark, folder, n=None):
    return [versions.read_published(spark, folder, t, n).count() for t in ("nodes", "edges")]


def test_published_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/graph"
    first = versions.publish_together(graph(spark, 3), folder)
    assert versions.publish_together(graph(spark, 5), folder, KEYS) == 2
    assert sizes(spark, folder) == [5, 10] and sizes(spark, folder, first) == [3, 6]
    with pytest.raises(versions.Conflict):
        versions.publish_together(graph(spark, 7), folder, after=1)
    assert versions.versions(spark, folder) == [1, 2] and sizes(spark, folder) == [5, 10]
    assert sum(f.startswith("data-") for f in os.listdir(f"{tmp_path}/graph")) == 2  # the loser's data is gone


def test_two_publishers_at_once(spark, tmp_path):
    folder = f"file://{tmp_path}/graph"
    versions.publish_together(graph(spark, 1), folder)
    outcome = []

    def publish(k):
        try:
            outcome.append((k, versions.publish_together(graph(spark, k), folder, after=1)))
        except versions.Conflict:
            outcome.append((k, None))

    threads = [threading.Thread(target=publish, args=(k,)) for k in (3, 4, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    [(won, n)] = [x for x in outcome if x[1] is not None]
    assert len(outcome) == 3 and n == 2 and sizes(spark, folder) == [won, 2 * won]


def test_create_once(spark, tmp_path):
    path = f"file://{tmp_path}/a/one"
    made = []
    threads = [threading.Thread(target=lambda i=i: made.append(create_once(spark, path, str(i) * 1000))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    text = (tmp_path / "a" / "one").read_text()
    assert sum(made) == 1 and len(text) == 1000 and len(set(text)) == 1 and [f for f in os.listdir(tmp_path / "a") if not f.startswith(".")] == ["one"]


def test_update_by_bucket(spark, tmp_path):
    folder = f"file://{tmp_path}/graph"
    versions.publish_together(graph(spark, 500), folder, KEYS, buckets=16)
    old = versions._tables(spark, folder, 1)
    new = spark.createDataFrame([(7, 3), (8, 1), (9, None), (9, None), (5000, 4)], "edge_id long, lts int")
    assert versions.update_published(spark, folder, "edges", new, "lts") == 2
    got = {r.edge_id: r.lts for r in versions.read_published(spark, folder, "edges").collect()}
    assert got == {i: 1 for i in range(1000)} | {7: 3, 9: None}
    told = versions._tables(spark, folder, 2)
    changed = {b for b, p in told["edges"]["paths"].items() if p != old["edges"]["paths"][b]}
    want = {str(r[0]) for r in spark.createDataFrame([(7,), (9,)], "edge_id long").select(versions._bucket("edge_id", 16)).collect()}
    assert changed == want and told["nodes"] == old["nodes"]
    assert versions.update_published(spark, folder, "edges", new, "lts") == 0 and versions.current(spark, folder) == 2
    assert {r.lts for r in versions.read_published(spark, folder, "edges", 1).collect()} == {1}
    with pytest.raises(versions.Conflict):
        versions.update_published(spark, folder, "edges", spark.createDataFrame([(1, 4)], "edge_id long, lts int"), "lts", after=1)


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}/graph"
    versions.publish_together(graph(spark, 0), folder, KEYS)
    assert sizes(spark, folder) == [0, 0] and versions.read_published(spark, folder, "edges").columns == ["edge_id", "lts"]
    assert versions.update_published(spark, folder, "edges", spark.createDataFrame([(1, 4)], "edge_id long, lts int"), "lts") == 0


def test_pins_and_cleaning(spark, tmp_path):
    folder = f"file://{tmp_path}/graph"
    one = lambda v: spark.createDataFrame([(7, v)], "edge_id long, lts int")
    versions.publish_together(graph(spark, 100), folder, KEYS, buckets=4)
    with versions.pinned(spark, folder) as n:
        for v in (2, 3, 4):
            versions.update_published(spark, folder, "edges", one(v).select(F.col("edge_id").cast("int"), "lts"), "lts")
        assert versions.clean(spark, folder, keep=1) == [2, 3]
        assert sizes(spark, folder, n) == [100, 200] and versions.versions(spark, folder) == [1, 4]
        assert versions.read_published(spark, folder, "edges", n).where("lts <> 1").isEmpty()
    assert versions.clean(spark, folder, keep=1) == [1]
    assert sizes(spark, folder) == [100, 200]  # shared buckets stay
    assert [r.lts for r in versions.read_published(spark, folder, "edges").where("edge_id = 7").collect()] == [4]
    with pytest.raises(ValueError), versions.pinned(spark, folder, 1):
        pass
