"""Files in, text out, and the live overlay."""

import datetime as dt
import json
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokewise.functions.geo import point_wkt
from spokewise.sources import crashes, tables, tiles
from spokewise.streaming import hazards


def png(pixels, filters=(0, 1, 2, 3, 4)):
    """An 8-bit PNG of rows x columns x channels, its lines filtered in turn."""
    h, w, c = pixels.shape
    flat = pixels.reshape(h, w * c).astype(int)
    lines = []
    for y in range(h):
        how = filters[y % len(filters)]
        line = []
        for x in range(w * c):
            a = flat[y, x - c] if x >= c else 0
            b = flat[y - 1, x] if y else 0
            d = flat[y - 1, x - c] if y and x >= c else 0
            paeth = min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
            line.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[how]) % 256)
        lines.append(bytes([how, *line]))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_png_and_tiles(spark, tmp_path):
    r = np.random.default_rng(1)
    for c in (3, 4):
        small = r.integers(0, 256, (9, 7, c))
        assert (tiles.png_pixels(png(small)) == small).all()
    assert tiles.png_pixels(b"x") is None and tiles.terrarium(png(small)) is None and tiles.png_pixels(png(small)[:-30]) is None
    tile = np.zeros((256, 256, 3), dtype=int)
    tile[:, :, 0], tile[:, :, 1], tile[:, :, 2] = 128, np.arange(256)[None, :], 64
    (tmp_path / "1871").mkdir()
    (tmp_path / "1871" / "3373.png").write_bytes(png(tile, (0, 1)))
    (tmp_path / "1871" / "3374.png").write_bytes(b"no tile")
    got = {(x.x, x.y): x.heights for x in tiles.read_tiles(spark, str(tmp_path)).collect()}
    assert got[1871, 3374] is None and len(got[1871, 3373]) == 65_536 and got[1871, 3373][258] == 2.25


def test_read_crashes(spark, tmp_path):
    base = {"cris_crash_id": "7", "latitude": 30.2, "longitude": "-97.7", "crash_timestamp": "2020-05-01T10:00:00.000", "units_involved": "Motor vehicle & Bicycle"}
    rows = [
        base, base | {"cris_crash_id": " ", "case_id": "c8", "death_cnt": "1"}, base | {"cris_crash_id": "9", "latitude": "0"}, base | {"cris_crash_id": "10", "units_involved": "Motor vehicle"},
        base | {"cris_crash_id": "11", "crash_timestamp": "2021-01-01T00:00:00Z", "poss_injry_cnt": 2}, base | {"cris_crash_id": "12", "crash_timestamp": "soon"}, {k: v for k, v in base.items() if k != "latitude"}, base | {"cris_crash_id": "", "case_id": ""}, base | {"cris_crash_id": "13", "latitude": "95"},
    ]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    got = crashes.read_crashes(spark, str(tmp_path / "c.json"))
    assert [(x.source_id, x.severity, x.cyclist_involved) for x in got.collect()] == [("7", 0, True), ("c8", 4, True), ("11", 1, True)]
    assert crashes.read_crashes(spark, str(tmp_path / "c.json"), since=F.lit("2020-12-01").cast("timestamp")).count() == 1


def test_load_lines(spark):
    rows = [("a\tb\nc\rd\\N",), (None,), ("é\\",)]
    got = [x.t for x in spark.createDataFrame(rows, "v string").select(tables.copy_text(F.col("v")).alias("t")).collect()]
    assert got == ["a\\tb\\nc\\rd\\\\N", "\\N", "é\\\\"]
    assert spark.range(1).select(point_wkt(F.lit(30.25), F.lit(-97.75)).alias("w")).first().w == "SRID=4326;POINT(-97.7500000 30.2500000)"
    rows = [('{"a": 1}',), ('{"a": 1, "b": 2}',), ("[1]",), ("",), ('{"a": "' + "x" * 40 + '"}',)]
    got = spark.createDataFrame(rows, "t string").select(tables.strict_json(F.col("t"), "a string", ["a"], 30).alias("j")).collect()
    assert [x.j.error for x in got] == [None, "unknown field", "not an object", "empty", "too large"]


def at(d):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


class Overlay:
    """A stream over a folder, run batch by batch, and all events that it was given."""

    def __init__(self, spark, tmp_path, edges):
        self.spark, self.edges, self.events = spark, edges, []
        self.source, self.path, self.checkpoint = (f"{tmp_path}/{x}" for x in ("in", "overlay", "checkpoint"))

    def run(self, *rows):
        self.events += rows
        self.spark.createDataFrame(rows, hazards.EVENT).coalesce(1).write.mode("append").parquet(self.source)
        stream = self.spark.readStream.schema(hazards.EVENT).parquet(self.source)
        hazards.run_overlay(stream, self.edges, self.path, self.checkpoint).trigger(availableNow=True).start().awaitTermination()

    def scores(self, as_of, version=None):
        return {x.edge_id: (pytest.approx(x.total), pytest.approx(x.hazard_score)) for x in hazards.overlay_at(self.spark, self.path, F.lit(as_of), version).collect()}

    def plain(self, as_of):
        known = self.spark.createDataFrame([e for e in self.events if e[1] != "tick"], hazards.EVENT)
        return {x.edge_id: (x.total, x.hazard_score) for x in hazards.overlay(known, self.edges, F.lit(as_of)).collect()}

    def kept(self):
        rows = hazards.hazards_at(self.spark, self.path).withColumn("t", F.unix_seconds("expires_at")).collect()
        return {r.hazard_id: (r.confirmations, (r.t - 1_704_067_200) / 86_400) for r in rows}


def two_edges(spark):
    return spark.createDataFrame([(1, [(30.0, -97.0), (30.001, -97.0)]), (2, [(31.0, -97.0), (31.001, -97.0)])], "edge_id long, shape array<struct<lat:double,lon:double>>")


def report(n, hazard, lat, kind, d, notes=None):
    return (n, "report", hazard, lat, -97.0, kind, notes, at(d))


def confirm(n, hazard, d):
    return (n, "confirm", hazard, None, None, None, None, at(d))


def tick(n, d):
    return (n, "tick", None, None, None, None, None, at(d))


def test_live_overlay(spark, tmp_path):
    live = Overlay(spark, tmp_path, two_edges(spark))
    live.run(report(1, 10, 30.0005, "debris", 0), report(2, 11, 31.0, "pothole", 1, "deep"))
    first = max(int(f[6:]) for f in os.listdir(f"{live.path}/reach") if f.startswith("batch="))
    before = live.plain(at(2))
    assert sorted(before) == [1, 2] and live.scores(at(2)) == before
    live.run(confirm(3, 10, 80), report(1, 10, 30.0005, "debris", 0), report(4, 12, 40.0, "other", 100, ""))
    assert sorted(live.plain(at(100))) == [1] and live.scores(at(100)) == live.plain(at(100))  # the second one has run out
    assert live.scores(at(2), first) == before  # a pinned version


def test_hazards_run_out_by_event_time(spark, tmp_path):
    live = Overlay(spark, tmp_path, two_edges(spark))
    live.run(report(1, 10, 30.0005, "debris", 0), report(2, 11, 31.0, "pothole", 0), confirm(3, 10, 50), confirm(3, 10, 50))
    assert live.kept() == {10: (1, 104), 11: (0, 90)}
    live.run(tick(4, 91))
    live.run(tick(5, 91))
    assert live.kept() == {10: (1, 104)}  # nothing was reported of either
    live.run(confirm(6, 10, 103), confirm(7, 11, 92), confirm(8, 99, 92))
    live.run(tick(9, 110))
    assert live.kept() == {10: (2, 118)} and live.scores(at(105)) == live.plain(at(105))
    hazards.compact(spark, live.path, max(int(f[6:]) for f in os.listdir(f"{live.path}/reach") if f.startswith("batch=")), clear=True)
    assert live.kept() == {10: (2, 118)} and live.scores(at(105)) == live.plain(at(105))
    live.run(report(10, 13, 31.0, "other", 111))
    assert live.scores(at(112)) == live.plain(at(112)) and sorted(live.kept()) == [10, 13]
    live.run(tick(11, 119))
    live.run(tick(12, 119))
    assert sorted(live.kept()) == [13]


def test_overlay_by_differences(spark, tmp_path):
    r = random.Random(5)
    live = Overlay(spark, tmp_path, two_edges(spark))
    for b in range(4):
        rows = [report(100 * b + i, 100 * b + i, r.choice([30.0, 30.0007, 31.0002, 35.0]), r.choice(["debris", "other", "no such"]), 40 * b + r.random() / 30) for i in range(5)]
        known = [e[2] for e in live.events if e[1] == "report"] + [x[2] for x in rows]
        rows += [confirm(100 * b + 50 + i, r.choice(known), 40 * b + 0.035 + r.random() / 200) for i in range(12)]
        r.shuffle(rows)
        live.run(*rows)
        assert live.scores(at(40 * b + 1)) == live.plain(at(40 * b + 1))
    writes = spark.read.parquet(f"{live.path}/reach").groupBy("hazard_id", "edge_id").count()
    assert writes.where("count > 1").isEmpty() and not writes.isEmpty()  # edges are looked up once a hazard
