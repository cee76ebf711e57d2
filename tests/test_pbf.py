"""A small extract, written here byte by byte, read back."""

import itertools
import struct
import zlib

from pyspark.sql import functions as F

from spokewise import params as P
from spokewise.functions import tags as T
from spokewise.operators import ways
from spokewise.sources import osm_pbf
from spokewise.sources.osm_pbf import OsmPbf


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def packed(values):
    return b"".join(map(varint, values))


def steps(values):
    return packed(zigzag(b - a) for a, b in zip([0, *values], values))


def blob(kind, body, deflate=True):
    data = field(2, len(body)) + field(3, zlib.compress(body)) if deflate else field(1, body)
    head = field(1, kind) + field(3, len(data))
    return struct.pack(">I", len(head)) + head + data


def test_extract(spark, tmp_path):
    texts = ["", "highway", "residential", "stop", "oneway", "yes"]
    table = field(1, b"".join(field(1, t.encode()) for t in texts))
    dense = field(1, steps([10, 11, 5])) + field(8, steps([302_700_000, 302_700_000, -302_700_000])) + field(9, steps([-977_400_000, -977_390_000, 977_380_000])) + field(10, packed([1, 3, 0, 0, 0]))
    plain = field(1, zigzag(12)) + field(8, zigzag(302_700_000)) + field(9, zigzag(-977_380_000))
    way = lambda i, refs, k=(), v=(): field(3, field(1, i) + field(2, packed(k)) + field(3, packed(v)) + field(8, steps(refs)))
    nodes = table + field(2, field(2, dense)) + field(2, field(1, plain))
    lines = table + field(2, way(1, [10, 11, 12], [1], [2]) + way(2, [12, 10], [1, 4], [2, 5]) + way(3, [11], [1], [2])) + field(17, 100)
    path = tmp_path / "small.osm.pbf"
    path.write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", nodes) + blob(b"OSMData", lines, deflate=False))
    spark.dataSource.register(OsmPbf)
    read = lambda what: spark.read.format("osm_pbf").option("what", what).option("partitionBytes", 10).load(str(path))
    got = {r.osm_node_id: (round(r.lat, 7), round(r.lon, 7), r.tags) for r in read("nodes").collect()}
    assert got == {10: (30.27, -97.74, {"highway": "stop"}), 11: (30.27, -97.739, {}), 5: (-30.27, 97.738, {}), 12: (30.27, -97.738, {})}
    assert read("ways").rdd.getNumPartitions() == 2
    w = read("ways")
    assert sorted((r.way_id, r.nodes, r.tags) for r in w.collect()) == [(1, [10, 11, 12], {"highway": "residential"}), (2, [12, 10], {"highway": "residential", "oneway": "yes"}), (3, [11], {"highway": "residential"})]
    nodes_, edges, _ = ways.build_graph(w, read("nodes"))
    assert nodes_.count() == 2 and edges.count() == 3 and sorted(r.control for r in nodes_.collect()) == ["none", "stop"]


def written(path, lines):
    """An extract of ways, one blob for each list of tag maps."""
    blocks = []
    number = itertools.count(1)
    for tag_maps in lines:
        texts = ["", *sorted({t for m in tag_maps for kv in m.items() for t in kv})]
        at = {t: i for i, t in enumerate(texts)}
        body = field(1, b"".join(field(1, t.encode()) for t in texts))
        for m in tag_maps:
            way = field(1, next(number)) + field(2, packed(at[k] for k in m)) + field(3, packed(at[v] for v in m.values())) + field(8, steps([10, 11]))
            body += field(2, field(3, way))
        blocks.append(blob(b"OSMData", body))
    path.write_bytes(blob(b"OSMHeader", b"") + b"".join(blocks))


def tag_maps():
    """Every class with every bicycle value, and access and service values, in several spellings."""
    classes = [*P.ALLOWED_HIGHWAYS, *P.PERMISSION_HIGHWAYS, "motorway", "Residential", None]
    riders = [None, "", "YES", "no", "ferry", *P.BICYCLE_ALLOWED, *P.BICYCLE_BARRED]
    for highway, bicycle, access, service in itertools.product(classes, riders, (None, "private", "No", "yes"), (None, "driveway", "Alley", "PARKING_AISLE")):
        told = {"name": "x", "highway": highway, "bicycle": bicycle, "access": access, "service": service}
        yield {k: v for k, v in told.items() if v is not None}


def test_routable_is_pushed(spark, tmp_path):
    maps = list(tag_maps())
    path = tmp_path / "ways.osm.pbf"
    written(path, [maps[:7], [], maps[7:]])
    read = lambda: osm_pbf.read_extract(spark, f"file://{path}")
    assert read().count() == len(maps)
    assert read().where(F.col("routable") != T.routable(F.col("tags"))).isEmpty()
    kept = read().where("routable AND way_id % 2 = 0")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "way_id" in plan.split("Filter")[1].split("\n")[0] and "routable" not in plan.split("Filter")[1].split("(")[-1].split("\n")[0]
    want = {i for i, ok in enumerate(spark.createDataFrame([(m,) for m in maps], "tags map<string,string>").select(T.routable(F.col("tags"))).collect(), 1) if ok[0]}
    assert {r.way_id for r in kept.collect()} == {i for i in want if i % 2 == 0}
    assert {r.way_id for r in read().where("NOT routable").collect()} == set(range(1, len(maps) + 1)) - want
    assert read().where("routable AND NOT routable").isEmpty() and osm_pbf.rideable_ways(spark, str(path)).columns == ["way_id", "tags", "nodes"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert {r.way_id for r in osm_pbf.rideable_ways(spark, str(path)).collect()} == want
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_unwanted_ways_get_no_map(monkeypatch):
    body = field(1, b"".join(field(1, t) for t in (b"", b"highway", b"motorway"))) + field(2, field(3, field(1, 1) + field(2, packed([1])) + field(3, packed([2])) + field(8, steps([1, 2]))))
    monkeypatch.setattr(osm_pbf, "running", lambda data: 1 / 0)  # nodes are listed with the map
    assert list(osm_pbf.decoded(body, "ways", True)) == []


def test_paths_with_a_scheme(tmp_path):
    path = tmp_path / "ways.osm.pbf"
    written(path, [[{"highway": "path"}], [{"highway": "track"}]])
    whole = list(osm_pbf.blob_places(str(path)))
    assert len(whole) == 2 and whole == list(osm_pbf.blob_places(f"file://{path}")) == list(osm_pbf.blob_places(f"file:{path}"))
    reader = osm_pbf.PbfReader(f"file://{path}", "ways", 10)
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == [{"highway": "path"}, {"highway": "track"}]
