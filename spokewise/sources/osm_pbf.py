"""Map extracts in the PBF format as a Spark data source.

    ways = read_extract(spark, "hdfs://host/data/extract.osm.pbf", "ways").where("routable")

The headers of the blobs are read once, when the query is planned; each partition is a run of whole blobs, which an
executor reads and decodes by itself. A path without a scheme must be one that all executors can open; others go
through Arrow's file systems (``file``, ``hdfs``, ``s3``, ``gs`` and so on). ``what``: ``ways`` gives ``way_id, tags,
nodes, routable``, ``nodes`` gives ``osm_node_id, lat, lon, tags``. A filter on ``routable`` reaches the decoder, which
decides it on the numbers of a way's keys and values, before it makes the map of tags or lists the nodes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, InputPartition

from .. import params as P
from .tables import MAP_NODES, WAYS

#: Bytes of blobs in one partition.
PARTITION_BYTES = 32 << 20


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message; fixed-size values are passed over."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
            yield key >> 3, value
        elif kind == 2:
            n, at = varint(data, at)
            yield key >> 3, data[at : at + n]
            at += n
        else:
            at += {1: 8, 5: 4}[kind]


def numbers(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def running(data: bytes) -> list[int]:
    """Sums of signed differences."""
    total, out = 0, []
    for n in numbers(data):
        total += signed(n)
        out.append(total)
    return out


def opened_file(path: str):
    """A file to read and seek in, on this machine or, for a path with a scheme, on another file system."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    system, own = fs.FileSystem.from_uri(path)
    return system.open_input_file(own)


def blob_places(path: str) -> Iterator[tuple[int, int]]:
    """Start and size of each data blob."""
    with opened_file(path) as f:
        at = 0
        while head := f.read(4):
            size = struct.unpack(">I", head)[0]
            header = dict(fields(f.read(size)))
            at += 4 + size
            if header[1] == b"OSMData":
                yield at, header[3]
            at += header[3]
            f.seek(at)


class Riding:
    """:func:`spokewise.functions.tags.routable` over the numbers of one block's texts."""

    def __init__(self, texts: list[str]):
        numbered = lambda *found: {i for i, t in enumerate(texts) if t in found}
        lowered = lambda *found: {i for i, t in enumerate(texts) if t.lower() in found}
        self.keys = {i: texts[i] for i in numbered("highway", "bicycle", "access", "service")}
        self.allowed, self.barred = lowered(*P.BICYCLE_ALLOWED), lowered(*P.BICYCLE_BARRED)
        self.closed, self.excluded = lowered("no", "private"), lowered(*P.EXCLUDED_SERVICE)
        self.by_leave, self.open, self.service = numbered(*P.PERMISSION_HIGHWAYS), numbered(*P.ALLOWED_HIGHWAYS), numbered("service")

    def __call__(self, keys: list[int], values: list[int]) -> bool:
        told = {self.keys[k]: v for k, v in zip(keys, values) if k in self.keys}
        highway, bicycle = told.get("highway"), told.get("bicycle")
        allowed = bicycle in self.allowed
        if highway not in self.open and not (highway in self.by_leave and allowed):
            return False
        if bicycle in self.barred or (told.get("access") in self.closed and not allowed):
            return False
        return not (highway in self.service and told.get("service") in self.excluded)


def opened(blob: bytes) -> bytes:
    for number, value in fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
    raise ValueError("a blob is packed in a way that isn't known here")


def decoded(block: bytes, what: str, only: bool | None = None) -> Iterator[tuple]:
    """The rows of a block; ``only`` keeps ways that are, or aren't, routable."""
    groups, texts, step, lat0, lon0 = [], [], 100, 0, 0
    for number, value in fields(block):
        if number == 1:
            texts = [t.decode("utf-8", "replace") for n, t in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            step = value
        elif number == 19:
            lat0 = value if value < 1 << 63 else value - (1 << 64)
        elif number == 20:
            lon0 = value if value < 1 << 63 else value - (1 << 64)
    place = lambda n, base: 1e-9 * (base + step * n)
    tagged = lambda keys, values: {texts[k]: texts[v] for k, v in zip(keys, values)}
    riding = Riding(texts) if what == "ways" else None
    for group in groups:
        for number, value in fields(group):
            if what == "ways" and number == 3:
                m = dict(fields(value))
                keys, values = numbers(m.get(2, b"")), numbers(m.get(3, b""))
                ridden = riding(keys, values)
                if only is None or ridden == only:
                    yield m[1], tagged(keys, values), running(m.get(8, b"")), ridden
            elif what == "nodes" and number == 1:
                m = dict(fields(value))
                yield signed(m[1]), place(signed(m[8]), lat0), place(signed(m[9]), lon0), tagged(numbers(m.get(2, b"")), numbers(m.get(3, b"")))
            elif what == "nodes" and number == 2:
                m = dict(fields(value))
                marks = iter(numbers(m.get(10, b"")))
                for i, a, b in zip(running(m[1]), running(m[8]), running(m[9])):
                    tags = {}
                    while k := next(marks, 0):
                        tags[texts[k]] = texts[next(marks)]
                    yield i, place(a, lat0), place(b, lon0), tags


class Blobs(InputPartition):
    def __init__(self, places: list[tuple[int, int]]):
        self.places = places


class PbfReader(DataSourceReader):
    def __init__(self, path: str, what: str, most: int):
        self.path, self.what, self.most = path, what, most
        self.only: bool | None = None

    def partitions(self) -> list[Blobs]:
        out: list[Blobs] = []
        held = 0
        for start, size in blob_places(self.path):
            if not out or held + size > self.most:
                out.append(Blobs([]))
                held = 0
            out[-1].places.append((start, size))
            held += size
        return out or [Blobs([])]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        with opened_file(self.path) as f:
            for start, size in partition.places:
                f.seek(start)
                yield from decoded(opened(f.read(size)), self.what, self.only)


class FilteringReader(PbfReader):
    """Takes a filter on ``routable`` over from Spark, which must have ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.what == "ways" and isinstance(f, EqualTo | EqualNullSafe) and f.attribute == ("routable",) and isinstance(f.value, bool) and self.only in (None, f.value):
                self.only = f.value
            else:
                yield f


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return f"{WAYS}, routable boolean" if self.options.get("what", "ways") == "ways" else MAP_NODES

    def reader(self, schema) -> PbfReader:
        kind = FilteringReader if self.options.get("filters") == "pushed" else PbfReader
        return kind(self.options["path"], self.options.get("what", "ways"), int(self.options.get("partitionbytes", PARTITION_BYTES)))


def read_extract(spark: SparkSession, path: str, what: str = "ways", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """An extract's ``ways`` or ``nodes``; filters are pushed down where the session lets Python sources have them."""
    spark.dataSource.register(OsmPbf)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    return spark.read.format("osm_pbf").option("what", what).option("filters", "pushed" if pushed else "spark").option("partitionBytes", partition_bytes).load(path)


def rideable_ways(spark: SparkSession, path: str) -> DataFrame:
    """``way_id, tags, nodes`` of the ways that cyclists may ride, of two nodes at least."""
    return read_extract(spark, path, "ways").where("routable AND size(nodes) >= 2").drop("routable")
