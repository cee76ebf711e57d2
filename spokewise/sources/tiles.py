"""Elevation tiles from PNG files in the terrarium encoding."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import TILE_SIZE

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def png_pixels(data: bytes) -> np.ndarray | None:
    """Rows, columns and channels of an 8-bit PNG without interlacing or palette; null for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        return None
    width, height, step = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    except zlib.error:
        return None
    if len(raw) != height * (width * step + 1):
        return None
    raw = raw.reshape(height, -1)
    out = np.zeros((height, width * step), dtype=np.int64)
    above = np.zeros(width * step, dtype=np.int64)
    for y in range(height):
        line, how = raw[y, 1:].astype(np.int64), int(raw[y, 0])
        if how == 1:
            line = (np.cumsum(line.reshape(width, step), axis=0) & 255).ravel()
        elif how == 2:
            line = (line + above) & 255
        elif how in (3, 4):
            for x in range(len(line)):
                a = int(line[x - step]) if x >= step else 0
                b = int(above[x])
                if how == 3:
                    guess = (a + b) // 2
                else:
                    c = int(above[x - step]) if x >= step else 0
                    near = a + b - c
                    pa_, pb, pc = abs(near - a), abs(near - b), abs(near - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                line[x] = (int(line[x]) + guess) & 255
        elif how:
            return None
        out[y] = above = line
    return out.reshape(height, width, step)


def terrarium(data: bytes) -> np.ndarray | None:
    """Heights in metres of a 256 x 256 tile, row by row; null if it is no such tile."""
    pixels = png_pixels(data)
    if pixels is None or pixels.shape[:2] != (TILE_SIZE, TILE_SIZE) or pixels.shape[2] < 3:
        return None
    r, g, b = (pixels[:, :, k].astype(np.float32) for k in range(3))
    return (r * 256 + g + b / 256 - 32768).ravel()


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, heights`` of files ``.../x/y.png`` or ``x_y.png`` or ``x-y.png``; bad tiles have null heights."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    place = lambda i: F.regexp_extract("path", r"(\d+)[/_-](\d+)\.png$", i).try_cast("int")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heights = [terrarium(x) for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(heights, pa.list_(pa.float32()))], ["x", "y", "heights"])

    return files.select(place(1).alias("x"), place(2).alias("y"), "content").where("x IS NOT NULL").mapInArrow(decode, "x int, y int, heights array<float>")
