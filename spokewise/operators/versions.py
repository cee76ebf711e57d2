"""Tables that are read while they change: numbered versions, each told by one small file.

A version's file names the Parquet folders of all its tables. It is made at once and only if its number is free, so
of several publishers that saw the same version one wins, and readers meet all the tables of one version. A table
with a key lies in buckets; an update by key writes the buckets with a changed row anew and shares the others with
the version before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import create_once, drop, listed, remove, stash
from .updates import changed_rows, updated

BUCKETS = 64


class Conflict(RuntimeError):
    """Another publisher took the version's number; what was written for it is gone. Read anew and try again."""


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions that can be read, oldest first."""
    return sorted(int(f[8:-5]) for f in listed(spark, folder) if f.startswith("version-") and f.endswith(".json"))


def current(spark: SparkSession, folder: str) -> int:
    """The number of the latest version; 0 before the first."""
    return max(versions(spark, folder), default=0)


def _file(folder: str, version: int) -> str:
    return f"{folder}/version-{version:09d}.json"


def _tables(spark: SparkSession, folder: str, version: int) -> dict[str, dict]:
    return json.loads(spark.read.text(_file(folder, version), wholetext=True).first()[0])


def _claim(spark: SparkSession, folder: str, version: int, tables: dict[str, dict], data: str) -> int:
    if not create_once(spark, _file(folder, version), json.dumps(tables)):
        remove(spark, f"{folder}/{data}")
        raise Conflict(f"version {version} of {folder} was published meanwhile")
    return version


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, folder: str, place: str, key: str | None, buckets: int) -> dict[str, str]:
    """Paths below ``folder`` by number of bucket; a table without a key has one."""
    if key is None:
        df.write.parquet(f"{folder}/{place}")
        return {"0": place}
    df.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").sortWithinPartitions("_bucket", key).write.partitionBy("_bucket").parquet(f"{folder}/{place}")
    return {f[8:]: f"{place}/{f}" for f in listed(df.sparkSession, f"{folder}/{place}") if f.startswith("_bucket=")}


def publish_together(tables: dict[str, DataFrame], folder: str, keys: dict[str, str] | None = None, after: int | None = None, buckets: int = BUCKETS) -> int:
    """Writes tables as the version after ``after`` (the latest, if it isn't given) and returns its number.

    ``keys`` names the key of each table that is to be updated by it. Raises :class:`Conflict` if another publisher
    was first. A job that fails half-way changes nothing for readers.
    """
    spark, data = next(iter(tables.values())).sparkSession, f"data-{uuid.uuid4().hex[:12]}"
    before = current(spark, folder) if after is None else after
    told = {}
    for name, df in tables.items():
        key = (keys or {}).get(name)
        told[name] = {"schema": df.schema.json(), "key": key, "buckets": buckets, "paths": _write(df, folder, f"{data}/{name}", key, buckets)}
    return _claim(spark, folder, before + 1, told, data)


def _read(spark: SparkSession, folder: str, table: dict, only: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(table["schema"]))
    paths = [f"{folder}/{p}" for b, p in table["paths"].items() if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_published(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the latest version, or of a given one."""
    return _read(spark, folder, _tables(spark, folder, version or current(spark, folder))[name])


def update_published(spark: SparkSession, folder: str, name: str, new: DataFrame, value: str, after: int | None = None) -> int:
    """Sets ``value`` of the rows whose key ``new`` has, as a new version; returns how many rows it changed.

    Nulls count as values; with several rows of a key in ``new`` one must not differ from another. Only buckets of
    keys in ``new`` are read, and only those with a changed row written. With no changed row there is no new version.
    """
    before = after or current(spark, folder)
    tables = _tables(spark, folder, before)
    table = tables[name]
    key, buckets, data = table["key"], table["buckets"], f"data-{uuid.uuid4().hex[:12]}"
    if key is None:
        raise ValueError(f"{name} was published without a key")
    types = StructType.fromJson(json.loads(table["schema"]))
    new = stash(new.select(*(F.col(c).cast(types[c].dataType) for c in (key, value))).distinct().withColumn("_bucket", _bucket(key, buckets)), "update")
    met = {str(r[0]) for r in new.select("_bucket").distinct().collect()}  # at most as many as buckets
    changed = stash(changed_rows(_read(spark, folder, table, met), new, key, value).withColumn("_bucket", _bucket(key, buckets)), "changed")
    count = changed.groupBy("_bucket").count().collect()
    if count:
        touched = {str(r[0]) for r in count}
        rows = updated(_read(spark, folder, table, touched), changed, key, value)
        tables[name] = table | {"paths": table["paths"] | _write(rows, folder, f"{data}/{name}", key, buckets)}
        _claim(spark, folder, before + 1, tables, data)
    drop(new, changed)
    return sum(r[1] for r in count)


@contextmanager
def pinned(spark: SparkSession, folder: str, version: int | None = None) -> Iterator[int]:
    """A version that :func:`clean` leaves alone meanwhile: the latest, or a given one."""
    while True:
        n = version or current(spark, folder)
        pin = f"{folder}/pins/{n}-{uuid.uuid4().hex}"
        create_once(spark, pin, "")
        if n in versions(spark, folder):  # cleaning takes the version's file first and looks for pins then
            break
        remove(spark, pin)
        if version:
            raise ValueError(f"version {version} of {folder} is gone")
    try:
        yield n
    finally:
        remove(spark, pin)


def clean(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Removes versions but for the latest ``keep`` and pinned ones, with the data that no other version shares.

    Returns the numbers of those removed. Data that is being written for a version to come isn't touched, as it
    belongs to no version; a reader who died leaves its pin, a small file in ``pins``.
    """
    gone = {}
    for n in versions(spark, folder)[: -max(1, keep)]:
        if n in _pins(spark, folder):
            continue
        told = _tables(spark, folder, n)
        remove(spark, _file(folder, n))
        if n in _pins(spark, folder):  # pinned just before: it stays as it was
            create_once(spark, _file(folder, n), json.dumps(told))
        else:
            gone[n] = told
    paths = lambda told: {p for t in told.values() for p in t["paths"].values()}
    live = set().union(*(paths(_tables(spark, folder, n)) for n in versions(spark, folder)))
    dead = set().union(*map(paths, gone.values())) - live
    remove(spark, *(f"{folder}/{p}" for p in dead))
    return sorted(gone)


def _pins(spark: SparkSession, folder: str) -> set[int]:
    return {int(p.split("-")[0]) for p in listed(spark, f"{folder}/pins") if not p.endswith(".tmp")}
