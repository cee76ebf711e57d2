"""Tables written between steps, in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()
_table_of: dict[str, str] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a folder of its own; on a cluster that is an error, as
    no folder of one machine is seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage.

    The files outlive any executor, so a lost one costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark, []).append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def stash_bucketed(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """:func:`stash` as a table in ``parts`` buckets of ``key``, so that a join by it doesn't shuffle the table."""
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/{own}"
    _written.setdefault(spark, []).append(path)
    df.write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(own)
    _table_of[path] = own
    out = spark.table(own)
    _path_of[out] = path
    return out


def apart(df: DataFrame) -> DataFrame:
    """``df``, met in joins by a shuffle. Spark goes by the size of files, and letters, lists and repeated numbers take
    many times that in memory, so it would send what the driver can't hold."""
    return df.hint("merge")


def name_of(df: DataFrame) -> str:
    """The name under which a step was written, unlike any other's."""
    return _path_of[df].rsplit("/", 1)[-1]


def together(*steps: DataFrame) -> DataFrame:
    """Tables of one schema that :func:`stash` wrote, read as one."""
    return steps[0].sparkSession.read.schema(steps[0].schema).parquet(*(_path_of[s] for s in steps))


def is_stashed(df: DataFrame) -> bool:
    """Whether ``df`` is a table that :func:`stash` wrote."""
    return df in _path_of


def _remove(spark: SparkSession, paths: list[str]) -> int:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p in _table_of:
            spark.sql(f"DROP TABLE IF EXISTS {_table_of.pop(p)}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of any file system that Spark reads; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(path)) if system.exists(path) else []


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes files or folders of any file system that Spark writes."""
    _remove(spark, list(paths))


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole, if there is none of that name; whether it did.

    Of several writers at once one succeeds, and no reader meets half a file: the text goes to a name of its
    own first. Needs a file system whose rename is atomic and doesn't replace a file, as HDFS's, or a local one.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, own = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    out = system.create(own)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getScheme() != "file":
            return system.rename(own, target)
        os.link(own.toUri().getPath(), target.toUri().getPath())  # the local rename replaces what is there
        return True
    except FileExistsError:
        return False
    finally:
        system.delete(own, False)


def drop(*steps: DataFrame | None) -> None:
    """Removes steps that nothing reads any more, as a loop does with the round before."""
    for df in steps:
        path = _path_of.pop(df, None) if df is not None else None
        if path is not None:
            _written[df.sparkSession].remove(path)
            _remove(df.sparkSession, [path])


def mark(spark: SparkSession) -> int:
    """The number of tables that are kept for this session."""
    return len(_written.get(spark, []))


def names(spark: SparkSession) -> frozenset[str]:
    """The tables that are kept for this session, for :func:`discard`."""
    return frozenset(_written.get(spark, []))


def discard(spark: SparkSession, since: int | frozenset[str] = 0, keep: DataFrame | None = None) -> int:
    """Removes the tables written for this session after the first ``since``, or those not named in it, but for
    ``keep``; results that still read them must have been written.

    Names hold where earlier tables are dropped meanwhile, a number doesn't."""
    paths = _written.get(spark, [])
    before = since if isinstance(since, frozenset) else set(paths[:since])
    kept = _path_of.get(keep) if keep is not None else None
    gone = [p for p in paths if p not in before and p != kept]
    _written[spark] = [p for p in paths if p not in set(gone)]
    return _remove(spark, gone)
