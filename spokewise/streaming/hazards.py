"""The live overlay: a stream of reports and confirmations kept as differences, read as hazard scores of any time.

The stream holds the life of each open hazard as state, with a timer at the time when it runs out. What changes is
written batch by batch: ``hazards`` gets a row whenever a hazard is reported, confirmed or runs out, and ``reach`` the
edges near each new one, which never change after. A batch thus costs what it brings, and no event is read twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from .. import params as P
from ..operators.pressure import fold_reports, hazard_pressure, met_pressure
from ..operators.spatial import radius_join
from ..storage import listed, remove

EVENT = "event_id long, kind_of string, hazard_id long, lat double, lon double, kind string, notes string, at timestamp"
CHANGE = "hazard_id long, lat double, lon double, kind string, notes string, confirmations int, created long, expires long, is_new boolean, gone boolean"
REACH = "hazard_id long, edge_id long, distance_m double"
DAY = 86_400

_Change = Row(*(c.split()[0] for c in CHANGE.split(", ")))


def folded(events: DataFrame) -> DataFrame:
    """Hazards from an event table: rows ``kind_of`` = ``report`` and ``confirm``; repeated events count once."""
    one = events.dropDuplicates(["event_id"])
    reports = one.where("kind_of = 'report'").select("hazard_id", "lat", "lon", "kind", "notes", F.col("at").alias("created_at"))
    confirms = one.where("kind_of = 'confirm'").select("hazard_id", F.col("at").alias("confirmed_at"))
    return fold_reports(reports, confirms)


def overlay(events: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """``edge_id, total, hazard_score`` of all events so far, at a time."""
    return hazard_pressure(folded(events), edges, as_of)


class Life(StatefulProcessor):
    """One hazard from its report until it runs out; rows :data:`CHANGE`.

    Confirmations wait until the watermark has passed them, as an earlier one may still come; then they are folded
    into two numbers, so the state doesn't grow with them. Those of a hazard without a report go with the watermark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.report = handle.getValueState("report", "lat double, lon double, kind string, notes string, created long")
        self.fold = handle.getValueState("fold", "n int, until long")
        self.waiting = handle.getValueState("waiting", "times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        hazard_id = key[0]
        if hazard_id is None:
            return  # a tick: it only moves the time on
        report, is_new = self.report.get(), False
        times = list(self.waiting.get()[0]) if self.waiting.exists() else []
        for r in rows:
            if r.kind_of == "confirm":
                times.append(r.t)
            elif r.kind_of == "report" and report is None:
                report, is_new = (r.lat, r.lon, r.kind, r.notes or None, r.t), True
                self.report.update(report)
                self.fold.update((0, r.t + P.HAZARD_DAYS * DAY))
        times.sort()
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        if report is None:
            end = times[-1] if times else None
        else:
            n, end = self.fold.get()
            for i, t in enumerate(times):
                if t >= passed and (i == 0 or times[i - 1] < passed):
                    self.fold.update((n, end))
                if t < end:
                    n, end = n + 1, end + P.CONFIRM_DAYS * DAY
            if times and times[-1] < passed:
                self.fold.update((n, end))
            times = [t for t in times if t >= passed]
            yield _Change(hazard_id, *report[:4], n, report[4], end, is_new, False)
        self.waiting.update((times,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if end is not None:
            self.handle.registerTimer(end * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.report.exists():
            lat, lon, kind, notes, created = self.report.get()
            yield _Change(key[0], lat, lon, kind, notes, None, created, expiredTimerInfo.getExpiryTimeInMs() // 1000, False, True)
        self.report.clear()
        self.fold.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


def changes(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The changes of hazards (:data:`CHANGE`) that a stream of events brings about, those by time included.

    Events may come ``late`` by that much, and repeated within it; older ones are left out. Time is that of the
    events: with none at all nothing runs out, so a source that can fall silent sends rows of kind ``tick``, with no
    hazard. A hazard has one report. Needs Spark's RocksDB state store.
    """
    timed = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    keyed = timed.withColumn("t", F.unix_seconds("at")).groupBy("hazard_id")
    return keyed.transformWithState(Life(), CHANGE, "Append", "EventTime")


def run_overlay(stream: DataFrame, edges: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> DataStreamWriter:
    """A stream that adds to the overlay at ``path``; a batch that runs again replaces its own rows.

    Versions are numbers of batches. Readers pin one by naming it (:func:`overlay_at`).
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/hazards/batch={n}")
        new = spark.read.schema(CHANGE).parquet(f"{path}/hazards/batch={n}").where("is_new")
        radius_join(new, edges, P.HAZARD_RADIUS_M, point_id="hazard_id").write.mode("overwrite").parquet(f"{path}/reach/batch={n}")

    return changes(stream, late).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def keep_events(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream that keeps every event as it came, as history beside the overlay."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def _bases(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were merged into one with all before; the merge's last file is its mark."""
    return [int(f.removeprefix("base=")) for f in listed(spark, path) if f.startswith("base=") and "_SUCCESS" in listed(spark, f"{path}/{f}/reach")]


def _parts(spark: SparkSession, path: str, name: str, schema: str, version: int | None) -> DataFrame:
    base = max((b for b in _bases(spark, path) if version is None or b <= version), default=-1)
    found = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{name}").where(F.col("batch") > base)
    found = found if version is None else found.where(F.col("batch") <= version)
    return found.unionByName(spark.read.schema(schema).parquet(f"{path}/base={base}/{name}").withColumn("batch", F.lit(base).cast("long"))) if base >= 0 else found


def hazards_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The hazards that hadn't run out by a version's watermark, as :func:`folded` gives them."""
    order = F.struct("batch", "gone", "confirmations", "expires")
    last = _parts(spark, path, "hazards", CHANGE, version).groupBy("hazard_id").agg(F.max_by(F.struct("lat", "lon", "kind", "notes", "confirmations", "created", "expires", "gone"), order).alias("h")).select("hazard_id", "h.*")
    return last.where(~F.col("gone")).select("hazard_id", "lat", "lon", "kind", "notes", "confirmations", F.timestamp_seconds("created").alias("created_at"), F.timestamp_seconds("expires").alias("expires_at"))


def overlay_at(spark: SparkSession, path: str, as_of: Column, version: int | None = None) -> DataFrame:
    """``edge_id, total, hazard_score`` at a time, of the latest or a given version, whatever is written meanwhile."""
    open_now = hazards_at(spark, path, version).where(F.col("expires_at") > as_of)
    return met_pressure(open_now, _parts(spark, path, "reach", REACH, version).drop("batch"), as_of)


def compact(spark: SparkSession, path: str, version: int, clear: bool = False) -> None:
    """Merges all batches up to ``version``, without hazards that have run out; the stream may go on meanwhile.

    ``clear`` removes what was merged: versions before this one can't be read any more.
    """
    order = F.struct("batch", "gone", "confirmations", "expires")
    last = _parts(spark, path, "hazards", CHANGE, version).groupBy("hazard_id").agg(F.max_by(F.struct(*(c.split()[0] for c in CHANGE.split(", ")[1:])), order).alias("h")).select("hazard_id", "h.*").where("NOT gone")
    last.write.mode("overwrite").parquet(f"{path}/base={version}/hazards")
    live = spark.read.schema(CHANGE).parquet(f"{path}/base={version}/hazards").select("hazard_id")
    _parts(spark, path, "reach", REACH, version).drop("batch").join(live, "hazard_id", "left_semi").write.mode("overwrite").parquet(f"{path}/base={version}/reach")
    if clear:
        remove(spark, *(f"{path}/base={b}" for b in _bases(spark, path) if b < version))
        for name in ("hazards", "reach"):
            remove(spark, *(f"{path}/{name}/{f}" for f in listed(spark, f"{path}/{name}") if f.startswith("batch=") and int(f[6:]) < version))
