"""File events and clicks as streams.

Events are gathered until a root has been quiet for two seconds, their paths made distinct and applied to the state of
the catalogue in a micro-batch. Watermarks for late events are an extension of what a single machine needs.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recall_engine.plans.tables import new_folder
from recall_engine.plans.versions import Versions

#: Quiet time that ends a batch of events, and the age at which late ones are given up.
QUIET, LATE = "2 seconds", "10 minutes"
#: Seconds between two full scans that mend what lost events left, and pause before a failed stream is started again.
RECONCILE, PAUSE = 6 * 3600.0, 2.0
DAY = 86_400.0


def debounced(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """root, first, events, paths (distinct ones, without null) of each run of events of a root without a pause of quiet.

    Works on batches and streams, with the same numbers. A batch counts distinct paths through a second shuffle, so a
    root that never pauses gathers nothing in one task; a stream keeps 64-bit hashes of a run's paths in its state until
    the run ends, eight bytes for each.
    """
    rows = events.where("root is not null").withColumn("at", F.col("arrived").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", LATE)
        paths = F.size(F.collect_set(F.when(F.col("path").isNotNull(), F.xxhash64("path"))))
    else:
        paths = F.count_distinct("path")
    grouped = rows.groupBy("root", F.session_window("at", quiet)).agg(F.min("at").alias("first"), F.count("*").alias("events"), paths.cast("long").alias("paths"))
    return grouped.select("root", F.col("first").cast("timestamp_ntz").alias("first"), "events", "paths")


def distinct_paths(events: DataFrame) -> DataFrame:
    """root, path, entry_id of the last event of each path."""
    return events.where("root is not null").groupBy("root", "path").agg(F.max("entry_id").alias("entry_id"))


def apply_events(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State (path, observed, entry_id, size, mtime, dataless) after a batch of scan rows; the latest observation counts."""
    good = batch.where("path is not null and size is not null and mtime is not null").select("path", "observed", "entry_id", "size", "mtime", "dataless")
    pick = F.max(F.struct("observed", "entry_id", "size", "mtime", "dataless"))
    return state.unionByName(good).groupBy("path").agg(pick.alias("s")).select("path", "s.*")


_STATE = "path string, observed timestamp_ntz, entry_id long, size long, mtime double, dataless boolean"


class StateTable:
    """A table replaced as a whole by each micro-batch.

    Its version is found in the folder, so a restarted driver goes on where the last one stopped. A version tells the
    batch and the stream it came from: a batch that is repeated after its commit changes nothing. Two writers may meet;
    the one that comes second reads the new version and does its work again. One version is one write and one rename.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.schema = spark, schema
        self.versions = Versions(spark, folder)

    def _read(self, at: dict | None) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(at["data"]) if at else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.versions.current())

    def update(self, change: Callable[[DataFrame], DataFrame], batch: int = -1, stream: str = "") -> bool:
        """Put change(table) in place of the table; False if that batch of the stream is in it already."""
        while True:
            at = self.versions.current()
            done = dict(at["batches"]) if at else {}
            if batch >= 0 and done.get(stream, -1) >= batch:
                return False
            if batch >= 0:
                done[stream] = batch
            number = at["number"] + 1 if at else 0
            data = self.versions.data_folder(number)
            try:
                change(self._read(at)).write.parquet(data)
            except Exception:
                if number in self.versions.numbers() or (self.versions.current() or {"number": -1})["number"] > number:
                    continue  # another writer went on meanwhile, and what was read may be gone
                raise
            if self.versions.publish(number, data, batches=done):
                # the version before may still be read
                self.versions.drop_abandoned(number - 1)
                self.versions.forget_before(number - 1)
                return True
            self.versions.drop(data)

    def write(self, df: DataFrame, batch: int = -1, stream: str = "") -> bool:
        return self.update(lambda _: df, batch, stream)


def stream_to_state(spark: SparkSession, path: str, state: StateTable | None = None, checkpoint: str | None = None) -> DataFrame:
    """Read a folder of scan rows as a stream, apply it to a state and return what it holds at the end.

    availableNow takes what is there in micro-batches and stops; called again with the same state and checkpoint it takes
    what is new. Without them it starts empty. A lasting watcher is Watcher.
    """
    schema = spark.read.parquet(path).schema
    table = state or StateTable(spark, new_folder(spark, "state"), _STATE)
    progress = checkpoint or new_folder(spark, "progress")
    folder, pattern = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 16)
    events = source.parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", pattern).parquet(folder)
    query = events.writeStream.foreachBatch(lambda df, i: table.update(lambda old: apply_events(old, df), i, progress)).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


EVENT = "event string, path string, target string, size long, mtime double, dataless boolean, at timestamp"
#: Kinds of file events that change nothing.
IGNORED = ("opened", "closed_no_write")


def file_events(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    """A stream of file events from JSON lines: created, modified, moved (to target), deleted. per_batch bounds a batch."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_batch).json(folder)
    return rows.where(~F.col("event").isin(*IGNORED) & F.col("path").isNotNull())


def apply_file_events(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State (path, size, mtime, dataless, at) after events, the last one of a path counting.

    A deleted or moved path takes everything below it along: paths are joined with the folders they lie in by equality.
    What was written under it after that moment stays.
    """
    gone = batch.where("event in ('deleted', 'moved')").groupBy(F.col("path").alias("gone")).agg(F.max("at").alias("gone_at"))
    written = batch.where("event in ('created', 'modified')").select("path", "size", "mtime", "dataless", "at")
    moved = batch.where("event = 'moved' and target is not null").select(F.col("target").alias("path"), "size", "mtime", "dataless", "at")
    newest = state.unionByName(written).unionByName(moved).groupBy("path").agg(F.max(F.struct("at", "size", "mtime", "dataless")).alias("s")).select("path", "s.size", "s.mtime", "s.dataless", "s.at")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    lost = newest.select("path", "at", F.explode(above).alias("gone")).join(gone, "gone").where(F.col("at") <= F.col("gone_at")).select("path").distinct()
    return newest.join(lost, "path", "left_anti")


def watch_files(spark: SparkSession, folder: str, state: StateTable, checkpoint: str, once: bool = True):
    """Keep a state table up to date with the events of a folder; once takes what is there, else every QUIET."""
    events = file_events(spark, folder)
    writer = events.writeStream.foreachBatch(lambda df, i: state.update(lambda old: apply_file_events(old, df), i, checkpoint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=QUIET)).start()


def reconcile(state: DataFrame, found: DataFrame, began: Column) -> DataFrame:
    """The state after a full scan found(path, size, mtime, dataless) that began at a moment.

    What the scan has counts, unless an event since then told something newer; a path it lacks is gone, unless an event
    since then wrote it.
    """
    seen = found.where("path is not null").select("path", "size", "mtime", F.coalesce("dataless", F.lit(False)).alias("dataless"), began.alias("at"))
    newer = state.where(F.col("at") > began)
    return seen.join(newer.select("path"), "path", "left_anti").unionByName(newer.select("path", "size", "mtime", "dataless", "at"))


class Watcher:
    """Events of a folder kept in a state table until it is stopped.

    A stream that fails is started again from its checkpoint after a pause. Every so many seconds a full scan (snapshot())
    is taken, beside the stream, and mends what lost events left. Its jobs run in a pool of their own, so that searches
    in another pool of a FAIR scheduler go first; a micro-batch takes a bounded number of files.
    """

    def __init__(self, spark: SparkSession, folder: str, state: StateTable, checkpoint: str, snapshot: Callable[[], DataFrame] | None = None, every: float = RECONCILE, pause: float = PAUSE, pool: str = "indexing"):
        self.spark, self.folder, self.state, self.checkpoint = spark, folder, state, checkpoint
        self.snapshot, self.every, self.pause, self.pool = snapshot, every, pause, pool
        self.restarts = self.reconciled = 0
        self._stop = threading.Event()
        self._query = None

    def stop(self) -> None:
        """End the stream after its micro-batch, and run()."""
        self._stop.set()
        if self._query is not None:
            self._query.stop()

    def mend(self) -> None:
        """One full scan now."""
        began = F.lit(time.time()).cast("timestamp")
        found = self.snapshot()
        self.state.update(lambda old: reconcile(old, found, began))
        self.reconciled += 1

    def run(self) -> None:
        """Watch until stop() is called, from this thread or another."""
        context = self.spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", self.pool)
        due = time.monotonic() + self.every
        try:
            while not self._stop.is_set():
                self._query = watch_files(self.spark, self.folder, self.state, self.checkpoint, once=False)
                try:
                    while not self._stop.is_set() and not self._query.awaitTermination(max(0.1, min(1.0, self.every))):
                        if self.snapshot is not None and time.monotonic() >= due:
                            self.mend()
                            due = time.monotonic() + self.every
                except StreamingQueryException:
                    self.restarts += 1
                    self._stop.wait(self.pause)
        finally:
            if self._query is not None:
                self._query.stop()
            context.setLocalProperty("spark.scheduler.pool", None)


def append_log(rows: DataFrame, path: str) -> None:
    """Add searches or clicks to their log."""
    rows.write.mode("append").parquet(path)


def log_sink(rows: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Add a stream of searches or clicks to their log; a batch that is repeated is in the log once."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=QUIET)).start()


#: The state of a stream of clicks: the use of a file (id, general), or a click that is counted (click); the other is null.
_CLICKS = "id long, general double, click long"


def stream_clicks(spark: SparkSession, path: str, now: float, state: StateTable | None = None, checkpoint: str | None = None) -> DataFrame:
    """id, general: use of files kept by a stream of clicks. The state holds each file's use as of the moment now, so a
    batch only adds its own decayed clicks; clicks are told apart by id, within a batch (the earliest row counts) and
    against those counted before. Use and counted clicks are one table, so a failure can't part them."""
    schema = spark.read.parquet(path).schema
    table = state or StateTable(spark, new_folder(spark, "use"), _CLICKS)
    progress = checkpoint or new_folder(spark, "progress")

    def add(old: DataFrame, batch: DataFrame) -> DataFrame:
        counted = old.where("click is not null")
        one = batch.where("id is not null").groupBy(F.col("id").alias("click")).agg(F.min(F.struct("ts", "file_id")).alias("x")).select("click", "x.ts", "x.file_id")
        rows = one.join(counted.select("click"), "click", "left_anti")
        at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
        fresh = rows.where(at > now - 365 * DAY).groupBy(F.col("file_id").alias("id")).agg(F.sum(0.3 * F.exp(-(F.lit(now) - at) / DAY / 30)).alias("general"))
        use = old.where("click is null").select("id", "general").unionByName(fresh).groupBy("id").agg(F.sum("general").alias("general"))
        none = F.lit(None)
        return use.withColumn("click", none.cast("long")).unionByName(counted.unionByName(rows.select(none.cast("long").alias("id"), none.cast("double").alias("general"), "click")))

    folder, pattern = path.rsplit("/", 1)
    source = spark.readStream.schema(schema)
    events = source.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", pattern).parquet(folder)
    query = events.writeStream.foreachBatch(lambda df, i: table.update(lambda old: add(old, df), i, progress)).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read().where("click is null").select("id", "general")
