import threading
import time

import pytest
from pyspark.sql import functions as F

from recall_engine.streaming import watch

EVENTS = "event string, path string, target string, size long, mtime double, dataless boolean, t long"
STATE = "path string, size long, mtime double, dataless boolean, at timestamp"


def event(kind, path, at, target=None):
    return (kind, path, target, 1, 1.0, False, at)


def write(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).select("*", F.timestamp_seconds("t").alias("at")).drop("t").coalesce(1).write.mode("append").json(folder)


def paths(state):
    return {r.path for r in state.read().collect()}


def test_debounce_is_the_same_streamed(spark, tiny, tmp_path):
    rows = spark.read.parquet(f"{tiny}/scan_entries.parquet").select("root", "path", "arrived")
    batch = watch.debounced(rows)
    assert batch.agg(F.sum("events")).first()[0] == rows.where("root is not null").count()
    # the last row closes the runs before it and stays open itself
    end = spark.sql("SELECT 'end' AS root, 'x' AS path, TIMESTAMP_NTZ'2100-01-01 00:00' AS arrived")
    rows.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.debounced(spark.readStream.schema("root string, path string, arrived timestamp_ntz").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.sql("select * from quiet").collect()))
    assert got and got == sorted(map(tuple, batch.collect()))


def test_a_restart_between_two_batches(spark, tmp_path):
    first = [event("created", "/a/x", 1), event("created", "/a/y", 1), event("created", "/ab", 1), event("opened", "/zz", 1)]
    second = [event("deleted", "/a", 5), event("modified", "/a/y", 6), event("moved", "/ab", 7, "/new"), event("deleted", "/nothing", 7)]
    for rows in (first, second):
        write(spark, str(tmp_path / "in"), rows)
        state = watch.StateTable(spark, str(tmp_path / "state"), STATE)  # as a new driver would
        watch.watch_files(spark, str(tmp_path / "in"), state, str(tmp_path / "progress")).awaitTermination()
    assert paths(watch.StateTable(spark, str(tmp_path / "state"), STATE)) == {"/a/y", "/new"}
    watch.append_log(state.read(), str(tmp_path / "log"))
    watch.append_log(state.read(), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_a_batch_counts_once_and_a_lost_progress_starts_anew(spark, tmp_path):
    table = lambda: watch.StateTable(spark, str(tmp_path / "s"), "n long")
    add = lambda old: old.unionByName(spark.range(1).toDF("n"))
    assert table().update(add, 0, "a") and not table().update(add, 0, "a") and table().update(add, 1, "a")
    assert table().update(add, 0, "b") and table().read().count() == 3
    assert len(list((tmp_path / "s").glob("data-*"))) == 2 and len(list((tmp_path / "s").glob("commit-*"))) == 2


def test_two_writers(spark, tmp_path):
    table = lambda: watch.StateTable(spark, str(tmp_path / "s"), "n long")
    calls = []

    def slow(old):
        if not calls:
            table().update(lambda o: o.unionByName(spark.range(1).toDF("n")), 7, "other")  # another one commits meanwhile
        calls.append(1)
        return old.unionByName(spark.range(1).toDF("n"))

    assert table().update(slow, 0, "mine") and len(calls) == 2 and table().read().count() == 2


def test_reconcile(spark):
    at = lambda t: F.timestamp_seconds(F.lit(t))
    state = spark.createDataFrame([("/kept", 1, 1.0, False, 10), ("/lost", 1, 1.0, False, 10), ("/late", 9, 9.0, False, 99)], "path string, size long, mtime double, dataless boolean, t long").select("path", "size", "mtime", "dataless", F.timestamp_seconds("t").alias("at"))
    found = spark.createDataFrame([("/kept", 2, 2.0, None), ("/missed", 1, 1.0, False), ("/late", 1, 1.0, False), (None, 1, 1.0, False)], "path string, size long, mtime double, dataless boolean")
    got = {r.path: r.size for r in watch.reconcile(state, found, at(50)).collect()}
    assert got == {"/kept": 2, "/missed": 1, "/late": 9}


@pytest.mark.parametrize("fails", [False, True])
def test_watcher(spark, tmp_path, monkeypatch, fails):
    write(spark, str(tmp_path / "in"), [event("created", "/a", 1)])
    state = watch.StateTable(spark, str(tmp_path / "state"), STATE)
    found = spark.createDataFrame([("/a", 1, 1.0, False), ("/missed", 1, 1.0, False)], "path string, size long, mtime double, dataless boolean")
    watcher = watch.Watcher(spark, str(tmp_path / "in"), state, str(tmp_path / "progress"), lambda: found, every=0.2, pause=0.1)
    if fails:
        real, broken = watch.apply_file_events, []

        def once(*x):
            if not broken:
                broken.append(1)
                raise ValueError("lost")
            return real(*x)

        monkeypatch.setattr(watch, "apply_file_events", once)
    thread = threading.Thread(target=watcher.run)
    thread.start()
    until = time.monotonic() + 90
    while time.monotonic() < until and (watcher.reconciled == 0 or "/a" not in paths(state) or watcher.restarts < fails):
        time.sleep(0.2)
    watcher.stop()
    thread.join(60)
    assert not thread.is_alive() and watcher.reconciled and watcher.restarts == fails
    assert paths(watch.StateTable(spark, str(tmp_path / "state"), STATE)) == {"/a", "/missed"}


def test_clicks_go_on_after_a_restart(spark, tiny, tmp_path):
    rows = spark.read.parquet(f"{tiny}/clicks.parquet")
    now = 1705536000.0
    for i, part in enumerate(rows.randomSplit([0.5, 0.5], 3)):
        part.unionByName(rows.limit(5)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        for f in (tmp_path / "in" / f"p{i}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
        got = watch.stream_clicks(spark, str(tmp_path / "in"), now, watch.StateTable(spark, str(tmp_path / "s"), watch._CLICKS), str(tmp_path / "c"))
    whole = watch.stream_clicks(spark, f"{tiny}/clicks.parquet", now)
    key = lambda df: sorted((r.id, round(r.general, 6)) for r in df.collect() if r.id is not None)
    assert key(got) == key(whole)


def test_a_log_takes_a_stream(spark, tiny, tmp_path):
    rows = spark.read.parquet(f"{tiny}/searches.parquet")
    for i in range(2):
        rows.limit(5 + i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        watch.log_sink(stream, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 11
