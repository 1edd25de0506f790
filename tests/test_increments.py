import pytest
from pyspark.sql import functions as F

from recall_engine.operators import increments as I
from recall_engine.plans.tables import new_folder
from recall_engine.plans.versions import Versions

ROWS = """SELECT * FROM VALUES
 (1L, '/a/e\u0301', 1L, 1D, false, TIMESTAMP_NTZ'2024-01-01 00:00', TIMESTAMP_NTZ'2024-01-01 00:01'),
 (2L, '/a/b', 1L, 1D, true, TIMESTAMP_NTZ'2024-01-01 00:00', TIMESTAMP_NTZ'2024-01-01 00:01'),
 (2L, '/a/b', 1L, 1D, true, TIMESTAMP_NTZ'2024-01-01 00:00', TIMESTAMP_NTZ'2024-01-02 00:01'),
 (3L, '/a/c', NULL, 1D, false, TIMESTAMP_NTZ'2024-01-01 00:00', TIMESTAMP_NTZ'2024-01-01 00:01'),
 (4L, '/a/é', 2L, 1D, false, TIMESTAMP_NTZ'2024-01-02 00:00', TIMESTAMP_NTZ'2024-01-02 00:01'),
 (5L, '/a/b', 1L, 1D, false, TIMESTAMP_NTZ'2024-01-03 00:00', TIMESTAMP_NTZ'2024-01-03 00:01'),
 (6L, '/a/late', 1L, 1D, false, TIMESTAMP_NTZ'2024-01-01 00:00', TIMESTAMP_NTZ'2024-01-03 00:01'),
 (7L, '/a/b', 9L, 9D, false, TIMESTAMP_NTZ'2024-01-01 12:00', TIMESTAMP_NTZ'2024-01-03 00:01'),
 (8L, CAST(NULL AS STRING), 1L, 1D, CAST(NULL AS BOOLEAN), TIMESTAMP_NTZ'2024-01-01 00:00', TIMESTAMP_NTZ'2024-01-01 00:01')
 AS t(entry_id, path, size, mtime, dataless, observed, arrived)"""
RUNS = """SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'2024-01-01 01:00', 'ok'), (2L, TIMESTAMP_NTZ'2024-01-02 01:00', 'failed'), (3L, TIMESTAMP_NTZ'2024-01-03 01:00', 'ok'), (4L, TIMESTAMP_NTZ'2024-01-04 01:00', 'ok'), (5L, CAST(NULL AS TIMESTAMP_NTZ), 'ok')
 AS t(run_id, started, status)"""
STARTS = {1: "2024-01-01 01:00:00", 2: "2024-01-02 01:00:00", 3: "2024-01-03 01:00:00", 4: "2024-01-04 01:00:00"}
EXPECTED = [(1, "/a/b"), (1, "/a/é"), (3, "/a/b"), (3, "/a/late"), (3, "/a/é")]


def cases(df):
    return sorted(map(tuple, df.collect()))


def test_runs(spark):
    # b is a placeholder no more; its row seen late is older; the composed path has a new size
    assert cases(I.replay(spark.sql(ROWS).withColumn("k1", F.lit("extra")).withColumn("slot", F.lit(9)), spark.sql(RUNS))) == EXPECTED


def test_a_repeated_run_counts_once(spark):
    again = spark.sql(RUNS).unionByName(spark.sql("SELECT 3L AS run_id, TIMESTAMP_NTZ'2024-01-03 00:00:30' AS started, 'ok' AS status"))
    got = cases(I.replay(spark.sql(ROWS), again))
    assert [p for r, p in got if r == 4] == ["/a/b", "/a/late"] and [p for r, p in got if r == 3] == ["/a/é"]


def test_a_failure_before_the_commit_loses_and_repeats_nothing(spark):
    rows = I.usable(spark.sql(ROWS))
    store = I.StateStore(spark, new_folder(spark, "store"))
    assert I.process(rows, store, 1, STARTS[1]).count() == 2
    assert I.process(rows, store, 2, STARTS[2], succeeds=False) is None
    assert store.current()["run_id"] == 1
    got = {r.path for r in I.process(rows, store, 3, STARTS[3]).collect()}
    assert got == {"/a/b", "/a/late", "/a/é"}
    assert I.process(rows, store, 4, STARTS[4]).count() == 0
    assert store.state().count() == 3


class Killed(RuntimeError):
    pass


@pytest.mark.parametrize("at", ["before the write", "between write and rename", "after the rename"])
def test_a_killed_run_is_repeated(spark, monkeypatch, at):
    rows = I.usable(spark.sql(ROWS))
    folder = new_folder(spark, "killed")
    out = []
    for run in (1, 3, 4):
        with monkeypatch.context() as m:
            if at == "before the write":
                m.setattr(Versions, "data_folder", lambda *_: (_ for _ in ()).throw(Killed()))
            elif at == "between write and rename":
                m.setattr(Versions, "publish", lambda *_, **__: (_ for _ in ()).throw(Killed()))
            else:
                m.setattr(Versions, "drop_abandoned", lambda *_: (_ for _ in ()).throw(Killed()))
            with pytest.raises(Killed):
                I.process(rows, I.StateStore(spark, folder), run, STARTS[run])
        for _ in range(2):  # the second repetition comes after a commit
            got = cases(I.process(rows, I.StateStore(spark, folder), run, STARTS[run]))
        out += got
    assert sorted(out) == EXPECTED
    store = I.StateStore(spark, folder)
    assert store.state().count() == 3 and store.current()["number"] == 2
    assert [len(cases(store.cases(r))) for r in (1, 3, 4)] == [2, 3, 0]


def test_a_repetition_with_other_rows_changes_nothing(spark):
    rows = I.usable(spark.sql(ROWS))
    store = I.StateStore(spark, new_folder(spark, "repeated"))
    first = cases(I.process(rows, store, 1, STARTS[1]))
    assert cases(I.process(rows, store, 1, STARTS[3])) == first and store.state().count() == 2


def test_one_number_is_published_once(spark):
    folder = new_folder(spark, "numbers")
    versions = Versions(spark, folder)
    assert versions.current() is None and versions.numbers() == []
    assert versions.publish(0, f"{folder}/data-a", who=1) and not versions.publish(0, f"{folder}/data-b", who=2)
    assert versions.current()["who"] == 1 and versions.numbers() == [0]


def test_paths_are_composed(spark):
    rows = spark.createDataFrame([("é",), ("a",), (None,), ("",)], "p string")
    assert [r[0] for r in rows.select(I.nfc("p")).collect()] == ["é", "a", None, ""]


def test_empty(spark):
    assert I.replay(spark.sql(ROWS).limit(0), spark.sql(RUNS)).count() == 0
    assert I.replay(spark.sql(ROWS), spark.sql(RUNS).limit(0)).count() == 0
