from pyspark.sql import functions as F

from recall_engine.operators import catalog as C, evaluate as E
from recall_engine.plans.links import expand
from recall_engine.plans.skew import join_totals
from recall_engine.sources.files import excluded

FILES = "id long, path string, size long, mtime double, dataless boolean"


def test_extension(spark):
    names = ["a.PDF", ".hidden", "a.", "noext", "x.tar.gz", "..a.b"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "name string").select(C.extension("name")).collect()]
    assert got == ["pdf", "", "", "", "gz", "b"]


def test_roots():
    assert C.distinct_roots(["/a/b/", "/a", "/c", "/a"]) == ["/a", "/c"]


def test_snapshot_diff(spark):
    files = spark.createDataFrame([(1, "/a/x", 1, 1.0, False), (2, "/a/y", 1, 1.0, True), (3, "/a/z", 1, 1.0, False), (4, "/a/g", 1, 1.0, False)], FILES)
    scan = spark.createDataFrame([("/a/x", 1, 1.0, False), ("/a/y", 1, 1.0, False), ("/a/z", 2, 1.0, False), ("/a/n", 1, 1.0, False)], "path string, size long, mtime double, dataless boolean")
    got = {r.path: r.change for r in C.snapshot_diff(scan, files).collect()}
    assert got == {"/a/x": "same", "/a/y": "changed", "/a/z": "changed", "/a/g": "gone", "/a/n": "new"}
    assert C.snapshot_diff(scan.limit(0), files.limit(0)).count() == 0


def test_missing_files_of_unmounted_roots_stay(spark):
    rows = spark.createDataFrame([("/a/x",), ("/b/x",), ("/c/x",), ("/ab/x",)], "path string")
    assert {r[0] for r in rows.where(C.deletable("path", ["/a", "/b"], ["/a"])).collect()} == {"/a/x", "/c/x", "/ab/x"}


def test_numbers_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert all(r.number == r.v + 1 for r in C.numbered_rows(rows, ["v"]).collect())


def test_join_totals_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    totals = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = join_totals(rows, totals, "k", "id", hot=100)
    assert got.count() == 3000 and got.where("k = 0 and n = 1000").count() == 1000


def test_links_of_classes(spark):
    members = spark.createDataFrame([(1, 1, 2, 5), (2, 1, 2, 6), (3, 3, 1, 5), (10, 10, 4, None), (11, 10, 4, None), (12, 10, 4, None), (13, 10, 4, None)], "id long, rep long, size long, tag long")
    pairs = spark.createDataFrame([(1, 3)], "rep_a long, rep_b long")
    got = {tuple(r) for r in expand(pairs, members, full=3).collect()}
    assert got == {(2, 3), (1, 2), (10, 11), (10, 12), (10, 13)}  # 1 and 3 share a tag; the class of four is a star


def test_excluded(spark):
    paths = ["/r/a.txt", "/r/.git/x", "/r/node_modules/y", "/r/z.pyc", "/r/q.framework/b", "/other/a", "/r/.hidden", "/r/d/~$x.docx"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in rows.where(~excluded(F.col("path"), ["/r"])).collect()] == ["/r/a.txt"]


def test_percentile_is_the_nearest_rank(spark):
    rows = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 2, 3, 3]] + [(None,)], "ms double")
    assert E.percentile_exact(rows, "ms", 0.95).first()[0] == 5.0
    assert E.percentile_exact(rows, "ms", 0.5).first()[0] == 3.0
    assert E.percentile_exact(rows.limit(0), "ms", 0.5).count() == 0


def test_tables_are_released(spark):
    from recall_engine.plans import tables

    df = tables.materialize(spark.range(3), "short")
    folder = df.__dict__["_folder"]
    assert df.count() == 3 and any(p == folder for _, p in tables._made)
    tables.release(df, df)
    assert all(p != folder for _, p in tables._made)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
