"""Search of quantised vectors: exact cosines of many queries against all live rows, and their best rows per file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from recall_engine.plans.tables import spread

#: Rows that are kept per query, files of these, and what counts as close to a file's best row.
ROWS, FILES, CLOSE = 300, 150, 0.02
#: Queries that go to every worker at once; more are searched in turns.
QUERIES = 4096


def quantise(v: Column) -> tuple[Column, Column]:
    """A float vector as bytes and a scale: the largest absolute value becomes 127, halves round to even."""
    most = F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(1e-9))
    return F.transform(v, lambda x: F.rint(x.cast("double") / most * 127).cast("tinyint")), (most / 127).cast("float")


def dequantise(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, scaled to length one; null without such a token."""
    kept = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["s"])
    total = F.aggregate(F.slice(kept, 2, 1 << 20), F.transform(kept[0], lambda x: x.cast("double")), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    length = F.greatest(norm(total), F.lit(1e-12))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: (x / length).cast("float")))


def searchable(vectors: DataFrame, names: bool = True, content: bool = True) -> DataFrame:
    """Live rows with a usable q; name rows or content rows can be left out."""
    rows = vectors.where((F.col("file_id") >= 0) & F.exists("q", lambda x: x != 0))
    if not names:
        rows = rows.where(~F.col("is_name"))
    return rows if content else rows.where("is_name")


#: Rows that lists of best rows of all tasks may hold together; above that a task reads all vectors for its part of the queries.
LISTED = 2_000_000
#: Lists of best rows that are joined in one step; of more tasks than that, lists are joined in two steps.
LISTS = 64


class _Best:
    """The k best rows of each of some queries among those seen so far, ties to the smaller row."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.fast, self.k = queries, queries.astype(np.float32), k
        self.of, self.cos, self.row, self.file = (np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))
        self.least = np.full(len(queries), -2.0, np.float32)

    def add(self, x: np.ndarray, row: np.ndarray, file: np.ndarray) -> None:
        """Rows of unit vectors x. Single precision chooses, double precision tells."""
        fast, n = x.astype(np.float32), min(self.k, len(x))
        for low in range(0, len(self.q), 512):
            cos = self.fast[low : low + 512] @ fast.T
            # the k best of these rows, and none that is behind the k best so far; as good ones stay, so that ties are told by their number
            last = np.partition(cos, -n, axis=1)[:, -n]
            i, j = np.nonzero(cos >= np.maximum(last, self.least[low : low + 512])[:, None] - 2e-6)
            exact = np.einsum("ij,ij->i", self.q[low + i], x[j])
            old = (self.of >= low) & (self.of < low + 512)
            of, value, rows, files = (np.concatenate([a[old], b]) for a, b in ((self.of, low + i), (self.cos, exact), (self.row, row[j]), (self.file, file[j])))
            order = np.lexsort((rows, -np.rint(value * 1e6), of))
            start = np.searchsorted(of[order], np.arange(low, min(low + 512, len(self.q)) + 1))
            place = np.arange(len(order)) - np.repeat(start[:-1], np.diff(start))
            order = order[place < self.k]
            full = np.flatnonzero(np.diff(start) >= self.k)
            kept = np.searchsorted(of[order], low + full, "right") - 1
            self.least[low + full] = value[order][kept]
            self.of, self.cos, self.row, self.file = (np.concatenate([a[~old], b[order]]) for a, b in ((self.of, of), (self.cos, value), (self.row, rows), (self.file, files)))


_BEST = "array<struct<behind:double, row:long, file_id:long, cos:double>>"


def top_rows(vectors: DataFrame, queries: DataFrame, k: int = ROWS, allowed: DataFrame | None = None) -> DataFrame:
    """qid, row, file_id, cos: the k rows most similar to each query of queries(qid, q array of numbers).

    Every query is compared with every allowed row, in blocks: the queries, in turns of a bounded number, go to the
    workers, each multiplies them with its rows, keeps the k best of each query over all its batches and passes them on as
    one list; lists are joined and cut in the JVM. Where the lists of all tasks would be large, each part of the queries has
    one task that reads all rows, so that only the rows kept come out and nothing is shuffled. Rows of another length than the query, and null or zero queries, have
    no answers. Ties go to the smaller row. The queries are counted while the plan is built.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    plain = vectors.select(F.col("row").cast("long").alias("row"), F.col("file_id").cast("long").alias("file_id"), "q")
    rows = spread(plain)
    asked = queries.where(F.exists("q", lambda x: x != 0)).select("qid", F.transform("q", lambda x: x.cast("float")).alias("q"))
    n = asked.count()
    turns, kind = max(1, -(-n // QUERIES)), f"qid long, task long, best {_BEST}"
    alone = n * k * rows._jdf.queryExecution().toRdd().getNumPartitions() > LISTED
    out = None
    if alone:
        turns = max(turns, min(n, rows.sparkSession.sparkContext.defaultParallelism))
        # an empty scan without a known partitioning: a union of single partitions alone would be one task
        out = plain.where("row < 0 and row > 0").mapInArrow(lambda batches: iter(()), kind)
    for turn in range(turns):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(turns)) == turn).toArrow()
        held = vectors.sparkSession.sparkContext.broadcast((part["qid"].to_pylist(), part["q"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, vectors_of = held.value
            by_size: dict[int, tuple[list[int], _Best]] = {}
            for size in {len(v) for v in vectors_of}:
                which = [i for i, v in enumerate(vectors_of) if len(v) == size]
                m = np.array([vectors_of[i] for i in which], np.float64)
                by_size[size] = ([ids[i] for i in which], _Best(m / np.linalg.norm(m, axis=1, keepdims=True), k))
            for b in batches:
                lengths = np.diff(b.column(2).offsets.to_numpy())
                for size, (_, best) in by_size.items():
                    at = np.flatnonzero(lengths == size)
                    if len(at):
                        x = b.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
                        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                        best.add(x, b.column(0).to_numpy()[at], b.column(1).to_numpy()[at])
            for names, best in by_size.values():
                order = np.argsort(best.of, kind="stable")
                cos = best.cos[order]
                inside = pa.StructArray.from_arrays([pa.array(-np.rint(cos * 1e6)), pa.array(best.row[order]), pa.array(best.file[order]), pa.array(cos)], names=["behind", "row", "file_id", "cos"])
                offsets = pa.array(np.searchsorted(best.of[order], np.arange(len(names) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.full(len(names), TaskContext.get().partitionId())), pa.ListArray.from_arrays(offsets, inside)], names=["qid", "task", "best"])

        found = (plain.coalesce(1) if alone else rows).mapInArrow(run, kind)
        out = found if out is None else out.unionByName(found)
    if alone:
        return out.select("qid", F.explode("best").alias("b")).select("qid", "b.row", "b.file_id", "b.cos")
    join = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    if rows._jdf.queryExecution().toRdd().getNumPartitions() > LISTS:
        out = out.groupBy("qid", F.pmod("task", F.lit(LISTS)).alias("task")).agg(join)
    return out.groupBy("qid").agg(join).select("qid", F.explode("best").alias("b")).select("qid", "b.row", "b.file_id", "b.cos")


def per_file(rows: DataFrame, files: int = FILES) -> DataFrame:
    """qid, file_id, cos, best_row, near, rank (from 0): each file by its best row, and how many rows are close to it."""
    best = Window.partitionBy("qid", "file_id")
    marked = rows.withColumn("top", F.max("cos").over(best))
    grouped = marked.groupBy("qid", "file_id").agg(F.max("cos").alias("cos"), F.min(F.when(F.col("cos") == F.col("top"), F.col("row"))).alias("best_row"), F.count_if(F.col("cos") > F.col("top") - CLOSE).alias("near"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.rint(F.col("cos") * 1e6)), "file_id"))
    return grouped.withColumn("rank", place - 1).where(F.col("rank") < files)
