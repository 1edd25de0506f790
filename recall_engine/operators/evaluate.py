"""Measures of ranked results against expected files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from recall_engine.operators.catalog import display_parent, sensitive
from recall_engine.operators.fusion import Options
from recall_engine.plans.tables import materialize


def expected_ids(queries: DataFrame, files: DataFrame) -> DataFrame:
    """qid, id of queries(qid, expected array of paths); paths that are in no file are dropped."""
    return queries.select("qid", F.explode("expected").alias("path")).join(files.select("path", "id"), "path").select("qid", "id").distinct()


def first_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """qid, rank (from 0) of the first expected result of results(qid, id, place); null if there is none."""
    found = results.join(expected, ["qid", "id"]).groupBy("qid").agg(F.min("place").alias("rank"))
    return expected.select("qid").distinct().join(found, "qid", "left")


def misses(results: DataFrame, expected: DataFrame, queries: DataFrame, files: DataFrame, within: int = 3) -> DataFrame:
    """qid, query, rank, expected (a path), got (names and folders of the first three) of the queries whose first expected
    result is not among the first. results(qid, id, place), expected(qid, id), queries(qid, query)."""
    ranks = first_ranks(results, expected).where(F.col("rank").isNull() | (F.col("rank") >= within))
    named = files.select("id", "path", F.concat("name", F.lit("  ("), display_parent("root", "rel_parent"), F.lit(")")).alias("label"))
    wanted = expected.join(named, "id").groupBy("qid").agg(F.min("path").alias("expected"))
    shown = results.where(F.col("place") < 3).join(named, "id").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "label"))).alias("x"))
    rows = ranks.join(queries.select("qid", "query"), "qid").join(wanted, "qid", "left").join(shown, "qid", "left")
    return rows.select("qid", "query", "rank", "expected", F.coalesce(F.col("x.label"), F.array().cast("array<string>")).alias("got"))


def quality(ranks: DataFrame, *by: str) -> DataFrame:
    """n, mrr, r1, r3 and r10 over queries' first ranks, by the columns named."""
    inside = lambda k: F.avg(F.when(F.col("rank") < k, 1.0).otherwise(0.0)).alias(f"r{k}")
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0))).alias("mrr"), inside(1), inside(3), inside(10))


class Ordered:
    """The distinct values of a column in order, with how many rows have each, from which any place can be read.

    Rows are counted before their shuffle and sorted by range over all tasks; there is never a list of all values.
    """

    def __init__(self, rows: DataFrame, column: str):
        counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
        kept = materialize(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
        sizes = kept.groupBy("part").agg(F.sum("c").alias("n"))  # as many rows as tasks
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        upto = F.sum("c").over(Window.partitionBy("part").orderBy("value")) + F.col("before")
        self.placed = kept.join(F.broadcast(sizes.withColumn("before", before).drop("n")), "part").withColumn("upto", upto)
        self.total = sizes.agg(F.sum("n")).first()[0] or 0

    def at(self, *places: int) -> DataFrame:
        """place, value at places (from 0) of the sorted rows."""
        wanted = F.explode(F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (F.col("upto") > p) & (F.col("upto") - F.col("c") <= p)))
        return self.placed.select(wanted.alias("place"), "value")


def percentile_exact(rows: DataFrame, column: str, share: float) -> DataFrame:
    """value: the nearest-rank percentile of a column over all rows; no row without values."""
    ordered = Ordered(rows, column)
    return ordered.at(min(ordered.total - 1, int(share * ordered.total))).select("value")


def median_exact(rows: DataFrame, column: str) -> float | None:
    """The middle value of a column, or the mean of the two in the middle; None without values."""
    ordered = Ordered(rows, column)
    middle = {(ordered.total - 1) // 2, ordered.total // 2} if ordered.total else set()
    found = {r.place: r.value for r in ordered.at(*middle).collect()} if middle else {}
    return sum(found.values()) / len(found) if found else None


def first_turns(files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """id, path, kind, status, stratum, turn: up to n files of each (kind, has text), in a seeded order; no sensitive paths.

    The limit per group is applied before the shuffle, so a large group costs no more than a small one.
    """
    pool = files.where(~sensitive("path")).select("id", "path", "kind", "status", (F.col("status") == "ok").alias("ok"))
    turn = F.row_number().over(Window.partitionBy("kind", "ok").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    sizes = pool.groupBy("kind", "ok").agg(F.count("*").alias("stratum"))
    return pool.withColumn("turn", turn).where(F.col("turn") <= n).join(sizes, ["kind", "ok"])


def stratified(files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n files, one of each (kind, has text) in turn, larger groups first."""
    return first_turns(files, n, seed).orderBy("turn", F.desc("stratum"), "kind", "ok").limit(n).select("id", "path", "kind", "status", "turn")


# Sets of variants that are measured together, each as options that differ from the defaults.
PRESETS: dict[str, list[tuple[str, dict[str, object]]]] = {
    "phases": [
        ("1 · keywords, names and folders", {"semantic": False, "content": False, "parse": False, "signals": False}),
        ("2 · keywords + content", {"semantic": False, "parse": False, "signals": False}),
        ("3 · hybrid (RRF)", {"parse": False, "signals": False}),
        ("4 · + dates and types", {"signals": False}),
        ("4 · + signals", {}),
        ("4 · + reranker", {"rerank": True}),
    ],
    "weights": [
        ("default", {}),
        ("meaning only", {"lexical": False}),
        ("keywords only", {"semantic": False}),
        ("w_sem 0.5", {"w_sem": 0.5}),
        ("w_sem 1.5", {"w_sem": 1.5}),
        ("w_sem 2", {"w_sem": 2.0}),
        ("rrf_k 60", {"rrf_k": 60.0}),
        ("w_name 5", {"w_name": 5.0}),
        ("w_path 3", {"w_path": 3.0}),
        ("w_content 0.5", {"w_content": 0.5}),
        ("no name vectors", {"name_vectors": False}),
        ("keywords in one list", {"split_lexical": False}),
        ("content keywords ×0.5", {"w_lex_content": 0.5}),
        ("content keywords ×1.5", {"w_lex_content": 1.5}),
        ("rrf_k 10", {"rrf_k": 10.0}),
        ("rrf_k 40", {"rrf_k": 40.0}),
        ("no multi-chunk bonus", {"multi_chunk_bonus": 0.0}),
        ("no recency", {"recency": 0.0, "last_used": 0.0}),
        ("recency ×2", {"recency": 0.3, "last_used": 0.3}),
        ("no exact name", {"exact_name": 0.0}),
        ("exact name 0.6", {"exact_name": 0.6}),
    ],
    "rerank": [
        ("no reranker", {}),
        ("top 20, 600 chars", {"rerank": True, "rerank_top": 20, "rerank_chars": 600}),
        ("top 20, 300 chars", {"rerank": True, "rerank_top": 20, "rerank_chars": 300}),
        ("top 10, 300 chars", {"rerank": True, "rerank_top": 10, "rerank_chars": 300}),
        ("top 10, 150 chars", {"rerank": True, "rerank_top": 10, "rerank_chars": 150}),
        ("top 10, 150 chars, weight 0.5", {"rerank": True, "rerank_weight": 0.5}),
        ("top 10, 150 chars, weight 2", {"rerank": True, "rerank_weight": 2.0}),
    ],
}


def preset(name: str) -> list[tuple[str, Options]]:
    """Names and options of a set of variants."""
    return [(label, replace(Options(), **given)) for label, given in PRESETS[name]]
