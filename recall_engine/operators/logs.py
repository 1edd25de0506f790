"""Logs of searches and clicks: what they tell about files and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recall_engine.functions.text import fold
from recall_engine.plans.tables import materialize

DAY = 86_400.0
#: Rows of clicks that go to every executor at once.
HELD = 300_000


def distinct_clicks(clicks: DataFrame) -> DataFrame:
    """Clicks with ts as epoch seconds; a repeated id counts once."""
    return clicks.dropDuplicates(["id"]).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def general_use(clicks: DataFrame, now: float) -> DataFrame:
    """id, general: clicks of the last 365 days, each fading over 30 days."""
    recent = distinct_clicks(clicks).where(F.col("at") > now - 365 * DAY)
    return recent.groupBy(F.col("file_id").alias("id")).agg(F.sum(0.3 * F.exp(-(F.lit(now) - F.col("at")) / DAY / 30)).alias("general"))


def _beginnings(clicks: DataFrame, now: float) -> DataFrame:
    """key, id, n: clicks of the last 365 days by file and by the whole logged query and its beginnings of four characters or more."""
    logged = distinct_clicks(clicks).where(F.col("at") > now - 365 * DAY).select(F.trim(fold("query")).alias("q"), F.col("file_id").alias("id")).groupBy("q", "id").agg(F.count("*").alias("n"))
    starts = F.array_union(F.array("q"), F.when(F.length("q") >= 4, F.transform(F.sequence(F.lit(4), F.length("q")), lambda n: F.substring(F.col("q"), F.lit(1), n))).otherwise(F.array().cast("array<string>")))
    return logged.select(F.explode(starts).alias("key"), "id", "n").groupBy("key", "id").agg(F.sum("n").alias("n"))


def _keys(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.trim(fold("text")).alias("key")).where("key <> ''")


def specific_use(clicks: DataFrame, queries: DataFrame, now: float) -> DataFrame:
    """qid, id, specific: clicks after the same query, or, from four characters on, one that begins with it.

    queries(qid, text), a row each. A logged query is joined with its beginnings, so prefixes are found by equality.
    """
    return _keys(queries).join(_beginnings(clicks, now), "key").select("qid", "id", (0.5 * F.col("n")).alias("specific"))


def use(clicks: DataFrame, queries: DataFrame, candidates: DataFrame, now: float) -> DataFrame:
    """qid, id, general, specific of the candidates(qid, id).

    Candidates take the words of their query along and meet the clicks by words and file, so a popular query that many
    searches repeat is spread over its files and brings no rows but those of candidates.
    """
    rows = candidates.select("qid", "id").join(_keys(queries), "qid", "left").join(general_use(clicks, now), "id", "left")
    rows = rows.join(_beginnings(clicks, now), ["key", "id"], "left")
    return rows.select("qid", "id", "general", (0.5 * F.col("n")).alias("specific"))


def with_use(hits: DataFrame, clicks: DataFrame, queries: DataFrame, now: float) -> DataFrame:
    """hits(qid, id, ...) with general and specific as in use(). What clicks tell of the queries asked is written first and goes
    to every executor where it is small, so that the hits are not shuffled."""
    held = lambda df: F.broadcast(df) if df.count() <= HELD else df
    keys = materialize(_keys(queries), "keys")
    general = materialize(general_use(clicks, now), "general")
    specific = materialize(_beginnings(clicks, now).join(held(keys.select("key").distinct()), "key", "left_semi"), "specific")
    rows = hits.join(held(keys), "qid", "left").join(held(general), "id", "left").join(held(specific), ["key", "id"], "left")
    return rows.select(*[hits[c] for c in hits.columns], "general", (0.5 * F.col("n")).alias("specific"))


def answered_queries(clicks: DataFrame) -> DataFrame:
    """query, path, last: queries that led to an open, reveal or copy, with the last time."""
    kept = clicks.where(F.col("action").isin("open", "reveal", "copy") & (F.col("query") != ""))
    return kept.groupBy("query", "path").agg(F.max("ts").alias("last"))


def eval_queries(clicks: DataFrame) -> DataFrame:
    """query, expected, source of the export for evaluation, in the order of the last time."""
    return answered_queries(clicks).orderBy("last", "query", "path").select("query", F.array("path").alias("expected"), F.lit("log").alias("source"))
