"""Problem 4: one ranking from several scores of different scales.

Method: ideal-point ranking. In each search every score is winsorised and divided by its vector norm, so none decides by
its range; the weighted distances of a hit to the best and to the worst point there is give its relative closeness,
which ranks the hits. p4_found asks for the hit that wins by majority: hits meet in the order of their closeness, each
stretch of rows passes on one, and the one left is checked against every other hit of its search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recall_engine.plans.skew import join_totals
from recall_engine.plans.tables import materialize

#: Shares of the values of a search that are pulled in at either end.
TAILS = (0.05, 0.95)
#: Weights of lex_rank, sem_rank and score.
WEIGHTS = {"lex_rank": 1.0, "sem_rank": 1.0, "score": 1.0}
_BIG = float(1 << 40)


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One row per search and id, with its best values; rows without a search or an id are left out, NaN is null."""
    score = F.when(~F.isnan("score"), F.col("score"))
    kept = hits.where("search_id is not null and id is not null")
    return kept.groupBy("search_id", "id").agg(F.min("lex_rank").cast("double").alias("lex_rank"), F.min("sem_rank").cast("double").alias("sem_rank"), F.max(score).cast("double").alias("score"))


def closeness(hits: DataFrame, weights: dict[str, float] = WEIGHTS, tails: tuple[float, float] = TAILS) -> DataFrame:
    """The distinct hits with n (hits of the search) and closeness, 0 to 1.

    A null stands behind every value: it counts as the worst value of the search once winsorised and one step worse. A
    score that is equal or null in all hits of a search has no part in it; where none has, closeness is 0. Totals of a
    search are combined before their shuffle; a search with a large part of all rows is spread over many tasks.
    """
    one = distinct_hits(hits)
    names = list(weights)
    bounds = one.groupBy("search_id").agg(F.count("*").alias("n"), *[F.percentile_approx(c, list(tails), 1000).alias(f"{c}_q") for c in names])
    rows = join_totals(one, materialize(bounds, "bounds"), "search_id", "id")
    for c in names:
        low, high = F.col(f"{c}_q")[0], F.col(f"{c}_q")[1]
        # ranks count from the best, so that a rank of 0 has a size; a lower score is worse, a greater rank is worse
        worst = low - (high - low) / F.greatest("n", F.lit(2)) if c == "score" else high + 1
        value = F.when(F.col(c).isNull(), worst).otherwise(F.least(F.greatest(F.col(c), low), high))
        rows = rows.withColumn(f"{c}_w", F.coalesce(value if c == "score" else value + 1, F.lit(0.0)))
    totals = rows.groupBy("search_id").agg(F.count("*").alias("n"), *[f(F.col(f"{c}_w")).alias(f"{c}_{m}") for c in names for m, f in (("min", F.min), ("max", F.max), ("sq", lambda x: F.sum(x * x)))])
    rows = join_totals(rows.drop("n"), materialize(totals, "totals"), "search_id", "id")
    ideal, anti = F.lit(0.0), F.lit(0.0)
    for c in names:
        norm = F.when(F.col(f"{c}_sq") > 0, F.sqrt(f"{c}_sq")).otherwise(1.0)
        best, worst = (f"{c}_max", f"{c}_min") if c == "score" else (f"{c}_min", f"{c}_max")
        ideal += F.pow((F.col(f"{c}_w") - F.col(best)) / norm * weights[c], 2)
        anti += F.pow((F.col(f"{c}_w") - F.col(worst)) / norm * weights[c], 2)
    far = F.sqrt(ideal) + F.sqrt(anti)
    value = F.when(far > 0, F.sqrt(anti) / far).otherwise(0.0)
    return rows.select("search_id", "id", *names, "n", F.round(value, 12).alias("closeness"))


def ranking(hits: DataFrame, **options) -> DataFrame:
    """search_id, id, position (from 1), closeness; ties go to the smaller id.

    Positions come from ranges of rows sorted over all tasks and the sizes of the ranges before, so the hits of a search
    never have to be in one task.
    """
    sorted_rows = closeness(hits, **options).select("search_id", "id", "closeness").repartitionByRange("search_id", F.desc("closeness"), "id")
    parts = materialize(sorted_rows.withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("search_id", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("search_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("search_id", "part").orderBy(F.desc("closeness"), "id"))
    joined = parts.join(sizes.withColumn("before", before).drop("size"), ["search_id", "part"])
    return joined.select("search_id", "id", (own + F.col("before")).cast("long").alias("position"), "closeness")


def _ahead(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a (lex, sem, -score; infinite for null) are ahead of rows b in two comparisons or more."""
    return (a < b).sum(1) >= 2


def _left_over(batches: Iterator[pa.RecordBatch], ordered: bool) -> Iterator[pa.RecordBatch]:
    """Of each search of a batch the hit that is left when neighbours meet: the closer one stays if it is ahead.

    A hit ahead of every other of its search always stays. ordered: searches are in order over the batches, so that the
    last one's hit meets the next batch and each search leaves one hit.
    """
    carry: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([carry, t]) if carry is not None else t
        if not t.num_rows:
            continue
        key, near = t["search_id"].to_numpy(), t["closeness"].to_numpy()
        x = np.stack([t["lex_rank"].to_numpy(), t["sem_rank"].to_numpy(), -t["score"].to_numpy()], 1)
        x = np.where(np.isnan(x), np.inf, x)
        rows = np.lexsort((t["id"].to_numpy(), -near, key))
        while True:
            new = np.concatenate([[True], key[rows][1:] != key[rows][:-1]])
            place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
            second = np.flatnonzero(place % 2 == 1)
            if not len(second):
                break
            stays = _ahead(x[rows[second - 1]], x[rows[second]])
            rows = np.delete(rows, np.where(stays, second, second - 1))
        kept = t.take(pa.array(rows))
        if ordered:
            yield from kept.slice(0, kept.num_rows - 1).combine_chunks().to_batches()
            carry = kept.slice(kept.num_rows - 1)
        else:
            yield from kept.combine_chunks().to_batches()
    if carry is not None:
        yield from carry.combine_chunks().to_batches()


def winners(hits: DataFrame, **options) -> DataFrame:
    """search_id, id of the hit ahead of every other of its search in at least two of three comparisons, if there is one."""
    scored = materialize(closeness(hits, **options).where("n > 1"), "closeness")
    schema = scored.schema
    first = scored.mapInArrow(lambda x: _left_over(x, False), schema)
    last = first.repartition("search_id").sortWithinPartitions("search_id").mapInArrow(lambda x: _left_over(x, True), schema)
    champion = materialize(last.select("search_id", "n", F.col("id").alias("best"), *[F.col(c).alias(f"b_{c}") for c in WEIGHTS]), "left")
    both = join_totals(scored.drop("n"), champion, "search_id", "id").where("id <> best")
    points = F.lit(0)
    for c in WEIGHTS:
        sign = -1 if c == "score" else 1
        null = F.lit(_BIG)
        points += F.when(F.coalesce(sign * F.col(f"b_{c}"), null) < F.coalesce(sign * F.col(c), null), 1).otherwise(0)
    return both.groupBy("search_id", "best").agg(F.min(points).alias("least")).where("least >= 2").select("search_id", F.col("best").alias("id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(spark.read.parquet(f"{sf_dir}/hits.parquet"))


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking(spark.read.parquet(f"{sf_dir}/hits.parquet")).withColumn("closeness", F.round("closeness", 9))


P4_SQL = """
WITH h AS (
  SELECT search_id, id, min(lex_rank) AS l, min(sem_rank) AS s, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS c FROM hits
  WHERE search_id IS NOT NULL AND id IS NOT NULL GROUP BY search_id, id
), pairs AS (
  SELECT a.search_id, a.id,
    (CASE WHEN a.l IS NOT NULL AND (b.l IS NULL OR a.l < b.l) THEN 1 ELSE 0 END) + (CASE WHEN a.s IS NOT NULL AND (b.s IS NULL OR a.s < b.s) THEN 1 ELSE 0 END)
    + (CASE WHEN a.c IS NOT NULL AND (b.c IS NULL OR a.c > b.c) THEN 1 ELSE 0 END) AS points
  FROM h a JOIN h b ON a.search_id = b.search_id AND a.id <> b.id
)
SELECT search_id, id FROM pairs GROUP BY search_id, id HAVING min(points) >= 2
"""


def _ranking_sql() -> str:
    """The ranking in SQL, column by column: l and s are ranks (0 is best), c is the score."""
    cols = {"l": 1, "s": 1, "c": -1}
    bounds = ", ".join(f"quantile_disc({c}, {TAILS[0]}) AS {c}_lo, quantile_disc({c}, {TAILS[1]}) AS {c}_hi" for c in cols)
    worst = lambda c, sign: f"{c}_hi + 1" if sign > 0 else f"{c}_lo - ({c}_hi - {c}_lo) / greatest(n, 2)"
    wins = ", ".join(f"coalesce(CASE WHEN {c} IS NULL THEN {worst(c, x)} ELSE least(greatest({c}, {c}_lo), {c}_hi) END{' + 1' if x > 0 else ''}, 0.0) AS {c}_w" for c, x in cols.items())
    totals = ", ".join(f"min({c}_w) OVER p AS {c}_min, max({c}_w) OVER p AS {c}_max, sqrt(sum({c}_w * {c}_w) OVER p) AS {c}_norm" for c in cols)
    away = lambda c, end: f"power(({c}_w - {c}_{end}) / CASE WHEN {c}_norm > 0 THEN {c}_norm ELSE 1.0 END, 2)"
    ideal = " + ".join(away(c, "min" if x > 0 else "max") for c, x in cols.items())
    anti = " + ".join(away(c, "max" if x > 0 else "min") for c, x in cols.items())
    return f"""
WITH h AS (
  SELECT search_id, id, CAST(min(lex_rank) AS DOUBLE) AS l, CAST(min(sem_rank) AS DOUBLE) AS s, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS c FROM hits
  WHERE search_id IS NOT NULL AND id IS NOT NULL GROUP BY search_id, id
), b AS (SELECT search_id, count(*) AS n, {bounds} FROM h GROUP BY search_id),
w AS (SELECT search_id, id, {wins} FROM h JOIN b USING (search_id)),
t AS (SELECT search_id, id, l_w, s_w, c_w, {totals} FROM w WINDOW p AS (PARTITION BY search_id)),
d AS (SELECT search_id, id, sqrt({ideal}) AS far_best, sqrt({anti}) AS far_worst FROM t),
r AS (SELECT search_id, id, round(CASE WHEN far_best + far_worst > 0 THEN far_worst / (far_best + far_worst) ELSE 0.0 END, 12) AS closeness FROM d)
SELECT search_id, id, row_number() OVER (PARTITION BY search_id ORDER BY closeness DESC, id) AS position, round(closeness, 9) AS closeness FROM r"""


RANKING_SQL = _ranking_sql()
