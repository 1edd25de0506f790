"""The whole search over the tables of a folder: one query or a table of them, in two phases, and its measures."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from recall_engine.functions.queryparse import parsed
from recall_engine.operators import catalog as C, evaluate as E, fusion as R, lexical as L, logs, models as M, present as P, semantic as S
from recall_engine.plans.tables import materialize

#: From queries(qid, text) to (qid, q).
Embed = Callable[[DataFrame], DataFrame]
#: Loads a model in a worker and returns a function from (query, passage) pairs to a score each.
Pairs = Callable[[], Callable[[list[tuple[str, str]]], object]]


@dataclass(frozen=True)
class Answer:
    """The two phases of an answer. fast is there at once; final reads the table of the fast one and reorders its head, so
    that the search itself runs once. Only the first phase is a search to be logged."""

    fast: DataFrame
    final: DataFrame


class Engine:
    """Tables files, lexical_index, chunks, vectors and clicks of a folder, and the text index built from them once."""

    def __init__(self, spark: SparkSession, folder: str, stem: bool = True, embed: Embed | None = None, pairs: Pairs | None = None):
        """embed: from queries(qid, text) to (qid, q); without it vectors are not searched. pairs: loads the model that
        re-ranks; without it Options.rerank leaves the fast list as it is."""
        read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
        self.spark, self.stem, self.embed, self.pairs = spark, stem, embed, pairs
        self.files, self.vectors, self.clicks, self.chunks, self.records = (read(t) for t in ("files", "vectors", "clicks", "chunks", "lexical_index"))
        self.index = L.cached(spark, f"{folder}/lexical_index.parquet", stem)

    def _hits(self, asked: DataFrame, o: R.Options, allowed: DataFrame | None, now: float, soft: bool) -> DataFrame:
        text = asked.select("qid", F.trim(F.concat_ws(" ", "text", "name_terms")).alias("text"))
        lex = sem = None
        if o.lexical:
            if o.split_lexical and o.content:
                names = L.search(self.index, text, replace(o.weights(), content=0.0), 200, allowed, self.stem).withColumn("weight", F.lit(o.w_lex))
                content = L.search(self.index, text, L.Weights(0.0, 0.0, 1.0), 200, allowed, self.stem, prefix=False).withColumn("weight", F.lit(o.w_lex_content))
                lex = names.unionByName(content)
            else:
                lex = L.search(self.index, text, o.weights(), 200, allowed, self.stem)
        if o.semantic and self.embed is not None:
            rows = S.top_rows(S.searchable(self.vectors), self.embed(asked.select("qid", "text")), S.ROWS, allowed)
            if not (o.name_vectors and o.content):
                rows = rows.join(S.searchable(self.vectors, o.name_vectors, o.content).select("row"), "row", "left_semi")
            sem = S.per_file(rows)
        if lex is None and sem is None:
            raise ValueError("neither keywords nor vectors are searched")
        fused = R.cut_margin(R.fuse(lex, sem, o), o.sem_only_margin)
        fused = materialize(fused.join(self.files.select("id"), "id", "left_semi"), "fused")
        clicks = logs.use(self.clicks, asked, fused, now) if o.signals else None
        return R.signals(fused, self.files, asked, now, o, clicks, soft, self.stem)

    def search(self, queries: DataFrame, o: R.Options = R.Options(), now: float | None = None, exts: list[str] | None = None, days: int | None = None, disabled: frozenset[str] = frozenset()) -> DataFrame:
        """qid, place, id, score, lex_rank, sem_rank, best_row, bonus, relaxed for queries(qid, query), re-ranked if o.rerank.

        exts and days filter strictly; dates and types in a query rank, or filter too with parsed_strict, which falls
        back on ranking for fewer than three hits. A query of filters only lists the newest files that pass them.
        """
        return self.answer(queries, o, now, exts, days, disabled).final

    def answer(self, queries: DataFrame, o: R.Options = R.Options(), now: float | None = None, exts: list[str] | None = None, days: int | None = None, disabled: frozenset[str] = frozenset()) -> Answer:
        """search() in two phases; without re-ranking both are the same."""
        now = time.time() if now is None else now
        today = datetime.fromtimestamp(now, UTC).date()
        asked = materialize(self._parse(queries, o, today, disabled), "asked")
        start, end = (now - days * C.DAY, now + C.DAY) if days else (None, None)
        allowed = C.allowed(self.files, exts, start, end).select("id") if exts or days else None
        worded = asked.where("trim(text) <> ''")
        hits = materialize(self._hits(worded, o, allowed, now, True), "hits")
        if o.parsed_strict:
            inside = self._passing(hits.select("qid", "id"), worded, exts)
            strict = self._hits(worded, o, allowed, now, False).join(inside, ["qid", "id"], "left_semi")
            hits = R.relax(strict, hits)
        else:
            hits = hits.withColumn("relaxed", F.lit(False))
        listed = self._listing(asked.where("trim(text) = ''"), exts, start, end, o.limit)
        every = hits.select("qid", "id", "score", "lex_rank", "sem_rank", "best_row", "bonus", "relaxed").unionByName(listed)
        ranked = every.withColumn("place", F.row_number().over(R.Window.partitionBy("qid").orderBy(F.asc("relaxed"), *R.order())) - 1)
        listed = ranked.where(F.col("place") < max(o.limit, o.rerank_top))
        if not (o.rerank and self.pairs is not None):
            fast = listed.where(F.col("place") < o.limit)
            return Answer(fast, fast)
        held = materialize(listed, "fast")
        return Answer(held.where(F.col("place") < o.limit), self._reranked(held, worded, o).where(F.col("place") < o.limit))

    def _reranked(self, hits: DataFrame, asked: DataFrame, o: R.Options) -> DataFrame:
        """Hits with the places of a second model for the head of each list of two or more that words asked for."""
        several = hits.groupBy("qid").count().where("count > 1").select("qid")
        head = hits.where(F.col("place") < o.rerank_top).join(several, "qid", "left_semi").join(asked.select("qid", "text"), "qid")
        read = P.passages(head.select("qid", "id", "text", "best_row"), self.files, self.records, self.chunks, o.rerank_chars)
        scores = M.score_pairs(read.select("qid", "id", "text", "passage"), self.pairs)
        return R.rerank(hits, scores, o).withColumn("place", F.col("final_rank")).select(*hits.columns)

    def explain(self, hits: DataFrame, queries: DataFrame, o: R.Options = R.Options(), now: float | None = None) -> DataFrame:
        """qid, id, reasons of hits of search() for its queries(qid, query); words are compared as in the search."""
        now = time.time() if now is None else now
        asked = materialize(self._parse(queries, o, datetime.fromtimestamp(now, UTC).date(), frozenset()), "asked")
        used = logs.use(self.clicks, asked, hits.select("qid", "id"), now)
        return P.explain(hits.select("qid", "id", "lex_rank", "sem_rank").join(used, ["qid", "id"]), self.files, asked, self.stem)

    def snippets(self, hits: DataFrame, queries: DataFrame, o: R.Options = R.Options(), now: float | None = None) -> DataFrame:
        """qid, id, snippet of hits of search() for its queries(qid, query); words are lit up by their stems."""
        today = datetime.fromtimestamp(time.time() if now is None else now, UTC).date()
        asked = self._parse(queries, o, today, frozenset())
        return P.snippets(hits.select("qid", "id", "lex_rank", "sem_rank", "best_row"), self.records, self.files, self.chunks, asked, self.stem)

    def _parse(self, queries: DataFrame, o: R.Options, today: date, disabled: frozenset[str]) -> DataFrame:
        if o.parse:
            return queries.select("qid", parsed(F.col("query"), today, disabled).alias("p")).select("qid", "p.*")
        none = {"exts": F.array().cast("array<string>"), "date_from": F.lit(None).cast("double"), "date_to": F.lit(None).cast("double"), "year_hint": F.lit(None).cast("int"), "name_terms": F.lit(""), "recent": F.lit(False)}
        return queries.select("qid", F.trim("query").alias("text")).withColumns(none)

    def _passing(self, hits: DataFrame, asked: DataFrame, exts: list[str] | None) -> DataFrame:
        """qid, id of hits that pass the dates and types of their query."""
        f = self.files.select("id", "ext", "mtime", "ctime", "last_used")
        wanted = F.col("exts")
        if exts:
            both = F.array_intersect("exts", F.array(*[F.lit(e) for e in exts]))
            wanted = F.when(F.size(both) > 0, both).otherwise(F.col("exts"))
        rows = hits.join(f, "id").join(asked.select("qid", "exts", "date_from", "date_to"), "qid")
        dated = F.col("date_from").isNull() | C.in_dates(F.col("date_from"), F.col("date_to"))
        return rows.where(((F.size("exts") == 0) | F.array_contains(wanted, F.col("ext"))) & dated).select("qid", "id")

    def _listing(self, asked: DataFrame, exts: list[str] | None, start: float | None, end: float | None, limit: int) -> DataFrame:
        """The newest files for queries without words. Equal filters are answered once, each by a limit of its own."""
        key = F.xxhash64(F.concat_ws(",", "exts"), "date_from", "date_to")
        asked = asked.withColumn("filter", key)
        out = None
        for r in asked.select("filter", "exts", "date_from", "date_to").distinct().collect():  # distinct filters, not queries
            both = sorted(set(r.exts) & set(exts or [])) or list(r.exts) if r.exts else list(exts or [])
            a = max(start or 0, r.date_from) if r.date_from is not None else start
            b = (min(end, r.date_to) if end else r.date_to) if r.date_from is not None else end
            found = C.newest(C.allowed(self.files, both or None, a, b), limit).select(F.lit(r["filter"]).alias("filter"), "id", "score")
            out = found if out is None else out.unionByName(found)
        if out is None:
            return self.spark.createDataFrame([], "qid long, id long, score double, lex_rank int, sem_rank int, best_row long, bonus double, relaxed boolean")
        return asked.join(out, "filter").select("qid", "id", "score", F.lit(None).cast("int").alias("lex_rank"), F.lit(None).cast("int").alias("sem_rank"), F.lit(None).cast("long").alias("best_row"), F.lit(0.0).alias("bonus"), F.lit(False).alias("relaxed"))

    def evaluate(self, queries: DataFrame, variants: list[tuple[str, R.Options]], now: float, timed: int = 0) -> list[dict]:
        """Of each variant for queries(qid, query, expected paths): variant, n, skipped (queries none of whose paths is
        known), mrr, r1, r3, r10, misses (queries without an expected file among the first three), seconds of all queries
        together, and p50, p95 in milliseconds of a search of its own for each of the first timed queries (None for none).
        """
        expected = materialize(E.expected_ids(queries, self.files), "expected")
        asked = materialize(queries.select("qid", "query").join(expected.select("qid").distinct(), "qid"), "asked")
        skipped = queries.select("qid").distinct().count() - asked.count()
        each = asked.orderBy("qid").limit(timed).collect() if timed else []
        out = []
        for name, o in variants:
            o = replace(o, limit=max(10, o.limit))
            began = time.perf_counter()
            results = materialize(self.search(asked, o, now).select("qid", "id", "place"), "results")
            seconds = time.perf_counter() - began
            missed = [r.asDict() for r in E.misses(results, expected, asked, self.files).orderBy("qid").collect()]  # a query set is a file someone wrote
            out.append({"variant": name, **E.quality(E.first_ranks(results, expected)).first().asDict(), "skipped": skipped, "misses": missed, "seconds": round(seconds, 3), **self._latency(each, o, now)})
        return out

    def _latency(self, each: list, o: R.Options, now: float) -> dict:
        times = []
        for r in each:
            began = time.perf_counter()
            self.search(self.spark.createDataFrame([(r.qid, r.query)], "qid long, query string"), o, now).collect()
            times.append((time.perf_counter() - began) * 1000)
        times.sort()
        return {"p50": statistics.median(times) if times else None, "p95": times[min(len(times) - 1, int(0.95 * len(times)))] if times else None}
