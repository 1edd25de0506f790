"""Fusion of keyword and vector results, ranking signals and re-ranking."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from recall_engine.functions.stemmer import stems_of
from recall_engine.functions.text import fold, query_words, split_name, tokens, words
from recall_engine.functions.vocabulary import NOISY_FOLDERS, ROOT_ALIASES, STOPWORDS
from recall_engine.operators.lexical import Weights
from recall_engine.plans.tables import materialize

DAY = 86_400.0
#: Queries whose words go to every executor at once.
HELD = 100_000


@dataclass(frozen=True)
class Options:
    """Every knob of a search."""

    lexical: bool = True
    semantic: bool = True
    content: bool = True
    name_vectors: bool = True
    parse: bool = True
    signals: bool = True
    rerank: bool = False
    w_name: float = 3.0
    w_path: float = 1.5
    w_content: float = 1.0
    w_lex: float = 1.0
    w_lex_content: float = 1.0
    split_lexical: bool = False
    w_sem: float = 1.0
    rrf_k: float = 20.0
    multi_chunk_bonus: float = 0.05
    sem_only_margin: float = 0.03
    recency: float = 0.15
    last_used: float = 0.15
    frecency: float = 0.4
    exact_name: float = 0.3
    noisy_folder: float = 0.15
    duplicate: float = 0.1
    year_hint: float = 0.3
    cover: float = 0.3
    parsed_strict: bool = False
    date_in: float = 0.4
    date_out: float = 0.2
    type_in: float = 0.4
    type_out: float = 0.2
    rerank_top: int = 10
    rerank_weight: float = 1.0
    rerank_chars: int = 150
    limit: int = 30

    def weights(self) -> Weights:
        return Weights(self.w_name, self.w_path, self.w_content if self.content else 0.0)

    @classmethod
    def variant(cls, text: str) -> tuple[str, Options]:
        """Name and options of 'name=key:value,key:value'; values take the type of their default."""
        name, _, pairs = text.partition("=")
        base, given = cls(), {}
        for pair in filter(None, pairs.split(",")):
            key, _, value = pair.partition(":")
            if not hasattr(base, key):
                raise ValueError(f"no option {key!r}")
            kind = type(getattr(base, key))
            given[key] = value.lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)
        return name, replace(base, **given)


def reciprocal(rank: Column, weight: Column | float = 1.0, k: float = 20.0) -> Column:
    """What a place in a list (from 0) adds to a score; nothing without a place."""
    return F.when(rank.isNull(), 0.0).otherwise(weight / (k + rank + 1))


def fuse(lexical: DataFrame | None, semantic: DataFrame | None, o: Options = Options()) -> DataFrame:
    """qid, id, score, lex_rank, sem_rank, best_row, cos of lexical(qid, doc_id, rank[, weight]) and semantic(per_file).

    The lists are put under each other and summed by record, so a record of one list costs no more than one of both. They are
    shuffled by query, as all that follows needs them.
    """
    empty = {"lex_rank": "int", "sem_rank": "int", "best_row": "long", "cos": "double"}
    sides = []
    if lexical is not None:
        weight = F.col("weight") if "weight" in lexical.columns else F.lit(o.w_lex)
        sides.append(lexical.select("qid", F.col("doc_id").alias("id"), reciprocal(F.col("rank"), weight, o.rrf_k).alias("score"), F.col("rank").cast("int").alias("lex_rank")))
    if semantic is not None:
        bonus = o.w_sem * (1 + o.multi_chunk_bonus * F.least(F.col("near") - 1, F.lit(5)))
        sides.append(semantic.select("qid", F.col("file_id").alias("id"), reciprocal(F.col("rank"), bonus, o.rrf_k).alias("score"), F.col("rank").cast("int").alias("sem_rank"), "best_row", "cos"))
    full = [s.withColumns({c: F.lit(None).cast(t) for c, t in empty.items() if c not in s.columns}).select("qid", "id", "score", *empty) for s in sides]
    every = full[0] if len(full) == 1 else full[0].unionByName(full[1])
    return every.repartition("qid").groupBy("qid", "id").agg(F.sum("score").alias("score"), F.min("lex_rank").alias("lex_rank"), F.min("sem_rank").alias("sem_rank"), F.max("best_row").alias("best_row"), F.max("cos").alias("cos"))


def cut_margin(hits: DataFrame, margin: float = 0.03) -> DataFrame:
    """Hits without those found by meaning only and further than margin below the best cosine of their query."""
    if margin <= 0:
        return hits
    kept = hits.withColumn("best_cos", F.max("cos").over(Window.partitionBy("qid")))
    return kept.where(F.col("lex_rank").isNotNull() | F.col("cos").isNull() | (F.col("cos") >= F.col("best_cos") - margin)).drop("best_cos")


def decay(age_seconds: Column, days: float) -> Column:
    return F.exp(-F.greatest(age_seconds, F.lit(0.0)) / DAY / days)


def duplicate_name(name: Column) -> Column:
    """A name that ends as those of copies do."""
    return F.regexp_like(name, F.lit(r"(?i)(?: \(\d+\)| copie(?: \d+)?| copy(?: \d+)?)\.[^.]+$"))


def _root_words(root: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for p in ROOT_ALIASES.items() for x in p])
    return F.coalesce(F.try_element_at(lookup, root), root)


def folder_label(rel_parent: Column, root: Column) -> Column:
    """Folders of a file and its root, under all names people know it by, as words."""
    return F.concat_ws(" ", split_name(F.regexp_replace(rel_parent, "/", " ")), _root_words(root))


def signals(hits: DataFrame, files: DataFrame, queries: DataFrame, now: float, o: Options = Options(), clicks: DataFrame | None = None, soft: bool = True, stem: bool = False) -> DataFrame:
    """Hits with bonus and the score multiplied by 1 + bonus, at least 0.05. Hits of unknown files are left out.

    queries(qid, text, exts, date_from, date_to, year_hint, name_terms, recent) as parsed; clicks(qid, id, general,
    specific), unless the hits have these columns already. Terms: recency and last use, the word "recent", the exact name, the share of words found in name and
    folders, folders of copies, names of copies, depth, a year, use, and the softly applied dates and types. With stem,
    words of queries, names and folders are compared by their stems, each of a query and of a file found once.
    """
    terms = stems_of if stem else lambda x: x
    q = queries.withColumn("q_terms", terms(query_words("text"))).withColumn("q_words", F.filter(words("text"), lambda w: ~F.array_contains(F.array(*[F.lit(s) for s in STOPWORDS]), w)))
    stem_name = F.regexp_replace("name", r"(?s)\.[^.]*$", "")
    # what is read from names and folders is worked out once per file, not once per hit
    read = {
        "name_terms_": tokens(split_name(stem_name)),
        "folder_terms_": tokens(folder_label(F.col("rel_parent"), F.col("root"))),
        "name_words_": words("name"),
        "folders_": F.transform(F.split("rel_parent", "/"), fold),
        "duplicate_": duplicate_name(F.col("name")),
        "plain_name_": F.regexp_replace("name", "[_-]", ""),
    }
    f = files.select("id", "name", "ext", "rel_parent", "mtime", "ctime", "last_used", *[v.alias(k) for k, v in read.items()])
    f = f.join(hits.select("id").distinct(), "id", "left_semi")
    f = materialize(f.withColumns({c: terms(F.col(c)) for c in ("name_terms_", "folder_terms_")}), "names")
    # what is short is joined first, and words of queries and files come last: rows that hold them are not shuffled
    if clicks is not None:
        rows = hits.join(clicks, ["qid", "id"], "left")
    elif "general" in hits.columns:
        rows = hits
    else:
        rows = hits.withColumn("general", F.lit(None).cast("double")).withColumn("specific", F.lit(None).cast("double"))
    rows = rows.join(f, "id").join(F.broadcast(q) if queries.count() <= HELD else q, "qid")
    name_terms, folder_terms = F.col("name_terms_"), F.col("folder_terms_")
    age = F.lit(now) - F.col("mtime")
    none = F.lit(0.0)
    bonus = none
    if o.signals:
        bonus = o.recency * decay(age, 120)
        bonus += F.when(F.col("last_used").isNotNull() & (F.col("last_used") != 0), o.last_used * decay(F.lit(now) - F.col("last_used"), 60)).otherwise(none)
        bonus += F.when(F.col("recent"), 0.5 * decay(age, 30)).otherwise(none)
        some = F.size("q_terms") > 0
        exact = some & (F.size(F.array_except("q_terms", name_terms)) == 0)
        loose = (F.size("q_words") > 0) & (F.size(F.array_except("q_words", "name_words_")) == 0)
        bonus += F.when(exact | loose, F.lit(o.exact_name)).otherwise(none)
        both = F.array_union(name_terms, folder_terms)
        bonus += F.when(some, o.cover * F.size(F.array_intersect("q_terms", both)) / F.size("q_terms")).otherwise(none)
        folders = F.col("folders_")
        bonus -= F.when(F.arrays_overlap(folders, F.array(*[F.lit(x) for x in NOISY_FOLDERS])) & ~F.arrays_overlap(folders, F.col("q_words")), F.lit(o.noisy_folder)).otherwise(none)
        bonus -= F.when(F.col("duplicate_"), F.lit(o.duplicate)).otherwise(none)
        depth = F.when(F.col("rel_parent") == "", 0).otherwise(F.size(F.split("rel_parent", "/")))
        bonus -= F.greatest(depth - 6, F.lit(0)) * 0.02
        year = F.col("year_hint").cast("string")
        in_year = F.col("name").contains(year) | F.col("rel_parent").contains(year) | (F.year(F.timestamp_seconds("mtime")) == F.col("year_hint"))
        bonus += F.when(F.col("year_hint").isNotNull() & in_year, F.lit(o.year_hint)).otherwise(none)
        used = o.frecency * (F.coalesce("general", none) + 3 * F.coalesce("specific", none))
        bonus += F.least(F.lit(o.frecency), used)
    if soft:
        times = [F.col("mtime"), F.coalesce("last_used", none), F.col("ctime")]
        inside = F.exists(F.array(*times), lambda t: (t >= F.col("date_from")) & (t < F.col("date_to")))
        glued = F.replace("name_terms", F.lit(" "), F.lit(""))
        inside |= (F.col("name_terms") != "") & F.col("plain_name_").contains(glued)
        bonus += F.when(F.col("date_from").isNull(), none).when(inside, F.lit(o.date_in)).otherwise(F.lit(-o.date_out))
        bonus += F.when(F.size("exts") <= 0, none).when(F.array_contains("exts", F.col("ext")), F.lit(o.type_in)).otherwise(F.lit(-o.type_out))
    return rows.withColumn("bonus", bonus).withColumn("score", F.col("score") * F.greatest(F.lit(0.05), 1 + F.col("bonus"))).select(*[c for c in hits.columns if c not in ("general", "specific")], "bonus", F.coalesce("general", none).alias("general"), F.coalesce("specific", none).alias("specific"))


def order() -> list[Column]:
    """Order of results: score, then the keyword and the vector list, then the id."""
    return [F.desc(F.rint(F.col("score") * 1e9)), F.asc_nulls_last("lex_rank"), F.asc_nulls_last("sem_rank"), F.asc("id")]


def top(hits: DataFrame, limit: int) -> DataFrame:
    """The first limit hits of each query with their place from 0."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order())) - 1).where(F.col("place") < limit)


def rerank(hits: DataFrame, scores: DataFrame, o: Options = Options()) -> DataFrame:
    """Hits with place, their first rerank_top reordered by a second model's scores(qid, id, logit) and their old place.

    The rest keeps its place behind them. Hits without a score count as the least likely.
    """
    head = F.col("place") < o.rerank_top
    likely = F.coalesce(1 / (1 + F.exp(-F.col("logit"))), F.lit(0.0))
    blend = F.when(head, o.rerank_weight * likely + 1 / (F.col("place") + 2))
    rows = hits.join(scores, ["qid", "id"], "left").withColumn("blend", blend)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(head), F.desc_nulls_last(F.rint(F.col("blend") * 1e9)), "place")) - 1
    return rows.withColumn("final_rank", place).drop("logit")


def relax(strict: DataFrame, soft: DataFrame, least: int = 3) -> DataFrame:
    """Strict hits, and for queries with fewer than least of them the soft hits that are not among them, behind."""
    n = strict.groupBy("qid").agg(F.count("*").alias("n"))
    few = soft.join(n, "qid", "left").where(F.coalesce("n", F.lit(0)) < least).drop("n")
    more = few.join(strict.select("qid", "id"), ["qid", "id"], "left_anti")
    return strict.withColumn("relaxed", F.lit(False)).unionByName(more.withColumn("relaxed", F.lit(True)))
