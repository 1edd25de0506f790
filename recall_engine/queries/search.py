"""Queries on the text index, the vectors, their fusion and its ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_engine.functions.vocabulary import NOISY_FOLDERS, ROOT_ALIASES, STOPWORDS
from recall_engine.operators import fusion as R, lexical as L, logs, semantic as S
from recall_engine.operators.catalog import places
from recall_engine.plans.tables import materialize
from recall_engine.queries import NOW, Book, read
from recall_engine.queries.text import fold_sql, folders_sql, split_sql, tokens_sql, words_sql

BOOK = Book()
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

POSTINGS = f"""
tok AS (SELECT 'name' AS field, id AS doc_id, unnest({tokens_sql(split_sql('name'))}) AS term FROM lexical_index
  UNION ALL SELECT 'path', id, unnest({tokens_sql(folders_sql('path'))}) FROM lexical_index
  UNION ALL SELECT 'content', id, unnest({tokens_sql('content')}) FROM lexical_index),
post AS (SELECT field, term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT field, doc_id, sum(tf) AS len FROM post GROUP BY ALL),
stats AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
total AS (SELECT count(*) AS docs FROM lexical_index),
mean AS (SELECT field, sum(len) / (SELECT docs FROM total) AS avg FROM len GROUP BY field)"""

TERMS = f"""
raw AS (SELECT id AS qid, query, {words_sql('query')} AS w FROM searches),
kept AS (SELECT qid, query, CASE WHEN len(list_filter(w, lambda x: NOT list_contains([{_STOP}], x))) > 0 THEN list_filter(w, lambda x: NOT list_contains([{_STOP}], x)) ELSE w END AS w FROM raw),
flat AS (SELECT qid, query, flatten(list_transform(w, lambda x: {tokens_sql('x')})) AS t FROM kept),
spread AS (SELECT qid, query, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM flat),
firsts AS (SELECT qid, query, term, min(pos) AS pos FROM spread GROUP BY ALL),
qt AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS place,
  regexp_matches(query, '[\\p{{L}}\\p{{N}}]$') AND pos = max(pos) OVER (PARTITION BY qid) AS last FROM firsts)"""


def _clauses_sql(fields: dict[str, float], expand: bool) -> str:
    weight = "CASE field " + " ".join(f"WHEN '{f}' THEN CAST({w} AS DOUBLE)" for f, w in fields.items()) + " END"
    inside = ", ".join(f"'{f}'" for f in fields)
    short = ", ".join(f"'{f}'" for f in fields if f != "content")
    sql = f"""
clause AS (
  SELECT qid, place, p.doc_id, p.field, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg)) * {weight.replace('CASE field', 'CASE p.field')} AS score
  FROM qt JOIN post p USING (term) JOIN stats s ON s.field = p.field AND s.term = p.term JOIN len l ON l.field = p.field AND l.doc_id = p.doc_id JOIN mean m ON m.field = p.field, total
  WHERE p.field IN ({inside})"""
    if expand and short:
        sql += f"""
  UNION ALL SELECT qid, place, doc_id, field, {weight} * 0.4 FROM (SELECT DISTINCT qid, place, p.doc_id, p.field FROM qt JOIN post p ON abs(length(qt.term) - length(p.term)) <= 1 AND damerau_levenshtein(qt.term, p.term) <= 1 WHERE length(qt.term) >= 5 AND p.field IN ({short})) x
  UNION ALL SELECT qid, place, doc_id, field, {weight} * 0.7 FROM (SELECT DISTINCT qid, place, p.doc_id, p.field FROM qt JOIN post p ON starts_with(p.term, qt.term) WHERE qt.last AND length(qt.term) >= 2 AND p.field IN ({short})) x"""
    return (
        sql
        + """),
word AS (SELECT qid, doc_id, place, max(score) AS best, sum(score) AS every FROM clause GROUP BY ALL),
scored AS (SELECT qid, doc_id, sum(best + 0.2 * (every - best)) AS score FROM word GROUP BY ALL)"""
    )


def _ranked_sql(limit: int, source: str = "scored", where: str = "") -> str:
    return f"SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM {source} {where}) r WHERE rank < {limit}"


def _index(spark, d, stem=False) -> L.TextIndex:
    return L.cached(spark, f"{d}/lexical_index.parquet", stem)


def _queries(spark, d):
    return read(spark, d, "searches").select(F.col("id").alias("qid"), F.col("query").alias("text"))


def _out(df):
    return df.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _search_sql(fields: dict[str, float], expand: bool, limit: int, where: str = "") -> str:
    return f"WITH {POSTINGS}, {TERMS}, {_clauses_sql(fields, expand)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM ({_ranked_sql(limit, where=where)}) z"


ALL_FIELDS = {"name": 3.0, "path": 1.5, "content": 1.0}


@BOOK.add(f"WITH {POSTINGS} SELECT s.field, count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, max(df) AS most, round(any_value(avg), 6) AS mean_length FROM stats s JOIN mean USING (field) GROUP BY s.field")
def term_stats(spark, d):
    index = _index(spark, d)
    lengths = index.postings.groupBy("field", "doc_id").agg(F.max("len").alias("len"))
    mean = lengths.groupBy("field").agg(F.round(F.sum("len") / index.docs, 6).alias("mean_length"))
    return index.stats.groupBy("field").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("most")).join(mean, "field")


@BOOK.add(f"WITH {TERMS} SELECT qid, place, term, last FROM qt")
def query_terms(spark, d):
    return L.query_terms(_queries(spark, d)).withColumn("place", F.col("place").cast("long"))


@BOOK.add(_search_sql({"content": 1.0}, False, 20))
def bm25_content(spark, d):
    return _out(L.search(_index(spark, d), _queries(spark, d), L.Weights(0, 0, 1.0), 20))


@BOOK.add(_search_sql(ALL_FIELDS, False, 50))
def bm25_fields(spark, d):
    return _out(L.search(_index(spark, d), _queries(spark, d), limit=50, fuzzy=False, prefix=False))


@BOOK.add(_search_sql(ALL_FIELDS, True, 200))
def bm25_top200(spark, d):
    return _out(L.search(_index(spark, d), _queries(spark, d)))


@BOOK.add(_search_sql({"name": 3.0, "path": 1.5}, True, 50))
def bm25_names(spark, d):
    return _out(L.search(_index(spark, d), _queries(spark, d), L.Weights(content=0.0), 50))


@BOOK.add(_search_sql(ALL_FIELDS, True, 50, "WHERE doc_id IN (SELECT id FROM files WHERE ext IN ('pdf', 'docx'))"))
def bm25_ext_filtered(spark, d):
    allowed = read(spark, d, "files").where("ext in ('pdf', 'docx')").select("id")
    return _out(L.search(_index(spark, d), _queries(spark, d), limit=50, allowed=allowed))


@BOOK.add()
def bm25_stemmed(spark, d):
    return _out(L.search(_index(spark, d, True), _queries(spark, d), limit=50, stem=True))


_ROWS = "SELECT p.field, p.term, p.doc_id, p.tf, l.len, s.df FROM post p JOIN len l ON l.field = p.field AND l.doc_id = p.doc_id JOIN stats s ON s.field = p.field AND s.term = p.term"


def _rows(index):
    return index.postings.join(index.stats, ["field", "term"]).select("field", "term", "doc_id", F.col("tf").cast("long").alias("tf"), "len", "df")


@BOOK.add(f"WITH gone AS (SELECT id FROM files WHERE ext = 'txt'), {POSTINGS.replace('FROM lexical_index', 'FROM (SELECT * FROM lexical_index WHERE id NOT IN (SELECT id FROM gone))')} {_ROWS}")
def index_delete(spark, d):
    return _rows(L.delete(_index(spark, d), read(spark, d, "files").where("ext = 'txt'").select("id")))


@BOOK.add("WITH " + POSTINGS.replace("FROM lexical_index", "FROM (SELECT id, CASE WHEN ext = 'md' THEN 'note ' || name ELSE name END AS name, path, content, ext FROM lexical_index)") + f" {_ROWS}")
def index_upsert(spark, d):
    changed = read(spark, d, "lexical_index").where("ext = 'md'").select("id", F.concat(F.lit("note "), "name").alias("name"), "path", "content")
    return _rows(L.upsert(_index(spark, d), changed))


@BOOK.add(_search_sql(ALL_FIELDS, True, 50) + " WHERE doc_id IN (SELECT id FROM files WHERE ext IN ('pdf', 'docx'))")
def bm25_filtered_after(spark, d):
    """The filter after the limit: what is left of the fifty best."""
    allowed = read(spark, d, "files").where("ext in ('pdf', 'docx')").select("id")
    return _out(L.search(_index(spark, d), _queries(spark, d), limit=50, allowed=allowed, post_filter=True))


# ---------------------------------------------------------------- vectors. No model turns a query into a vector here:
# the vector of the row that has the search's number stands in for it.

_NORM = "sqrt(list_inner_product({0}, {0}))"
_D = "list_transform(q, lambda x: CAST(x AS DOUBLE))"
COSINES = f"""
v AS (SELECT row, file_id, is_name, {_D} AS q FROM vectors WHERE file_id >= 0 AND list_max(list_transform(q, lambda x: abs(x))) > 0),
asked AS (SELECT s.id AS qid, {_D} AS q FROM searches s JOIN vectors x ON x.row = s.id WHERE list_max(list_transform(x.q, lambda y: abs(y))) > 0),
cosine AS (SELECT qid, v.row, v.file_id, is_name, list_inner_product(a.q, v.q) / ({_NORM.format('a.q')} * {_NORM.format('v.q')}) AS cos FROM asked a, v),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 6) DESC, row) AS place FROM cosine) r WHERE place <= 300),
best AS (SELECT *, max(cos) OVER (PARTITION BY qid, file_id) AS top FROM top),
filed AS (SELECT qid, file_id, max(cos) AS cos, min(row) FILTER (WHERE cos = top) AS best_row, count(*) FILTER (WHERE cos > top - 0.02) AS near FROM best GROUP BY ALL),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 6) DESC, file_id) - 1 AS rank FROM filed) r WHERE rank < 150)"""


def _asked(spark, d):
    rows = read(spark, d, "vectors").select(F.col("row").alias("qid"), "q")
    return read(spark, d, "searches").select(F.col("id").alias("qid")).join(rows, "qid")


@BOOK.add(f"WITH {COSINES} SELECT qid, row, file_id, round(cos, 6) AS cos FROM top")
def cosine_topk(spark, d):
    rows = S.top_rows(S.searchable(read(spark, d, "vectors")), _asked(spark, d))
    return rows.select("qid", "row", "file_id", F.round("cos", 6).alias("cos"))


@BOOK.add(f"WITH {COSINES} SELECT qid, row, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 6) DESC, row) AS n FROM cosine WHERE is_name AND file_id IN (SELECT id FROM files WHERE ext = 'pdf')) r WHERE n <= 10")
def cosine_names_of_pdf(spark, d):
    allowed = read(spark, d, "files").where("ext = 'pdf'").select("id")
    return S.top_rows(S.searchable(read(spark, d, "vectors"), content=False), _asked(spark, d), 10, allowed).select("qid", "row", F.round("cos", 6).alias("cos"))


@BOOK.add(f"WITH {COSINES} SELECT qid, file_id, round(cos, 6) AS cos, best_row, near, rank FROM sem")
def per_file_top(spark, d):
    rows = S.per_file(S.top_rows(S.searchable(read(spark, d, "vectors")), _asked(spark, d)))
    return rows.select("qid", "file_id", F.round("cos", 6).alias("cos"), "best_row", "near", F.col("rank").cast("long").alias("rank"))


@BOOK.add(f"SELECT row, round({_NORM.format(_D)} * CAST(scale AS DOUBLE), 5) AS norm FROM vectors WHERE q IS NOT NULL")
def vector_norms(spark, d):
    return read(spark, d, "vectors").where("q is not null").select("row", F.round(S.norm(S.dequantise(F.col("q"), F.col("scale"))), 5).alias("norm"))


@BOOK.add("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, v, greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-9) AS m FROM e)
SELECT vec_id, list_transform(v, lambda x: CAST(round_even(x / m * 127, 0) AS INT)) AS q, round(m / 127, 7) AS scale FROM m""")
def quantise(spark, d):
    q, scale = S.quantise(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", q.cast("array<int>").alias("q"), F.round(scale.cast("double"), 7).alias("scale"))


@BOOK.add("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, v, greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-9) AS m FROM e)
SELECT count(*) AS n, count(*) FILTER (WHERE list_max(list_transform(v, lambda x: abs(x - round_even(x / m * 127, 0) * m / 127))) <= m / 254 + 1e-6) AS within FROM m""")
def quantisation_error(spark, d):
    """How many vectors come back within half a step of their scale."""
    q, scale = S.quantise(F.col("embedding"))
    rows = read(spark, d, "embeddings").select("embedding", q.alias("q"), scale.alias("scale"))
    off = F.array_max(F.zip_with("embedding", S.dequantise(F.col("q"), F.col("scale")), lambda a, b: F.abs(a.cast("double") - b)))
    return rows.agg(F.count("*").alias("n"), F.count_if(off <= F.col("scale") / 2 + 1e-6).alias("within"))


@BOOK.add("""WITH e AS (SELECT vec_id // 4 AS g, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id % 3 <> 0),
  m AS (SELECT g, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY g, i), n AS (SELECT g, sqrt(sum(x * x)) AS n FROM m GROUP BY g)
SELECT g, list(round(CAST(CAST(x / greatest(n, 1e-12) AS FLOAT) AS DOUBLE), 4) + 0.0 ORDER BY i) AS pooled FROM m JOIN n USING (g) GROUP BY g""")
def mean_pool(spark, d):
    """Vectors of four rows each pooled to one; every third row is masked."""
    rows = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("g"), F.struct("vec_id", "embedding", (F.col("vec_id") % 3 != 0).cast("int").alias("m")).alias("x"))
    grouped = rows.groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pooled = S.mean_pool(F.col("x.embedding"), F.col("x.m"))
    return grouped.select("g", F.transform(pooled, lambda v: F.round(v.cast("double"), 4) + F.lit(0.0)).alias("pooled")).where("pooled is not null")


# ---------------------------------------------------------------- fusion

_HITS = "(SELECT search_id AS qid, id, min(lex_rank) AS lex_rank, min(sem_rank) AS sem_rank, max(best_row) AS best_row FROM hits GROUP BY search_id, id)"


@BOOK.add(f"SELECT qid, id, round(coalesce(1.0 / (20 + lex_rank + 1), 0) + coalesce(1.0 / (20 + sem_rank + 1), 0), 9) AS score FROM {_HITS} h WHERE lex_rank IS NOT NULL OR sem_rank IS NOT NULL")
def rrf_fusion(spark, d):
    """The two lists of each search, fused by rank."""
    hits = read(spark, d, "hits").groupBy(F.col("search_id").alias("qid"), "id").agg(F.min("lex_rank").alias("lex_rank"), F.min("sem_rank").alias("sem_rank"), F.max("best_row").alias("best_row"))
    lex = hits.where("lex_rank is not null").select("qid", F.col("id").alias("doc_id"), F.col("lex_rank").alias("rank"))
    sem = hits.where("sem_rank is not null").select("qid", F.col("id").alias("file_id"), F.col("sem_rank").alias("rank"), "best_row", F.lit(1).alias("near"), F.lit(None).cast("double").alias("cos"))
    return R.fuse(lex, sem).select("qid", "id", F.round("score", 9).alias("score"))


_FUSED = f"""
lex AS ({_ranked_sql(200)}),
listed AS (SELECT qid, doc_id AS id, 1.0 / (20 + rank + 1) AS score, rank AS lex_rank, NULL AS sem_rank, NULL AS best_row, NULL AS cos FROM lex
  UNION ALL SELECT qid, file_id, (1 + 0.05 * least(near - 1, 5)) / (20 + rank + 1), NULL, rank, best_row, cos FROM sem),
fused AS (SELECT qid, id, sum(score) AS score, min(lex_rank) AS lex_rank, min(sem_rank) AS sem_rank, max(best_row) AS best_row, max(cos) AS cos FROM listed GROUP BY ALL),
cut AS (SELECT * FROM (SELECT *, max(cos) OVER (PARTITION BY qid) AS best_cos FROM fused) f WHERE lex_rank IS NOT NULL OR cos IS NULL OR cos >= best_cos - 0.03)"""


def _lists(spark, d, o: R.Options = R.Options()):
    queries = _queries(spark, d)
    lex = L.search(_index(spark, d), queries, o.weights())
    sem = S.per_file(S.top_rows(S.searchable(read(spark, d, "vectors")), _asked(spark, d)))
    return lex, sem


@BOOK.add(f"WITH {POSTINGS}, {TERMS}, {_clauses_sql(ALL_FIELDS, True)}, {COSINES}, {_FUSED} SELECT qid, id, round(score, 9) AS score, lex_rank, sem_rank FROM cut")
def margin_cut(spark, d):
    fused = R.cut_margin(R.fuse(*_lists(spark, d)))
    return fused.select("qid", "id", F.round("score", 9).alias("score"), F.col("lex_rank").cast("long").alias("lex_rank"), F.col("sem_rank").cast("long").alias("sem_rank"))


_CLICKS = f"""
click AS (SELECT DISTINCT ON (id) id, epoch(ts) AS clicked, file_id, trim({fold_sql('query')}) AS q FROM clicks),
general AS (SELECT file_id AS id, sum(0.3 * exp(-({NOW} - clicked) / 86400.0 / 30)) AS general FROM click WHERE clicked > {NOW - 365 * 86400} GROUP BY file_id),
wanted AS (SELECT id AS qid, trim({fold_sql('query')}) AS key FROM searches),
specific AS (SELECT qid, c.file_id AS id, 0.5 * count(*) AS specific FROM wanted w JOIN click c ON c.q = w.key OR (length(w.key) >= 4 AND starts_with(c.q, w.key)) WHERE w.key <> '' AND clicked > {NOW - 365 * 86400} GROUP BY ALL)"""


@BOOK.add(f"WITH {_CLICKS} SELECT id, round(general, 9) AS general FROM general")
def frecency_general(spark, d):
    return logs.general_use(read(spark, d, "clicks"), NOW).withColumn("general", F.round("general", 9))


@BOOK.add(f"WITH {_CLICKS} SELECT qid, id, CAST(specific AS DOUBLE) AS specific FROM specific")
def frecency_specific(spark, d):
    return logs.specific_use(read(spark, d, "clicks"), _queries(spark, d), NOW)


@BOOK.add(f"WITH {_CLICKS} SELECT h.qid, h.id, round(least(0.4, 0.4 * (coalesce(general, 0) + 3 * coalesce(specific, 0))), 9) AS bonus FROM {_HITS} h LEFT JOIN general USING (id) LEFT JOIN specific s ON s.qid = h.qid AND s.id = h.id")
def frecency_capped(spark, d):
    hits = read(spark, d, "hits").select(F.col("search_id").alias("qid"), "id").distinct()
    used = logs.use(read(spark, d, "clicks"), _queries(spark, d), hits, NOW)
    return used.select("qid", "id", F.round(F.least(F.lit(0.4), 0.4 * (F.coalesce("general", F.lit(0.0)) + 3 * F.coalesce("specific", F.lit(0.0)))), 9).alias("bonus"))


_ALIAS = "CASE root " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROOT_ALIASES.items()) + " ELSE root END"
_STEM = "CASE WHEN contains(name, '.') THEN regexp_replace(name, '[.][^.]*$', '') ELSE name END"


def _signals_sql(source: str, parsed: str) -> str:
    """Signals of hits in source(qid, id, score, ...) with parsed(qid, exts, date_from, date_to, year_hint, name_terms, recent)."""
    noisy = ", ".join(f"'{x}'" for x in NOISY_FOLDERS)
    return f"""
qw AS (SELECT r.qid, list_filter(r.w, lambda x: NOT list_contains([{_STOP}], x)) AS q_words, coalesce((SELECT list(term) FROM qt WHERE qt.qid = r.qid), []) AS q_terms FROM raw r),
joined AS (SELECT h.*, f.name, f.ext, f.root, f.rel_parent, f.mtime, f.ctime, f.last_used, q_words, q_terms, p.exts, p.date_from, p.date_to, p.year_hint, p.name_terms, p.recent, coalesce(g.general, 0) AS general, coalesce(s.specific, 0) AS specific,
    {tokens_sql(split_sql(_STEM))} AS name_t, {tokens_sql(split_sql("replace(rel_parent, '/', ' ')") + " || ' ' || " + _ALIAS)} AS folder_t, {words_sql('name')} AS name_w,
    list_transform(string_split(rel_parent, '/'), lambda x: {fold_sql('x')}) AS folders
  FROM {source} h JOIN files f USING (id) JOIN qw ON qw.qid = h.qid JOIN {parsed} p ON p.qid = h.qid LEFT JOIN general g ON g.id = h.id LEFT JOIN specific s ON s.qid = h.qid AND s.id = h.id),
signal AS (SELECT *,
    0.15 * exp(-greatest({NOW} - mtime, 0) / 86400.0 / 120)
    + CASE WHEN last_used IS NOT NULL AND last_used <> 0 THEN 0.15 * exp(-greatest({NOW} - last_used, 0) / 86400.0 / 60) ELSE 0 END
    + CASE WHEN recent THEN 0.5 * exp(-greatest({NOW} - mtime, 0) / 86400.0 / 30) ELSE 0 END
    + CASE WHEN (len(q_terms) > 0 AND len(list_filter(q_terms, lambda x: NOT list_contains(name_t, x))) = 0) OR (len(q_words) > 0 AND len(list_filter(q_words, lambda x: NOT list_contains(name_w, x))) = 0) THEN 0.3 ELSE 0 END
    + CASE WHEN len(q_terms) > 0 THEN 0.3 * len(list_filter(q_terms, lambda x: list_contains(name_t, x) OR list_contains(folder_t, x))) / len(q_terms) ELSE 0 END
    - CASE WHEN list_has_any(folders, [{noisy}]) AND NOT list_has_any(folders, q_words) THEN 0.15 ELSE 0 END
    - CASE WHEN regexp_matches(name, '(?i)(?: \\(\\d+\\)| copie(?: \\d+)?| copy(?: \\d+)?)\\.[^.]+$') THEN 0.1 ELSE 0 END
    - 0.02 * greatest(CASE WHEN rel_parent = '' THEN 0 ELSE len(string_split(rel_parent, '/')) END - 6, 0)
    + CASE WHEN year_hint IS NOT NULL AND (contains(name, CAST(year_hint AS VARCHAR)) OR contains(rel_parent, CAST(year_hint AS VARCHAR)) OR year(make_timestamp(CAST(floor(mtime) * 1000000 AS BIGINT))) = year_hint) THEN 0.3 ELSE 0 END
    + least(0.4, 0.4 * (general + 3 * specific))
    + CASE WHEN date_from IS NULL THEN 0 WHEN (mtime >= date_from AND mtime < date_to) OR (coalesce(last_used, 0) >= date_from AND coalesce(last_used, 0) < date_to) OR (ctime >= date_from AND ctime < date_to)
        OR (name_terms <> '' AND contains(regexp_replace(name, '[_-]', '', 'g'), replace(name_terms, ' ', ''))) THEN 0.4 ELSE -0.2 END
    + CASE WHEN len(exts) = 0 THEN 0 WHEN list_contains(exts, ext) THEN 0.4 ELSE -0.2 END AS bonus
  FROM joined),
final AS (SELECT *, score * greatest(0.05, 1 + bonus) AS value FROM signal)"""


_PARSED_LITERAL = f"(SELECT id AS qid, CASE WHEN id % 2 = 0 THEN ['pdf', 'docx'] ELSE [] END AS exts, CASE WHEN id % 3 = 0 THEN {NOW - 300 * 86400} END AS date_from, CASE WHEN id % 3 = 0 THEN {NOW - 30 * 86400} END AS date_to, CASE WHEN id % 5 = 0 THEN 2023 END AS year_hint, CASE WHEN id % 3 = 0 THEN '2023 05' ELSE '' END AS name_terms, id % 4 = 0 AS recent FROM searches)"
_PARSED_NONE = "(SELECT id AS qid, CAST([] AS VARCHAR[]) AS exts, CAST(NULL AS DOUBLE) AS date_from, CAST(NULL AS DOUBLE) AS date_to, CAST(NULL AS INT) AS year_hint, '' AS name_terms, false AS recent FROM searches)"


def _with_literals(spark, d):
    q = _queries(spark, d)
    third = F.col("qid") % 3 == 0
    return q.select(
        "qid", "text", F.when(F.col("qid") % 2 == 0, F.array(F.lit("pdf"), F.lit("docx"))).otherwise(F.array().cast("array<string>")).alias("exts"),
        F.when(third, F.lit(NOW - 300 * 86400)).alias("date_from"), F.when(third, F.lit(NOW - 30 * 86400)).alias("date_to"),
        F.when(F.col("qid") % 5 == 0, 2023).alias("year_hint"), F.when(third, "2023 05").otherwise("").alias("name_terms"), (F.col("qid") % 4 == 0).alias("recent"),
    )


def unparsed(queries):
    """Queries searched as they are, without dates and types."""
    none = {"exts": F.array().cast("array<string>"), "date_from": F.lit(None).cast("double"), "date_to": F.lit(None).cast("double"), "year_hint": F.lit(None).cast("int"), "name_terms": F.lit(""), "recent": F.lit(False)}
    return queries.withColumns(none)


_ONE_HITS = "(SELECT search_id AS qid, id, min(lex_rank) AS lex_rank, min(sem_rank) AS sem_rank, max(score) AS score FROM hits WHERE score IS NOT NULL GROUP BY search_id, id)"


@BOOK.add(f"WITH {TERMS}, {_CLICKS}, {_signals_sql(_ONE_HITS, _PARSED_LITERAL)} SELECT qid, id, round(bonus, 6) AS bonus, round(value, 6) AS score FROM final")
def signals_all(spark, d):
    """Every ranking signal on the logged hits; dates, types and years are given, so that SQL can follow."""
    hits = read(spark, d, "hits").where("score is not null").groupBy(F.col("search_id").alias("qid"), "id").agg(F.min("lex_rank").alias("lex_rank"), F.min("sem_rank").alias("sem_rank"), F.max("score").alias("score"))
    clicks = logs.use(read(spark, d, "clicks"), _queries(spark, d), hits, NOW)
    rows = R.signals(hits, read(spark, d, "files"), _with_literals(spark, d), NOW, clicks=clicks)
    return rows.select("qid", "id", F.round("bonus", 6).alias("bonus"), F.round("score", 6).alias("score"))


def hybrid(spark, d, o: R.Options = R.Options(), queries=None):
    """The hits of every logged search: keywords and vectors, fused, cut and ranked by the signals."""
    asked = unparsed(_queries(spark, d)) if queries is None else queries
    fused = R.cut_margin(R.fuse(*_lists(spark, d, o), o), o.sem_only_margin)
    fused = materialize(fused.select("qid", "id", "score", "lex_rank", "sem_rank"), "fused")
    used = logs.with_use(fused, read(spark, d, "clicks"), asked, NOW)
    return R.top(R.signals(used, read(spark, d, "files"), asked, NOW, o), o.limit)


_TOP30 = "ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(value, 9) DESC, lex_rank ASC NULLS LAST, sem_rank ASC NULLS LAST, id) - 1 AS place FROM final) r WHERE place < 30)"
_HYBRID = f"WITH {POSTINGS}, {TERMS}, {_clauses_sql(ALL_FIELDS, True)}, {COSINES}, {_FUSED}, {_CLICKS}, {_signals_sql('cut', _PARSED_NONE)}, {_TOP30}"


@BOOK.add(f"{_HYBRID} SELECT qid, place, id, round(value, 6) AS score, lex_rank, sem_rank FROM ranked")
def hybrid_search(spark, d):
    hits = hybrid(spark, d)
    return hits.select("qid", F.col("place").cast("long").alias("place"), "id", F.round("score", 6).alias("score"), F.col("lex_rank").cast("long").alias("lex_rank"), F.col("sem_rank").cast("long").alias("sem_rank"))


@BOOK.add(f"""{_HYBRID}, blended AS (SELECT qid, id, place, CASE WHEN place < 10 THEN 1 / (1 + exp(-(CAST(id % 7 AS DOUBLE) - 3))) + 1.0 / (place + 2) END AS blend FROM ranked)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place < 10 DESC, round(blend, 9) DESC NULLS LAST, place) - 1 AS final_rank FROM blended""")
def rerank_blend(spark, d):
    """The head of the list reordered by a second score; a function of the id stands in for the model."""
    hits = hybrid(spark, d)
    stand_in = hits.select("qid", "id", (F.col("id") % 7 - 3).cast("double").alias("logit"))
    return R.rerank(hits, stand_in).select("qid", "id", F.col("final_rank").cast("long").alias("final_rank"))


@BOOK.add("""WITH h AS (SELECT search_id AS qid, id, max(score) AS score FROM hits WHERE score IS NOT NULL GROUP BY ALL), s AS (SELECT h.* FROM h JOIN files f USING (id) WHERE ext = 'pdf'),
few AS (SELECT qid FROM h EXCEPT SELECT qid FROM s GROUP BY qid HAVING count(*) >= 3)
SELECT qid, id, false AS relaxed FROM s UNION ALL SELECT h.qid, h.id, true FROM h JOIN few USING (qid) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.qid = h.qid AND s.id = h.id)""")
def strict_then_relaxed(spark, d):
    soft = read(spark, d, "hits").where("score is not null").groupBy(F.col("search_id").alias("qid"), "id").agg(F.max("score").alias("score"))
    strict = soft.join(read(spark, d, "files").where("ext = 'pdf'").select("id"), "id", "left_semi").select(*soft.columns)
    return R.relax(strict, soft).select("qid", "id", "relaxed")


@BOOK.add("""WITH h AS (SELECT search_id AS qid, id, max(score) AS score FROM hits GROUP BY ALL)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, id) - 1 AS place FROM h JOIN files USING (id)""")
def hits_with_files(spark, d):
    """Hits of files that are there, by logged score."""
    h = read(spark, d, "hits").groupBy(F.col("search_id").alias("qid"), "id").agg(F.max("score").alias("score"))
    known = h.join(read(spark, d, "files").select("id"), "id")
    ordered = known.withColumn("behind", F.coalesce(-F.col("score"), F.lit(float("inf"))))
    return places(ordered, "qid", ["behind", "id"]).select("qid", "id", F.col("place").cast("long").alias("place"))
