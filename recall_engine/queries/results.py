"""Queries on results and logs: reasons, excerpts, quality, exports, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_engine.functions.text import query_words
from recall_engine.functions.vocabulary import SENSITIVE
from recall_engine.operators import evaluate as E, logs, present as P
from recall_engine.queries import NOW, Book, read
from recall_engine.queries.search import _ALIAS, _CLICKS, _HITS, _queries, hits_with_files
from recall_engine.queries.search import TERMS, split_sql, tokens_sql
from recall_engine.queries.text import _WS
from recall_engine.streaming import watch

BOOK = Book()
_SENSITIVE = "|".join(SENSITIVE).replace("'", "''")


def _logged(spark, d):
    h = read(spark, d, "hits").groupBy(F.col("search_id").alias("qid"), "id")
    return h.agg(F.min("lex_rank").alias("lex_rank"), F.min("sem_rank").alias("sem_rank"), F.max("best_row").alias("best_row"))


@BOOK.add(f"""WITH {TERMS}, {_CLICKS}, j AS (
  SELECT h.qid, h.id, h.lex_rank, h.sem_rank, f.status, coalesce((SELECT list(term) FROM qt WHERE qt.qid = h.qid), []) AS t, coalesce(general, 0) + coalesce(specific, 0) AS used,
    {tokens_sql(split_sql('name'))} AS name_t, {tokens_sql(split_sql("replace(rel_parent, '/', ' ')") + " || ' ' || " + _ALIAS)} AS folder_t
  FROM {_HITS} h JOIN files f USING (id) LEFT JOIN general g ON g.id = h.id LEFT JOIN specific s ON s.qid = h.qid AND s.id = h.id)
SELECT qid, id, CASE WHEN len(t) = 0 THEN [] ELSE list_filter([CASE WHEN list_has_any(t, name_t) THEN 'name' END, CASE WHEN list_has_any(t, folder_t) THEN 'folder' END,
  CASE WHEN lex_rank IS NOT NULL AND NOT list_has_any(t, name_t) AND NOT list_has_any(t, folder_t) AND status = 'ok' THEN 'content' END, CASE WHEN sem_rank < 10 THEN 'meaning' END, CASE WHEN used > 0 THEN 'history' END], lambda x: x IS NOT NULL) END AS reasons FROM j""")
def explain_reasons(spark, d):
    hits = _logged(spark, d)
    used = logs.use(read(spark, d, "clicks"), _queries(spark, d), hits, NOW)
    return P.explain(hits.join(used, ["qid", "id"]), read(spark, d, "files"), _queries(spark, d))


_PLAIN = ("".join(x for letters in P.LETTERS.values() for x in letters), "".join(plain for plain, letters in P.LETTERS.items() for _ in letters))


_LOWER = f"translate(lower({{0}}), '{_PLAIN[0]}', '{_PLAIN[1]}')"
_JUNK = "[\\x{0000}\\x{e000}-\\x{f8ff}\\x{fffd}\\x{fffe}\\x{ffff}]"


@BOOK.add(f"""WITH {TERMS}, asked AS (SELECT qid, list(term) FILTER (WHERE length(term) >= 2) AS t FROM qt GROUP BY qid),
  j AS (SELECT h.qid, h.id, coalesce(l.content, '') AS x, t, CASE WHEN sem_rank IS NOT NULL AND (lex_rank IS NULL OR sem_rank < lex_rank) THEN c.start END AS cs
    FROM {_HITS} h JOIN searches s ON s.id = h.qid LEFT JOIN (SELECT l.id, l.content FROM lexical_index l JOIN files f ON f.id = l.id AND f.status = 'ok') l ON l.id = h.id
    LEFT JOIN chunks c ON c.row = h.best_row AND c."end" > 0 LEFT JOIN asked a ON a.qid = h.qid),
  p AS (SELECT *, CASE WHEN cs IS NOT NULL THEN cs WHEN t IS NULL THEN 0
    ELSE greatest(0, length(regexp_extract({_LOWER.format('x')}, '(?s)^((?:|.*?[^\\p{{L}}\\p{{N}}]))(?:' || array_to_string(t, '|') || ')', 1)) - 73) END AS p0 FROM j),
  q AS (SELECT *, CASE WHEN p0 > 0 THEN p0 + instr(substr(x, p0 + 1, 30), ' ') ELSE p0 END AS p1 FROM p),
  r AS (SELECT *, substr(x, p1 + 1, 220) AS shown, p1 + 220 < length(x) AS more FROM q),
  c AS (SELECT *, length(regexp_extract(shown, '(?s)^.* ')) - 1 AS cut FROM r),
  w AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN more AND cut > 154 THEN substr(shown, 1, cut) ELSE shown END, '{_JUNK}', ' ', 'g'), '{_WS}+', ' ', 'g')) AS line FROM c)
SELECT qid, id, CASE WHEN x = '' THEN '' ELSE CASE WHEN p1 > 0 THEN '… ' ELSE '' END || line || CASE WHEN more THEN ' …' ELSE '' END END AS text,
  CASE WHEN x = '' OR t IS NULL THEN 0 ELSE len(list_filter(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}]+'), lambda v: len(list_filter(t, lambda y: starts_with({_LOWER.format('v')}, y))) > 0)) END AS marks FROM w""")
def snippets(spark, d):
    """The excerpt of every logged hit, and how many words are lit up in it."""
    rows = P.snippets(_logged(spark, d), read(spark, d, "lexical_index"), read(spark, d, "files"), read(spark, d, "chunks"), _queries(spark, d))
    return rows.select("qid", "id", "snippet.text", F.size("snippet.ranges").cast("long").alias("marks"))


@BOOK.add(f"""WITH {TERMS}, asked AS (SELECT qid, list(term) FILTER (WHERE length(term) >= 2) AS t FROM qt GROUP BY qid),
  named AS (SELECT h.qid, h.id, regexp_extract_all(f.name, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS p FROM {_HITS} h JOIN files f USING (id)),
  piece AS (SELECT qid, id, unnest(p) AS p, unnest(range(1, len(p) + 1)) AS i FROM named),
  placed AS (SELECT *, sum(length(p)) OVER (PARTITION BY qid, id ORDER BY i) AS upto FROM piece)
SELECT qid, id, CAST(upto - length(p) AS INT) AS start, CAST(upto AS INT) AS "end" FROM placed JOIN asked USING (qid)
WHERE regexp_matches(p, '^[\\p{{L}}\\p{{N}}]') AND len(list_filter(t, lambda x: starts_with(translate(lower(p), '{_PLAIN[0]}', '{_PLAIN[1]}'), x))) > 0""")
def highlights(spark, d):
    """Every word of the names of logged hits that begins with a word of the search."""
    rows = _logged(spark, d).join(read(spark, d, "files").select("id", "name"), "id").join(_queries(spark, d).select("qid", query_words("text").alias("terms")), "qid")
    return rows.select("qid", "id", F.inline(P.highlights("name", "terms")))


@BOOK.add("""WITH h AS (SELECT search_id AS qid, id, min(best_row) AS best_row FROM hits GROUP BY ALL)
SELECT qid, h.id, f.name || ' — ' || CASE WHEN f.root <> '' THEN '~/' || f.root ELSE '' END || CASE WHEN rel_parent <> '' THEN '/' || rel_parent ELSE '' END || chr(10) ||
  substr(CASE WHEN length(coalesce(substr(l.content, c.start + 1, c."end" - c.start), '')) > 0 THEN substr(l.content, c.start + 1, c."end" - c.start) WHEN f.status = 'ok' THEN coalesce(l.content, '') ELSE '' END, 1, 150) AS passage
FROM h JOIN files f USING (id) LEFT JOIN lexical_index l USING (id) LEFT JOIN chunks c ON c.row = h.best_row AND c."end" > 0""")
def rerank_passages(spark, d):
    h = read(spark, d, "hits").groupBy(F.col("search_id").alias("qid"), "id").agg(F.min("best_row").alias("best_row"))
    return P.passages(h, read(spark, d, "files"), read(spark, d, "lexical_index"), read(spark, d, "chunks")).select("qid", "id", "passage")


@BOOK.add(f"""WITH h AS (SELECT search_id AS qid, id, max(score) AS score, min(lex_rank) AS lex_rank, min(sem_rank) AS sem_rank FROM hits GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, id) - 1 AS place, id, name, path,
  CASE WHEN root <> '' THEN '~/' || root ELSE '' END || CASE WHEN rel_parent <> '' THEN '/' || rel_parent ELSE '' END AS parent, ext, kind, size, mtime, last_used, dataless, status, lex_rank, sem_rank, CAST(round(CAST(score AS DECIMAL(30, 12)), 5) AS DOUBLE) AS score
FROM h JOIN files USING (id)""")
def results_json(spark, d):
    """Results as JSON objects, read again."""
    h = read(spark, d, "hits").groupBy(F.col("search_id").alias("qid"), "id").agg(F.max("score").alias("score"), F.min("lex_rank").alias("lex_rank"), F.min("sem_rank").alias("sem_rank"))
    rows = P.result_json(h.join(hits_with_files(spark, d), ["qid", "id"]), read(spark, d, "files"))
    fields = "id long, name string, path string, parent string, ext string, kind string, size long, mtime double, last_used double, dataless boolean, status string, lex_rank int, sem_rank int, score double"
    return rows.select("qid", "place", F.from_json("result", fields).alias("r")).select("qid", "place", "r.*")


# ---------------------------------------------------------------- evaluation: a search expects the files that were opened after its words

_EXPECTED = "expected AS (SELECT DISTINCT s.id AS qid, f.id FROM searches s JOIN clicks c ON trim(lower(c.query)) = trim(lower(s.query)) JOIN files f ON f.path = c.path WHERE c.action IN ('open', 'reveal', 'copy') AND c.query <> '')"
_RANKS = f"""WITH {_EXPECTED}, h AS (SELECT search_id AS qid, id, max(score) AS score FROM hits GROUP BY ALL),
placed AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, id) - 1 AS place FROM h JOIN files USING (id)),
ranks AS (SELECT q.qid, min(p.place) AS rank FROM (SELECT DISTINCT qid FROM expected) q LEFT JOIN expected e ON e.qid = q.qid LEFT JOIN placed p ON p.qid = e.qid AND p.id = e.id GROUP BY q.qid)"""


def _ranks(spark, d):
    key = lambda c: F.trim(F.lower(c))
    clicked = logs.answered_queries(read(spark, d, "clicks")).select(key(F.col("query")).alias("key"), "path")
    queries = read(spark, d, "searches").select(F.col("id").alias("qid"), key(F.col("query")).alias("key")).join(clicked, "key").groupBy("qid").agg(F.collect_set("path").alias("expected"))
    expected = E.expected_ids(queries, read(spark, d, "files"))
    return E.first_ranks(hits_with_files(spark, d), expected)


@BOOK.add(f"{_RANKS} SELECT qid, rank FROM ranks")
def first_expected_rank(spark, d):
    return _ranks(spark, d)


@BOOK.add(f"{_RANKS} SELECT count(*) AS n, round(avg(coalesce(1.0 / (rank + 1), 0)), 9) AS mrr, round(avg(CASE WHEN rank < 1 THEN 1.0 ELSE 0 END), 9) AS r1, round(avg(CASE WHEN rank < 3 THEN 1.0 ELSE 0 END), 9) AS r3, round(avg(CASE WHEN rank < 10 THEN 1.0 ELSE 0 END), 9) AS r10 FROM ranks")
def eval_quality(spark, d):
    q = E.quality(_ranks(spark, d))
    return q.select("n", *[F.round(c, 9).alias(c) for c in ("mrr", "r1", "r3", "r10")])


@BOOK.add(f"""{_RANKS}, two AS (SELECT 'logged' AS variant, qid, rank FROM ranks UNION ALL SELECT 'keywords', q.qid, min(h.lex_rank) FROM (SELECT DISTINCT qid FROM expected) q LEFT JOIN expected e ON e.qid = q.qid LEFT JOIN hits h ON h.search_id = e.qid AND h.id = e.id GROUP BY q.qid)
SELECT variant, count(*) AS n, round(avg(coalesce(1.0 / (rank + 1), 0)), 9) AS mrr, round(avg(CASE WHEN rank < 10 THEN 1.0 ELSE 0 END), 9) AS r10 FROM two GROUP BY variant""")
def eval_by_variant(spark, d):
    logged = _ranks(spark, d)
    key = lambda c: F.trim(F.lower(c))
    clicked = logs.answered_queries(read(spark, d, "clicks")).select(key(F.col("query")).alias("key"), "path")
    queries = read(spark, d, "searches").select(F.col("id").alias("qid"), key(F.col("query")).alias("key")).join(clicked, "key").groupBy("qid").agg(F.collect_set("path").alias("expected"))
    words = read(spark, d, "hits").select(F.col("search_id").alias("qid"), "id", F.col("lex_rank").alias("place"))
    keywords = E.first_ranks(words, E.expected_ids(queries, read(spark, d, "files")))
    both = logged.select(F.lit("logged").alias("variant"), "rank").unionByName(keywords.select(F.lit("keywords").alias("variant"), "rank"))
    return E.quality(both, "variant").select("variant", "n", F.round("mrr", 9).alias("mrr"), F.round("r10", 9).alias("r10"))


@BOOK.add("SELECT count(*) AS n, round(median(ms), 6) AS p50, round(list_sort(list(ms))[least(count(ms) - 1, CAST(floor(0.95 * count(ms)) AS BIGINT)) + 1], 6) AS p95 FROM searches")
def eval_percentiles(spark, d):
    rows = read(spark, d, "searches")
    n = rows.agg(F.count("*").alias("n"))
    p50, p95 = E.median_exact(rows, "ms"), E.percentile_exact(rows, "ms", 0.95).first()
    value = lambda x: F.round(F.lit(x).cast("double"), 6)
    return n.select("n", value(p50).alias("p50"), value(p95[0] if p95 else None).alias("p95"))


@BOOK.add("SELECT query, [path] AS expected, 'log' AS source FROM (SELECT query, path FROM clicks WHERE action IN ('open', 'reveal', 'copy') AND query <> '' GROUP BY query, path) x")
def export_log(spark, d):
    return logs.eval_queries(read(spark, d, "clicks"))


@BOOK.add("SELECT query, path, max(ts) AS last FROM clicks WHERE action IN ('open', 'reveal', 'copy') AND query <> '' GROUP BY query, path")
def last_click_per_query(spark, d):
    return logs.answered_queries(read(spark, d, "clicks"))


@BOOK.add(f"""WITH p AS (SELECT id, path, kind, status, status = 'ok' AS ok FROM files WHERE NOT regexp_matches(lower(path), '{_SENSITIVE}')), n AS (SELECT kind, ok, count(*) AS size FROM p GROUP BY ALL)
SELECT kind, ok, least(size, 3) AS n FROM n""")
def sample_strata(spark, d):
    """How many files a sample of three turns takes of each kind with and without text."""
    return E.first_turns(read(spark, d, "files"), 3).groupBy("kind", "ok").agg(F.count("*").alias("n"))


@BOOK.add()
def eval_sample(spark, d):
    """Forty files for a query set, in turns over kinds, with the beginning of their text."""
    picked = E.stratified(read(spark, d, "files"), 40, seed=7)
    content = read(spark, d, "lexical_index").select("id", F.regexp_replace(F.left("content", F.lit(400)), "\n", " ").alias("content"))
    return picked.join(content, "id", "left").select("path", "kind", F.when(F.col("status") == "ok", F.coalesce("content", F.lit(""))).otherwise("").alias("content"))


@BOOK.add("SELECT action, count(*) AS n, count(DISTINCT file_id) AS files FROM (SELECT DISTINCT ON (id) * FROM clicks) c GROUP BY action")
def log_counts_by_action(spark, d):
    return read(spark, d, "clicks").dropDuplicates(["id"]).groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


@BOOK.add("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE results = 0) AS empty, round(avg(ms), 6) AS ms FROM searches GROUP BY 1")
def searches_log(spark, d):
    return read(spark, d, "searches").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("results") == 0).alias("empty"), F.round(F.avg("ms"), 6).alias("ms"))


# ---------------------------------------------------------------- events

_SESSIONS = "s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 2000000 THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY arrived, entry_id) AS session FROM (SELECT *, epoch_us(arrived) - epoch_us(lag(arrived) OVER (PARTITION BY root ORDER BY arrived, entry_id)) AS gap FROM scan_entries WHERE root IS NOT NULL) x)"


@BOOK.add(f"WITH {_SESSIONS} SELECT root, min(arrived) AS first, count(*) AS events, count(DISTINCT path) AS paths FROM s GROUP BY root, session")
def session_debounce(spark, d):
    """Events of a root that follow each other within two seconds, as one batch with distinct paths."""
    return watch.debounced(read(spark, d, "scan_entries"))


@BOOK.add("SELECT root, path, max(entry_id) AS entry_id FROM scan_entries WHERE root IS NOT NULL GROUP BY root, path")
def dedupe_paths(spark, d):
    return watch.distinct_paths(read(spark, d, "scan_entries"))


@BOOK.add("""WITH l AS (SELECT path, arg_max({'s': size, 'm': mtime, 'd': dataless}, {'o': observed, 'e': entry_id}) AS s FROM scan_entries WHERE size IS NOT NULL AND mtime IS NOT NULL GROUP BY path)
SELECT path, s.s AS size, s.m AS mtime FROM l""")
def upsert_stream(spark, d):
    """The state of every path after all scan rows went through the stream, batch by batch."""
    return watch.stream_to_state(spark, f"{d}/scan_entries.parquet").select("path", "size", "mtime")


@BOOK.add(f"WITH {_CLICKS} SELECT id, round(general, 6) AS general FROM general")
def click_stream(spark, d):
    """Decayed use of files, kept up by a stream of clicks."""
    return watch.stream_clicks(spark, f"{d}/clicks.parquet", NOW).select("id", F.round("general", 6).alias("general"))
