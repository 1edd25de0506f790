"""Queries on texts and names."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from recall_engine.functions import text as X
from recall_engine.functions.queryparse import parsed
from recall_engine.functions.stemmer import stem_of
from recall_engine.functions.vocabulary import STOPWORDS
from recall_engine.operators import lexical as L
from recall_engine.queries import Book, read

BOOK = Book()
#: The day queries are read on.
TODAY = date(2024, 1, 18)


def split_sql(x: str) -> str:
    """split_name in SQL; pairs of characters are split by groups, as RE2 has no look-around."""
    steps = [
        (r"[_\-.+,;:()\[\]{}#@&=~''’\"`/\\|<>!?*]+", " "),
        ("([a-zà-ÿ])([A-ZÀ-Þ])", r"\1 \2"),
        ("([A-ZÀ-Þ])([A-ZÀ-Þ][a-zà-ÿ])", r"\1 \2"),
        (r"([\p{L}\p{Nl}\p{No}])(\p{Nd})", r"\1 \2"),
        (r"(\p{Nd})([\p{L}\p{Nl}\p{No}])", r"\1 \2"),
        (r"\b((?:19|20)\d\d)(0[1-9]|1[0-2])([0-3]\d)\b", r"\1 \2 \3"),
        (r"\b((?:19|20)\d\d)(0[1-9]|1[0-2])\b", r"\1 \2"),
        (r"\s+", " "),
    ]
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x})"


def fold_sql(x: str) -> str:
    return f"strip_accents(lower({x}))"


def words_sql(x: str) -> str:
    return f"list_filter(string_split({fold_sql(split_sql(x))}, ' '), lambda w: w <> '')"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all({fold_sql(x)}, '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) < 60)"


def folders_sql(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({x}, '/'), lambda p: p <> ''), lambda p: {split_sql('p')}), ' ')"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@BOOK.add(f"SELECT id, {split_sql('name')} AS words FROM files")
def split_name(spark, d):
    return read(spark, d, "files").select("id", X.split_name("name").alias("words"))


@BOOK.add(f"SELECT id, {fold_sql('name')} AS folded FROM files")
def fold(spark, d):
    return read(spark, d, "files").select("id", X.fold("name").alias("folded"))


@BOOK.add(f"SELECT id, {words_sql('name')} AS words FROM files")
def words(spark, d):
    return read(spark, d, "files").select("id", X.words("name").alias("words"))


@BOOK.add(f"SELECT id, {folders_sql('rel_parent')} AS folders FROM files")
def folder_words(spark, d):
    return read(spark, d, "files").select("id", X.folder_words("rel_parent").alias("folders"))


@BOOK.add(f"""
WITH a AS (SELECT id, {split_sql("CASE WHEN contains(name, '.') THEN regexp_replace(name, '[.][^.]*$', '') ELSE name END")} AS label,
  list_transform(list_filter(string_split(rel_parent, '/'), lambda p: p <> ''), lambda p: {split_sql('p')}) AS f FROM files)
SELECT id, CASE WHEN len(f) > 0 THEN label || ' — ' || array_to_string(f[greatest(1, len(f) - 2):], ' / ') ELSE label END AS label FROM a""")
def context_label(spark, d):
    return read(spark, d, "files").select("id", X.context_label("name", "rel_parent").alias("label"))


@BOOK.add(f"""
WITH a AS (SELECT id, {split_sql("CASE WHEN contains(name, '.') THEN regexp_replace(name, '[.][^.]*$', '') ELSE name END")} AS label,
  list_transform(list_filter(string_split(rel_parent, '/'), lambda p: p <> ''), lambda p: {split_sql('p')}) AS f FROM files),
  b AS (SELECT id, CASE WHEN len(f) > 0 THEN label || ' — ' || array_to_string(f[greatest(1, len(f) - 2):], ' / ') ELSE label END AS label FROM a)
SELECT c.row, b.label || chr(10) || substr(l.content, c.start + 1, c."end" - c.start) AS passage FROM chunks c JOIN b ON b.id = c.file_id JOIN lexical_index l ON l.id = c.file_id WHERE c."end" > 0 AND l.content IS NOT NULL""")
def chunk_passages(spark, d):
    """What is embedded for each chunk: the label of its file, then its text."""
    files = read(spark, d, "files").select(F.col("id").alias("file_id"), "name", "rel_parent")
    content = read(spark, d, "lexical_index").where("content is not null").select(F.col("id").alias("file_id"), "content")
    rows = read(spark, d, "chunks").where("end > 0").join(files, "file_id").join(content, "file_id")
    return rows.select("row", X.passage("name", "rel_parent", F.expr("substring(content, start + 1, end - start)")).alias("passage"))


@BOOK.add(f"""
WITH w AS (SELECT id, {words_sql('query')} AS w FROM searches), k AS (SELECT id, w, list_filter(w, lambda x: NOT list_contains([{_STOP}], x)) AS k FROM w)
SELECT id, CASE WHEN len(k) > 0 THEN k ELSE w END AS kept FROM k""")
def stopwords(spark, d):
    return read(spark, d, "searches").select("id", X.without_stopwords(X.words("query")).alias("kept"))


@BOOK.add(f"SELECT id, {tokens_sql('content')} AS tokens FROM lexical_index WHERE content IS NOT NULL")
def content_tokens(spark, d):
    return read(spark, d, "lexical_index").where("content is not null").select("id", X.tokens("content").alias("tokens"))


@BOOK.add("SELECT id, unnest(range(0, length(content), 920)) AS start, least(unnest(range(0, length(content), 920)) + 1100, length(content)) AS \"end\" FROM lexical_index WHERE length(content) > 0")
def fixed_chunks(spark, d):
    rows = read(spark, d, "lexical_index").where("length(content) > 0")
    return rows.select("id", F.inline(X.fixed_spans(F.length("content"), 1100, 920)))


_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@BOOK.add(f"""WITH RECURSIVE step AS (
  SELECT id, content, length(content) AS n, 0 AS s, 0 AS kept, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS e FROM lexical_index WHERE length(content) > 0
  UNION ALL
  SELECT id, content, n, CASE WHEN e1 >= n THEN n ELSE greatest(greatest(e1 - 180, s + 1), CASE WHEN instr(substr(content, greatest(e1 - 180, s + 1) + 1, e1 - greatest(e1 - 180, s + 1)), ' ') > 0
      THEN greatest(e1 - 180, s + 1) + instr(substr(content, greatest(e1 - 180, s + 1) + 1, e1 - greatest(e1 - 180, s + 1)), ' ') ELSE 0 END) END,
    kept + CASE WHEN blank THEN 0 ELSE 1 END, CASE WHEN blank THEN NULL ELSE s END, CASE WHEN blank THEN NULL ELSE e1 END
  FROM (SELECT *, regexp_full_match(substr(content, s + 1, e1 - s), '{_WS}*') AS blank FROM (SELECT *, CASE WHEN s + 1100 >= n THEN n ELSE s + 550 + CASE WHEN cut > 0 THEN cut WHEN space >= 0 THEN space ELSE 550 END END AS e1
    FROM (SELECT *, greatest(length(regexp_extract(half, '(?s)^.*[.!?…:;]{_WS}+')), length(regexp_extract(half, '(?s)^.*\\n'))) AS cut, length(regexp_extract(half, '(?s)^.* ')) - 1 AS space
      FROM (SELECT id, content, n, s, kept, substr(content, s + 551, 550) AS half FROM step WHERE s < n AND kept < 16) h) c) x) y
) SELECT id, CAST(a AS INT) AS start, CAST(e AS INT) AS "end" FROM step WHERE a IS NOT NULL""")
def sentence_chunks(spark, d):
    rows = read(spark, d, "lexical_index").where("length(content) > 0")
    return rows.select("id", F.inline(X.sentence_chunks("content", F.lit(16))))


@BOOK.add(r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '[\x{0000}\x{e000}-\x{f8ff}\x{fffd}\x{fffe}\x{ffff}]', ' ', 'g'), '[ \t\r\f\x{0b}]+', ' ', 'g'),
  '\n[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\n+', chr(10) || chr(10), 'g'),
  '^[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS clean FROM lexical_index WHERE content IS NOT NULL""")
def clean_text(spark, d):
    return read(spark, d, "lexical_index").where("content is not null").select("id", X.clean("content").alias("clean"))


@BOOK.add(r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(content, '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS text FROM lexical_index WHERE ext = 'html' AND content IS NOT NULL""")
def html_text(spark, d):
    return read(spark, d, "lexical_index").where("ext = 'html' and content is not null").select("id", X.html_text("content").alias("text"))


_VOCABULARY = f"(SELECT DISTINCT unnest({tokens_sql(split_sql('name'))}) AS found FROM files UNION SELECT DISTINCT unnest({tokens_sql(folders_sql('rel_parent'))}) FROM files)"
_QUERY_TERMS = f"(SELECT DISTINCT unnest({tokens_sql(split_sql('query'))}) AS term FROM searches)"


def _vocabulary(spark, d):
    files = read(spark, d, "files")
    return files.select(F.explode(X.tokens(X.split_name("name"))).alias("found")).union(files.select(F.explode(X.tokens(X.folder_words("rel_parent"))))).distinct()


def _terms(spark, d):
    return read(spark, d, "searches").select(F.explode(X.tokens(X.split_name("query"))).alias("term")).distinct()


@BOOK.add(f"SELECT term, found FROM {_QUERY_TERMS} t JOIN {_VOCABULARY} v ON abs(length(term) - length(found)) <= 1 AND damerau_levenshtein(term, found) <= 1 WHERE length(term) >= 5")
def edit1_terms(spark, d):
    return L.similar_terms(_terms(spark, d).where("length(term) >= 5"), _vocabulary(spark, d))


@BOOK.add(f"SELECT term, found FROM {_QUERY_TERMS} t JOIN {_VOCABULARY} v ON starts_with(found, term) WHERE length(term) >= 2")
def prefix_terms(spark, d):
    return L.longer_terms(_terms(spark, d), _vocabulary(spark, d))


@BOOK.add()
def stemmed_terms(spark, d):
    return _terms(spark, d).select("term", stem_of("term").alias("stem"))


@BOOK.add()
def parse_queries(spark, d):
    return read(spark, d, "searches").select("id", parsed(F.col("query"), TODAY).alias("p")).select("id", "p.*")


_GOLD_DAY = date(2026, 10, 8)
#: Queries and what they mean on _GOLD_DAY, a Thursday, worked out by hand: text, extensions, first day and the day after
#: the last, year, words of names, recent.
_GOLD = [
    ("le pdf du devis de la semaine dernière", "devis", ["pdf"], "2026-09-28", "2026-10-09", None, "", False),
    ("facture edf en mars", "facture edf", [], "2026-03-01", "2026-04-01", None, "", False),
    ("relevé en décembre", "relevé", [], "2025-12-01", "2026-01-01", None, "", False),
    ("relevé en octobre", "relevé", [], "2026-10-01", "2026-11-01", None, "", False),
    ("notes de cours mars 2025", "notes de cours", [], "2025-03-01", "2025-04-01", None, "2025 03", False),
    ("composition du stoxx 600 mai 2022", "composition du stoxx 600", [], "2022-05-01", "2022-06-01", None, "2022 05", False),
    ("bilan 2024", "bilan 2024", [], None, None, 2024, "", False),
    ("bilan 1899", "bilan 1899", [], None, None, None, "", False),
    ("devis depuis 2024", "devis", [], "2024-01-01", "2025-01-01", None, "", False),
    ("contrat en 2023", "contrat", [], "2023-01-01", "2024-01-01", None, "", False),
    ("Relevé de compte hier", "Relevé de compte", [], "2026-10-07", "2026-10-08", None, "", False),
    ("avant-hier", "", [], "2026-10-06", "2026-10-07", None, "", False),
    ("day before yesterday", "", [], "2026-10-06", "2026-10-07", None, "", False),
    ("budget aujourd'hui", "budget", [], "2026-10-08", "2026-10-09", None, "", False),
    ("budget cette semaine", "budget", [], "2026-10-05", "2026-10-09", None, "", False),
    ("slides from last week", "slides", ["key", "odp", "ppt", "pptx"], "2026-09-28", "2026-10-09", None, "", False),
    ("ce mois-ci budget", "budget", [], "2026-10-01", "2026-10-09", None, "", False),
    ("budget le mois dernier", "budget", [], "2026-09-01", "2026-10-09", None, "", False),
    ("budget cette année", "budget", [], "2026-01-01", "2026-10-09", None, "", False),
    ("budget last year", "budget", [], "2025-01-01", "2026-01-01", None, "", False),
    ("mail il y a 9 jours", "mail", ["eml", "emlx", "msg"], "2026-09-26", "2026-10-03", None, "", False),
    ("note 2 days ago", "note", [], "2026-10-05", "2026-10-08", None, "", False),
    ("note il y a deux semaines", "note", [], "2026-09-16", "2026-10-03", None, "", False),
    ("présentation stage il y a 2 mois", "présentation stage", ["key", "odp", "ppt", "pptx"], "2026-07-10", "2026-09-09", None, "", False),
    ("note il y a un an", "note", [], "2025-03-22", "2026-04-27", None, "", False),
    ("excel budget vacances", "budget vacances", ["csv", "numbers", "ods", "tsv", "xls", "xlsm", "xlsx"], None, None, None, "", False),
    ("documents récents", "documents", [], None, None, None, "", True),
    ("latest report", "report", [], None, None, None, "", True),
    ("pdf", "", ["pdf"], None, None, None, "", False),
    ("python notebook", "notebook", ["ipynb", "py"], None, None, None, "", False),
    ("", "", [], None, None, None, "", False),
]


def _gold_sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    day = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"epoch(TIMESTAMP '{x}')"
    rows = [f"({i}, {text(t)}, CAST([{', '.join(map(text, exts))}] AS VARCHAR[]), {day(a)}, {day(b)}, {y or 'NULL'}, {text(w)}, {r})" for i, (_, t, exts, a, b, y, w, r) in enumerate(_GOLD)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(id, text, exts, date_from, date_to, year_hint, name_terms, recent)"


@BOOK.add(_gold_sql())
def parse_goldens(spark, d):
    """What queries mean, against values worked out by hand."""
    rows = spark.createDataFrame([(i, g[0]) for i, g in enumerate(_GOLD)], "id int, query string")
    return rows.select("id", parsed(F.col("query"), _GOLD_DAY).alias("p")).select("id", "p.text", "p.exts", "p.date_from", "p.date_to", "p.year_hint", "p.name_terms", "p.recent")


#: Words and stems of the published vocabulary of the algorithm, those without accents.
_STEMS = {
    "continu": "continu", "continua": "continu", "continuait": "continu", "continuant": "continu", "continuation": "continu", "continue": "continu", "continuel": "continuel", "continuelle": "continuel", "continuellement": "continuel",
    "continuelles": "continuel", "continuels": "continuel", "continuer": "continu", "continuera": "continu", "continuerait": "continu", "continueront": "continu", "continuez": "continu", "continuons": "continuon",
    "contorsions": "contors", "contour": "contour", "contournait": "contourn", "contournant": "contourn", "contourne": "contourn", "contours": "contour", "contractait": "contract", "contracter": "contract", "contractions": "contract",
    "main": "main", "mains": "main", "maintenaient": "mainten", "maintenait": "mainten", "maintenant": "mainten", "maintenir": "mainten", "maintenue": "maintenu", "maintien": "maintien", "maintint": "maintint",
    "maire": "mair", "maires": "mair", "mairie": "mair", "mais": "mais", "maison": "maison", "maisons": "maison", "maistre": "maistr", "maitre": "maitr", "majestueuse": "majestu", "majestueusement": "majestu", "majestueux": "majestu",
    "majeur": "majeur", "majeure": "majeur", "major": "major", "majordome": "majordom", "majordomes": "majordom", "mal": "mal", "malacca": "malacc", "malade": "malad", "malades": "malad", "maladie": "malad", "maladies": "malad", "maladive": "malad",
}


@BOOK.add("SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{x}')" for w, x in _STEMS.items()) + ") v(word, stem)")
def stem_goldens(spark, d):
    """Stems of published words."""
    return spark.createDataFrame([(w,) for w in _STEMS], "word string").select("word", stem_of("word").alias("stem"))
