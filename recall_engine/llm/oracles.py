"""SQL for DuckDB that gives the rows of the queries which SQL can express."""

from recall_engine.llm.ranking import P4_SQL, RANKING_SQL

#: Words as TESTDATA.md defines them: the compatibility forms that occur are spelt out, as DuckDB has canonical forms only.
_WORDS = """
  regexp_extract_all(strip_accents(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(lower({0}),
    '™', 'TM'), '№', 'No'), 'º', 'o'), 'ª', 'a'), '½', '1/2'), '¼', '1/4'), '²', '2'), '³', '3'), '…', '.'), 'ſ', 's')), '[\\p{{L}}\\p{{N}}]+')
"""
_GRAMS = """
  SELECT {id}, n, w[i:i + {k} - 1] AS gram, i FROM (
    SELECT {id}, w, len(w) AS n, unnest(range(1, len(w) - {k} + 2)) AS i FROM (SELECT {id}, {words} AS w FROM {table} WHERE {text} IS NOT NULL) a
  ) b
"""


def _grams(table: str, id: str, text: str, k: int) -> str:
    return _GRAMS.format(table=table, id=id, text=text, k=k, words=_WORDS.format(text))


P3_SQL = """
SELECT id, CASE WHEN list_max(list_transform(string_split_regex(content,
  '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: length(x))) > 1100 THEN 'forced' ELSE 'natural' END AS cut
FROM lexical_index WHERE length(content) > 1100
"""

P5_SQL = """
WITH v AS (
  SELECT row, file_id, list_transform(q, lambda x: CAST(x AS DOUBLE)) AS q FROM vectors
  WHERE file_id <> -1 AND q IS NOT NULL AND list_max(list_transform(q, lambda x: abs(x))) > 0
), n AS (SELECT row, file_id, q, list_inner_product(q, q) AS norm FROM v)
SELECT a.row AS row_a, b.row AS row_b FROM n a JOIN n b ON a.row < b.row AND a.file_id <> b.file_id
WHERE list_inner_product(a.q, b.q) >= 0.9 * sqrt(a.norm * b.norm)
"""

NEAREST_SQL = """
WITH v AS (
  SELECT row, file_id, list_transform(q, lambda x: CAST(x AS DOUBLE)) AS q FROM vectors
  WHERE file_id <> -1 AND q IS NOT NULL AND list_max(list_transform(q, lambda x: abs(x))) > 0
), n AS (SELECT row, file_id, q, list_inner_product(q, q) AS norm FROM v),
p AS (SELECT a.row AS row_a, b.row AS row_b, list_inner_product(a.q, b.q) / sqrt(a.norm * b.norm) AS c FROM n a JOIN n b ON a.file_id <> b.file_id WHERE a.row % 20 = 0)
SELECT row_a, rank, row_b, round(c, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY row_a ORDER BY round(c, 9) DESC, row_b) AS rank FROM p) r WHERE rank <= 10
"""

P6_SQL = f"""
WITH g AS (SELECT DISTINCT id, gram FROM ({_grams('lexical_index', 'id', 'content', 3)}) x WHERE n >= 40),
  sizes AS (SELECT id, count(*) AS n FROM g GROUP BY id),
  shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM shared JOIN sizes s ON s.id = id_a JOIN sizes t ON t.id = id_b WHERE c >= 0.6 * (s.n + t.n - c)
"""

GROUPS_SQL = f"""
WITH RECURSIVE g AS (SELECT DISTINCT id, gram FROM ({_grams('lexical_index', 'id', 'content', 3)}) x WHERE n >= 40),
  sets AS (SELECT id, list_sort(list(gram)) AS grams FROM g GROUP BY id),
  member AS (SELECT id, min(id) OVER (PARTITION BY grams) AS rep, count(*) OVER (PARTITION BY grams) - 1 AS copies FROM sets),
  r AS (SELECT * FROM g WHERE id IN (SELECT rep FROM member)),
  sizes AS (SELECT id, count(*) AS n FROM r GROUP BY id),
  shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM r a JOIN r b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id),
  edge AS (SELECT a, b FROM shared JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE c >= 0.6 * (s.n + t.n - c)),
  ways AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
  reach AS (SELECT DISTINCT rep AS a, rep AS b FROM member UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
  label AS (SELECT a, min(b) AS g FROM reach GROUP BY a),
  degree AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT id, g AS "group", coalesce(degree.n, 0) AS linked, copies FROM member JOIN label ON label.a = rep LEFT JOIN degree ON degree.a = rep WHERE coalesce(degree.n, 0) > 0 OR copies > 0
"""

P9_SQL = f"""
SELECT DISTINCT d.doc_id, b.item_id FROM ({_grams('documents', 'doc_id', 'text', 13)}) d JOIN ({_grams('benchmark', 'item_id', 'text', 13)}) b ON d.gram = b.gram
"""

ORACLES: dict[str, str] = {"p3_found": P3_SQL, "p4_found": P4_SQL, "p4_ranking": RANKING_SQL, "p5_found": P5_SQL, "p5_nearest": NEAREST_SQL, "p6_found": P6_SQL, "p6_groups": GROUPS_SQL, "p9_found": P9_SQL}
