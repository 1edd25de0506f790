"""Queries on the catalogue: attributes, filters, differences of snapshots, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recall_engine.functions.queryparse import Parsed, merge_filters
from recall_engine.functions.vocabulary import EXTRACTABLE, KINDS, SENSITIVE, SKIPPED_FILES, SKIPPED_FOLDERS, SKIPPED_SUFFIXES, TEXT_LIKE
from recall_engine.operators import catalog as C
from recall_engine.queries import NOW, Book, read
from recall_engine.sources import files as sources

BOOK = Book()
_q = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_EXT = "CASE WHEN contains(trim({0}, '.'), '.') THEN lower(regexp_extract({0}, '([^.]*)$', 1)) ELSE '' END"
_KIND = "CASE " + " ".join(f"WHEN {{0}} IN ({_q(v)}) THEN '{k}'" for k, v in KINDS.items()) + " ELSE 'other' END"
_BASE = "regexp_extract({0}, '([^/]*)$', 1)"
_WORK = f"CASE WHEN dataless OR ext NOT IN ({_q(sorted(EXTRACTABLE))}) OR size > 50000000 THEN 0.03 ELSE 1.0 + least(16.0, size / CASE WHEN ext IN ({_q(sorted(TEXT_LIKE))}) THEN 1100.0 ELSE 25000.0 END) END"
_STALE = "status = 'pending' OR lexical_mtime IS NULL OR lexical_mtime <> mtime OR embedded_mtime IS NULL OR embedded_mtime <> mtime"
_DATES = "(mtime >= {0} AND mtime < {1}) OR (coalesce(last_used, 0) >= {0} AND coalesce(last_used, 0) < {1}) OR (ctime >= {0} AND ctime < {1})"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "files")


@BOOK.add(f"""
WITH a AS (SELECT id, path, {_BASE.format('path')} AS name FROM files), b AS (SELECT *, {_EXT.format('name')} AS ext FROM a)
SELECT id, name, ext, {_KIND.format('ext')} AS kind FROM b""")
def files_catalog(spark, d):
    named = _files(spark, d).select("id", C.base_name("path").alias("name"))
    return named.withColumn("ext", C.extension("name")).withColumn("kind", C.kind("ext"))


@BOOK.add(f"SELECT id, ext, kind, {_KIND.format('ext')} AS expected FROM files WHERE kind <> {_KIND.format('ext')}")
def kind_lookup(spark, d):
    return _files(spark, d).select("id", "ext", "kind", C.kind("ext").alias("expected")).where("kind <> expected")


@BOOK.add(f"SELECT id, {_EXT.format('name')} AS ext FROM lexical_index")
def ext_of_name(spark, d):
    return read(spark, d, "lexical_index").select("id", C.extension("name").alias("ext"))


@BOOK.add("""
WITH r AS (SELECT DISTINCT root FROM scan_entries), m AS (
  SELECT e.entry_id, e.path, r.root FROM scan_entries e LEFT JOIN r ON starts_with(e.path, r.root || '/')
), one AS (SELECT entry_id, any_value(path) AS path, arg_min(root, (length(root), root)) AS root FROM m GROUP BY entry_id)
SELECT entry_id, coalesce(regexp_extract(root, '([^/]*)$', 1), '') AS label,
  CASE WHEN root IS NULL THEN regexp_replace(path, '/[^/]*$', '') ELSE substr(regexp_replace(path, '/[^/]*$', ''), length(root) + 2) END AS rel_parent FROM one""")
def split_root(spark, d):
    rows = read(spark, d, "scan_entries").select("entry_id", "path", "root")
    roots = C.distinct_roots([r.root for r in rows.select("root").where("root is not null").distinct().collect()])  # roots are configured, few
    label, below = C.under_root("path", roots)
    return rows.select("entry_id", label.alias("label"), below.alias("rel_parent")).dropDuplicates(["entry_id"])


@BOOK.add("SELECT id, CASE WHEN root <> '' THEN '~/' || root ELSE '' END || CASE WHEN rel_parent <> '' THEN '/' || rel_parent ELSE '' END AS parent FROM files")
def display_parent(spark, d):
    return _files(spark, d).select("id", C.display_parent("root", "rel_parent").alias("parent"))


@BOOK.add(f"SELECT id, CASE WHEN dataless THEN 'dataless' WHEN ext NOT IN ({_q(sorted(EXTRACTABLE))}) THEN 'skipped' WHEN size > 50000000 THEN 'too_big' ELSE 'extract' END AS step FROM files")
def status_case(spark, d):
    return _files(spark, d).select("id", F.coalesce(C.status_before_extraction(), F.lit("extract")).alias("step"))


@BOOK.add("SELECT id, name FROM files WHERE ext IN ('pdf', 'docx')")
def filter_ext(spark, d):
    return C.allowed(_files(spark, d), ["pdf", "docx"]).select("id", "name")


@BOOK.add(f"SELECT id, ext FROM files WHERE ext IN ({_q([*KINDS['spreadsheet'], *KINDS['image']])})")
def filter_kind(spark, d):
    return C.allowed(_files(spark, d), C.kind_extensions(["spreadsheet", "image"])).select("id", "ext")


@BOOK.add(f"SELECT id, mtime FROM files WHERE {_DATES.format(NOW - 60 * 86400, NOW - 20 * 86400)}")
def filter_dates(spark, d):
    return C.allowed(_files(spark, d), None, NOW - 60 * C.DAY, NOW - 20 * C.DAY).select("id", "mtime")


@BOOK.add(f"SELECT id, mtime FROM files WHERE {_DATES.format(NOW - 30 * 86400, NOW + 86400)}")
def filter_last_days(spark, d):
    return C.allowed(_files(spark, d), None, NOW - 30 * C.DAY, NOW + C.DAY).select("id", "mtime")


@BOOK.add("SELECT id, path FROM files WHERE path = '/Users/lou/Documents' OR starts_with(path, '/Users/lou/Documents/')")
def filter_folder(spark, d):
    return _files(spark, d).where(C.in_folder("/Users/lou/Documents")).select("id", "path")


@BOOK.add(f"SELECT id FROM files WHERE regexp_matches(lower(path), '{'|'.join(SENSITIVE).replace(chr(39), chr(39) * 2)}')")
def filter_sensitive(spark, d):
    return _files(spark, d).where(C.sensitive()).select("id")


@BOOK.add(f"SELECT id, row_number() OVER (ORDER BY dataless, mtime DESC, id) AS turn FROM files WHERE {_STALE}")
def work_order(spark, d):
    rows = _files(spark, d).where(C.stale()).select("id", "dataless", (-F.col("mtime")).alias("m"))
    return C.numbered_rows(rows, ["dataless", "m", "id"]).select("id", F.col("number").cast("long").alias("turn"))


@BOOK.add(f"SELECT id FROM files WHERE {_STALE}")
def filter_stale(spark, d):
    return _files(spark, d).where(C.stale()).select("id")


@BOOK.add("SELECT id, CAST(place AS INT) AS place, round(1.0 / place, 9) AS score FROM (SELECT id, row_number() OVER (ORDER BY mtime DESC, id) AS place FROM files WHERE ext = 'pdf') x WHERE place <= 30")
def filter_only_newest(spark, d):
    return C.newest(C.allowed(_files(spark, d), ["pdf"]), 30).withColumn("score", F.round("score", 9))


@BOOK.add(f"SELECT id FROM files WHERE ext IN ('csv', 'xlsx') AND ({_DATES.format(NOW - 200 * 86400, NOW - 30 * 86400)})")
def merge_filters_parsed(spark, d):
    found = Parsed("budget", exts=sorted(["csv", "xlsx", "ods"]), date_from=NOW - 200 * C.DAY, date_to=NOW)
    exts, start, end = merge_filters(found, ["csv", "xlsx", "pdf"], NOW - 400 * C.DAY, NOW - 30 * C.DAY)
    return C.allowed(_files(spark, d), exts, start, end).select("id")


_SCAN = """
scan AS (SELECT path, arg_max({'size': size, 'mtime': mtime, 'dataless': dataless}, {'o': observed, 'e': entry_id}) AS s FROM scan_entries
  WHERE gen = (SELECT max(gen) FROM scan_entries) AND size IS NOT NULL AND mtime IS NOT NULL GROUP BY path),
diff AS (SELECT coalesce(s.path, f.path) AS path, f.id, CASE WHEN f.id IS NULL THEN 'new' WHEN s.path IS NULL THEN 'gone'
  WHEN s.s.size <> f.size OR s.s.mtime <> f.mtime OR (f.dataless AND NOT s.s.dataless) THEN 'changed' ELSE 'same' END AS change
  FROM scan s FULL JOIN files f ON s.path = f.path)"""


def _last_scan(spark, d):
    entries = read(spark, d, "scan_entries")
    return C.latest_scan(entries, entries.agg(F.max("gen")).first()[0])


@BOOK.add(f"WITH {_SCAN} SELECT path, id, change FROM diff")
def snapshot_diff(spark, d):
    return C.snapshot_diff(_last_scan(spark, d), _files(spark, d))


@BOOK.add(f"WITH {_SCAN} SELECT id FROM diff WHERE change = 'gone' AND (starts_with(path, '/Users/lou/Documents/') OR NOT (starts_with(path, '/Users/lou/Documents/') OR starts_with(path, '/Volumes/Compta/')))")
def gone_guarded(spark, d):
    gone = C.snapshot_diff(_last_scan(spark, d), _files(spark, d)).where("change = 'gone'")
    roots = ["/Users/lou/Documents", "/Volumes/Compta"]
    return gone.where(C.deletable("path", roots, roots[:1])).select("id")


@BOOK.add(f"""WITH {_SCAN}, fresh AS (SELECT d.path, d.change, d.id, s.s.size AS size, s.s.mtime AS mtime FROM diff d JOIN scan s USING (path) WHERE change IN ('new', 'changed')),
  numbered AS (SELECT path, (SELECT max(id) FROM files) + row_number() OVER (ORDER BY path) AS id FROM fresh WHERE change = 'new')
SELECT coalesce(n.id, f.id) AS id, f.path, size, mtime, 'pending' AS status, 999 AS seen FROM fresh f LEFT JOIN numbered n USING (path)
UNION ALL SELECT f.id, f.path, f.size, f.mtime, f.status, 999 FROM diff JOIN files f USING (path) WHERE change = 'same'
UNION ALL SELECT f.id, f.path, f.size, f.mtime, f.status, f.seen FROM diff JOIN files f USING (path) WHERE change = 'gone' AND starts_with(f.path, '/Volumes/')""")
def apply_scan(spark, d):
    roots = ["/Users", "/Volumes"]
    after = C.apply_diff(_files(spark, d), _last_scan(spark, d), 999, roots, roots[:1])
    return after.select("id", "path", "size", "mtime", "status", "seen")


@BOOK.add("""WITH g AS (SELECT id FROM files WHERE starts_with(path, '/Users/lou/Downloads/'))
SELECT 'chunk' AS what, row AS id, file_id FROM chunks WHERE file_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'file', id, id FROM files WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'vector', row, CASE WHEN file_id IN (SELECT id FROM g) THEN -1 ELSE file_id END FROM vectors""")
def cascade_delete(spark, d):
    files = _files(spark, d)
    gone = files.where(C.in_folder("/Users/lou/Downloads")).select("id")
    f, c, v = C.cascade_delete(files, read(spark, d, "chunks"), read(spark, d, "vectors"), gone)
    named = lambda df, what, id, file: df.select(F.lit(what).alias("what"), F.col(id).alias("id"), F.col(file).alias("file_id"))
    return named(f, "file", "id", "id").unionByName(named(c, "chunk", "row", "file_id")).unionByName(named(v, "vector", "row", "file_id"))


@BOOK.add("SELECT row AS old, row_number() OVER (ORDER BY first, file_id, row) - 1 AS new FROM (SELECT row, file_id, min(row) OVER (PARTITION BY file_id) AS first FROM chunks) x")
def remap_rows(spark, d):
    return C.compact(read(spark, d, "chunks"))


@BOOK.add("SELECT round(avg(CASE WHEN file_id < 0 THEN 1.0 ELSE 0.0 END), 9) AS dead, count(*) FILTER (WHERE file_id >= 0) AS live FROM vectors")
def dead_ratio(spark, d):
    v = read(spark, d, "vectors")
    return v.agg(F.round(F.avg((F.col("file_id") < 0).cast("double")), 9).alias("dead"), F.count_if(F.col("file_id") >= 0).alias("live"))


@BOOK.add("SELECT status, count(*) AS n FROM files GROUP BY status")
def count_by_status(spark, d):
    return _files(spark, d).groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


@BOOK.add("SELECT kind, count(*) AS n FROM files GROUP BY kind")
def count_by_kind(spark, d):
    return _files(spark, d).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@BOOK.add(f"SELECT root, count(*) AS n, count(*) FILTER (WHERE NOT dataless AND ext IN ({_q(sorted(EXTRACTABLE))})) AS readable, count(*) FILTER (WHERE dataless) AS cloud, round(sum({_WORK}), 4) AS work FROM files GROUP BY ROLLUP (root)")
def count_by_root(spark, d):
    readable = ~F.col("dataless") & F.col("ext").isin(*EXTRACTABLE)
    return _files(spark, d).rollup("root").agg(F.count("*").alias("n"), F.count_if(readable).alias("readable"), F.count_if("dataless").alias("cloud"), F.round(F.sum(C.work_weight()), 4).alias("work"))


@BOOK.add(f"SELECT {_STALE} AS todo, round(sum({_WORK}), 4) AS work, round(sum({_WORK}) * 0.038, 4) AS seconds FROM files GROUP BY 1")
def work_sum(spark, d):
    work = F.sum(C.work_weight())
    return _files(spark, d).groupBy(C.stale().alias("todo")).agg(F.round(work, 4).alias("work"), F.round(work * 0.038, 4).alias("seconds"))


@BOOK.add("SELECT count(*) AS n, count(*) FILTER (WHERE status IN ('error', 'timeout')) AS failed, count(*) FILTER (WHERE status = 'ok') AS ok FROM files")
def counts_filtered(spark, d):
    return _files(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("error", "timeout")).alias("failed"), F.count_if(F.col("status") == "ok").alias("ok"))


@BOOK.add("SELECT id, path, error FROM files WHERE status IN ('error', 'timeout') ORDER BY mtime DESC, id LIMIT 50")
def errors_newest(spark, d):
    return _files(spark, d).where(F.col("status").isin("error", "timeout")).orderBy(F.desc("mtime"), "id").limit(50).select("id", "path", "error")


@BOOK.add("SELECT coalesce(root, 'every root') AS root, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY ROLLUP (root)")
def bytes_total(spark, d):
    return _files(spark, d).rollup("root").agg(F.sum("size").alias("bytes")).select(F.coalesce("root", F.lit("every root")).alias("root"), "bytes")


@BOOK.add("SELECT f.id, f.path, c.row, c.start, c.\"end\" FROM files f JOIN chunks c ON c.file_id = f.id WHERE NOT (c.start = 0 AND c.\"end\" = 0)")
def chunks_of_files(spark, d):
    content = read(spark, d, "chunks").where("not (start = 0 and end = 0)").withColumnRenamed("file_id", "id")
    return _files(spark, d).select("id", "path").join(content, "id").select("id", "path", "row", "start", "end")


@BOOK.add("SELECT row, substr(content, start + 1, \"end\" - start) AS body FROM chunks c JOIN lexical_index l ON l.id = c.file_id WHERE \"end\" > 0 AND content IS NOT NULL")
def chunk_text(spark, d):
    """The text of each chunk; a span beyond the content is cut at its end."""
    content = read(spark, d, "lexical_index").where("content is not null").select(F.col("id").alias("file_id"), "content")
    return read(spark, d, "chunks").where("end > 0").join(content, "file_id").select("row", F.expr("substring(content, start + 1, end - start)").alias("body"))


@BOOK.add("SELECT file_id, count(*) AS n, count(*) FILTER (WHERE before > start) AS overlapping FROM (SELECT file_id, start, lag(\"end\") OVER (PARTITION BY file_id ORDER BY start, row) AS before FROM chunks WHERE \"end\" > 0) x GROUP BY file_id")
def chunk_overlap(spark, d):
    from pyspark.sql import Window

    before = F.lag("end").over(Window.partitionBy("file_id").orderBy("start", "row"))
    rows = read(spark, d, "chunks").where("end > 0").withColumn("before", before)
    return rows.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("before") > F.col("start")).alias("overlapping"))


@BOOK.add("SELECT id, length(content) AS chars, content FROM lexical_index WHERE id IN (SELECT id FROM hits)")
def content_lookup(spark, d):
    """Stored content of the files that were hits, by a semi join on the id."""
    wanted = read(spark, d, "hits").select("id").distinct()
    rows = read(spark, d, "lexical_index").join(wanted, "id", "left_semi")
    return rows.select("id", F.length("content").cast("long").alias("chars"), "content")


@BOOK.add("""WITH m AS (SELECT row AS old, row_number() OVER (ORDER BY first, file_id, row) - 1 AS new FROM (SELECT row, file_id, min(row) OVER (PARTITION BY file_id) AS first FROM chunks) x)
SELECT m.new AS row, v.file_id, v.is_name, c.start, c."end" FROM m JOIN vectors v ON v.row = m.old AND v.file_id >= 0 JOIN chunks c ON c.row = m.old""")
def compact_vectors(spark, d):
    chunks, vectors = read(spark, d, "chunks"), read(spark, d, "vectors")
    c, v = C.renumber(chunks, vectors, C.compact(chunks))
    return v.select("row", "file_id", "is_name").join(c.select("row", "start", "end"), "row")


@BOOK.add("""SELECT (SELECT count(*) FROM files) AS files, (SELECT list((status, n) ORDER BY status) FROM (SELECT status, count(*) AS n FROM files GROUP BY 1) x) AS by_status, (SELECT list((kind, n) ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM files GROUP BY 1) x) AS by_kind,
  count(*) FILTER (WHERE file_id >= 0) AS vectors, round(avg(CASE WHEN file_id < 0 THEN 1.0 ELSE 0.0 END), 9) AS dead FROM vectors""".replace("list((status, n) ORDER BY status)", "map_from_entries(list((status, n) ORDER BY status))").replace("list((kind, n) ORDER BY kind)", "map_from_entries(list((kind, n) ORDER BY kind))"))
def status_report(spark, d):
    return C.status_report(_files(spark, d), read(spark, d, "vectors")).withColumn("dead", F.round("dead", 9))


@BOOK.add(f"""WITH r AS (SELECT DISTINCT root FROM scan_entries WHERE root IS NOT NULL), top AS (SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.root <> r.root AND starts_with(r.root, q.root || '/'))),
  e AS (SELECT DISTINCT path FROM scan_entries WHERE path IS NOT NULL),
  m AS (SELECT e.path, t.root, string_split(substr(e.path, length(t.root) + 2), '/') AS p FROM e LEFT JOIN top t ON starts_with(e.path, t.root || '/'))
SELECT path, root IS NULL OR len(list_filter(p[1:len(p) - 1], lambda x: starts_with(x, '.') OR list_contains([{_q(SKIPPED_FOLDERS)}], x) OR len(list_filter([{_q(SKIPPED_SUFFIXES)}], lambda y: ends_with(x, y))) > 0)) > 0
  OR starts_with(p[-1], '.') OR len(list_filter([{_q(SKIPPED_FILES)}], lambda g: p[-1] GLOB g)) > 0 AS excluded FROM m""")
def excluded_paths(spark, d):
    """Which paths of the scans lie in folders, or have names, that are left out."""
    rows = read(spark, d, "scan_entries").select("path", "root")
    roots = C.distinct_roots([r.root for r in rows.select("root").where("root is not null").distinct().collect()])  # roots are configured, few
    return rows.where("path is not null").select("path").distinct().select("path", sources.excluded(F.col("path"), roots).alias("excluded"))


@BOOK.add(f"""WITH w AS (SELECT root, sum({_WORK}) AS total, coalesce(sum({_WORK}) FILTER (WHERE NOT ({_STALE})), 0) AS done FROM files GROUP BY root)
SELECT root, CASE WHEN total > 0 THEN round_even(100 * done / total, 1) ELSE 0 END AS percent, CASE WHEN done / 2 > 0 THEN round(greatest(0, (total - done) * 60.0 / (done / 2)), 6) END AS seconds FROM w""")
def progress_by_root(spark, d):
    """How far the index of each root is, and the time left if half of it was done in the last minute."""
    work = C.work_weight()
    sums = _files(spark, d).groupBy("root").agg(F.sum(work).alias("total"), F.sum(F.when(C.stale(), 0.0).otherwise(work)).alias("done"))
    percent, left = C.progress(F.col("done"), F.col("total"), F.col("done") / 2, F.lit(60.0))
    return sums.select("root", percent.alias("percent"), F.round(left, 6).alias("seconds"))
