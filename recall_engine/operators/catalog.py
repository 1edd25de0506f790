"""The catalogue of files: attributes, filters, snapshot differences, deletions and index upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recall_engine.functions.text import fold
from recall_engine.functions.vocabulary import EXT_KIND, EXTRACTABLE, KINDS, SENSITIVE, TEXT_LIKE

DAY = 86_400.0
#: Limits of what is extracted: bytes of a file, and chunks of one.
MAX_BYTES, MAX_CHUNKS = 50_000_000, 16


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_column(path), "/"), -1)


def extension(name: Column | str) -> Column:
    """Lower-cased text after the last dot, if there is a dot inside the name stripped of outer dots."""
    name = _column(name)
    return F.when(F.regexp_replace(name, r"^\.+|\.+$", "").contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def kind(ext: Column | str) -> Column:
    """Kind of an extension, 'other' if it has none; a literal map, so no join."""
    lookup = F.create_map(*[F.lit(x) for pair in EXT_KIND.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, _column(ext)), F.lit("other"))


def kind_extensions(kinds: list[str]) -> list[str]:
    """Extensions of kinds; none for an unknown kind, which then filters nothing."""
    return sorted({e for k in kinds for e in KINDS.get(k, ())})


def under_root(path: Column | str, roots: list[str]) -> tuple[Column, Column]:
    """Label (last folder) of the first root a path lies under, and its folders below it; '' and all folders without one."""
    path = _column(path)
    folder = F.regexp_replace(path, "/[^/]*$", "")
    label, below = F.lit(""), folder
    for root in reversed(roots):
        inside = path.startswith(root.rstrip("/") + "/")
        label = F.when(inside, root.rstrip("/").rsplit("/", 1)[-1]).otherwise(label)
        below = F.when(inside, F.substring(folder, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(below)
    return label, below


def display_parent(root: Column | str, rel_parent: Column | str) -> Column:
    base = F.when(_column(root) != "", F.concat(F.lit("~/"), _column(root))).otherwise("")
    return F.when(_column(rel_parent) != "", F.concat(base, F.lit("/"), _column(rel_parent))).otherwise(base)


def distinct_roots(roots: list[str]) -> list[str]:
    """Roots without those nested in another one, shortest first."""
    out: list[str] = []
    for r in sorted({x.rstrip("/") for x in roots}, key=lambda x: (x.count("/"), x)):
        if not any(r == u or r.startswith(u + "/") for u in out):
            out.append(r)
    return out


def attributes(entries: DataFrame, roots: list[str]) -> DataFrame:
    """Scan rows with name, ext, kind, root and rel_parent derived from their path."""
    label, below = under_root("path", roots)
    named = entries.withColumn("name", base_name("path"))
    return named.withColumn("ext", extension("name")).withColumn("kind", kind("ext")).withColumn("root", label).withColumn("rel_parent", below)


def status_before_extraction() -> Column:
    """dataless, skipped or too_big, in this order; null for a file whose text is to be extracted."""
    return F.when(F.col("dataless"), "dataless").when(~F.col("ext").isin(*EXTRACTABLE), "skipped").when(F.col("size") > MAX_BYTES, "too_big")


def stale() -> Column:
    """Whether an index entry is missing or behind the file."""
    behind = lambda c: F.col(c).isNull() | (F.col(c) != F.col("mtime"))
    return (F.col("status") == "pending") | behind("lexical_mtime") | behind("embedded_mtime")


def work_weight() -> Column:
    """Cost of a file in units of a small one: names only, or one and its likely chunks."""
    per_chunk = F.when(F.col("ext").isin(*TEXT_LIKE), 1100.0).otherwise(25_000.0)
    skip = F.col("dataless") | ~F.col("ext").isin(*EXTRACTABLE) | (F.col("size") > MAX_BYTES)
    return F.when(skip, 0.03).otherwise(1.0 + F.least(F.lit(float(MAX_CHUNKS)), F.col("size") / per_chunk))


def in_dates(start: Column | float, end: Column | float) -> Column:
    """Whether any time of a file is in [start, end); an unknown last use counts as time 0."""
    times = (F.col("mtime"), F.coalesce("last_used", F.lit(0.0)), F.col("ctime"))
    a, b, c = ((t >= start) & (t < end) for t in times)
    return a | b | c


def allowed(files: DataFrame, exts: list[str] | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """Files that pass the hard filters; no or an empty list of extensions filters nothing."""
    if exts:
        files = files.where(F.col("ext").isin(*exts))
    return files.where(in_dates(start, end)) if start is not None else files


def newest(files: DataFrame, limit: int) -> DataFrame:
    """The answer to a query of filters only: latest first, ties by id, score 1 / place."""
    top = files.orderBy(F.desc("mtime"), "id").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("mtime"), "id"))  # over the limited rows only
    return top.select("id", place.alias("place"), (1.0 / place).alias("score"))


def sensitive(path: Column | str = "path") -> Column:
    """Whether a lower-cased path holds a word that keeps a file out of samples."""
    return F.lower(_column(path)).rlike("|".join(SENSITIVE))


def latest_scan(entries: DataFrame, gen: int | None = None) -> DataFrame:
    """The last observation of each path of a scan; rows of failed stats and repeated deliveries leave no trace."""
    rows = entries.where("size is not null and mtime is not null and path is not null")
    rows = rows.where(F.col("gen") == gen) if gen is not None else rows
    pick = F.max(F.struct("observed", "entry_id", "size", "mtime", "last_used", "dataless", "root"))
    return rows.groupBy("path").agg(pick.alias("s")).select("path", "s.size", "s.mtime", "s.last_used", "s.dataless", "s.root")


def snapshot_diff(scan: DataFrame, files: DataFrame) -> DataFrame:
    """path, id and change: new, changed, same or gone. Changed: another size or mtime, or a placeholder no more."""
    old = files.select("path", "id", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("dataless").alias("old_dataless"))
    both = scan.select("path", "size", "mtime", "dataless", F.lit(True).alias("there")).join(old, "path", "full_outer")
    different = (F.col("size") != F.col("old_size")) | (F.col("mtime") != F.col("old_mtime")) | (F.col("old_dataless") & ~F.col("dataless"))
    change = F.when(F.col("id").isNull(), "new").when(F.col("there").isNull(), "gone").when(different, "changed").otherwise("same")
    return both.select("path", "id", change.alias("change"))


def apply_diff(files: DataFrame, scan: DataFrame, gen: int, roots: list[str], live_roots: list[str]) -> DataFrame:
    """The next catalogue: new and changed files pending, same ones marked as seen, gone ones deleted unless their root is
    out of reach. New ids follow the largest one in the order of paths, by ranges of sorted rows."""
    diff = snapshot_diff(scan, files)
    seen = attributes(scan.select("path", "size", "mtime", "last_used", "dataless"), roots)
    fresh = seen.join(diff.where("change in ('new', 'changed')").select("path", "id", "change"), "path")
    base = files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = fresh.where("change = 'new'").drop("id", "change")
    numbered = numbered_rows(new, ["path"]).withColumn("id", F.lit(base) + F.col("number")).drop("number")
    changed = fresh.where("change = 'changed'").drop("change")
    born = files.select("id", "ctime")
    reset = numbered.withColumn("ctime", F.col("mtime")).unionByName(changed.join(born, "id"))
    empty = {"status": F.lit("pending"), "error": F.lit(None).cast("string"), "content_chars": F.lit(0), "lexical_mtime": F.lit(None).cast("double"), "embedded_mtime": F.lit(None).cast("double"), "seen": F.lit(gen).cast("long")}
    reset = reset.withColumns(empty).select(*files.columns)
    same = files.join(diff.where("change = 'same'").select("path"), "path", "left_semi").drop("last_used", "dataless").join(scan.select("path", "last_used", "dataless"), "path").withColumn("seen", F.lit(gen).cast("long")).select(*files.columns)
    lost = files.join(diff.where("change = 'gone'").select("path"), "path", "left_semi").where(~deletable("path", roots, live_roots))
    return reset.unionByName(same).unionByName(lost)


def numbered_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with number 1, 2, ... in the order of the columns by, without a window over all rows in one task."""
    from recall_engine.plans.tables import materialize

    ranges = materialize(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    # as many rows as tasks
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return ranges.join(F.broadcast(before), "_part").withColumn("number", own + F.col("_before")).drop("_part", "_before")


def places(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows with place 0, 1, ... within their key in the order of the columns by, however many rows a key has."""
    numbered = numbered_rows(rows, [key, *by])
    first = numbered.groupBy(key).agg(F.min("number").alias("_first"))
    return numbered.join(first, key).withColumn("place", F.col("number") - F.col("_first")).drop("number", "_first")


def deletable(path: Column | str, roots: list[str], live_roots: list[str]) -> Column:
    """Whether a missing file may be deleted: its root is in reach, or it lies under no root."""
    path = _column(path)
    under = lambda some: F.coalesce(F.greatest(*[path.startswith(r.rstrip("/") + "/") for r in some]) if len(some) > 1 else path.startswith(some[0].rstrip("/") + "/") if some else F.lit(False), F.lit(False))
    return under(live_roots) | ~under(roots)


def in_folder(folder: str, path: Column | str = "path") -> Column:
    """A path itself or anything below it."""
    path = _column(path)
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def cascade_delete(files: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, chunks and vectors without the files gone(id); vectors stay as dead rows of file -1."""
    ids = gone.select("id").distinct()
    owners = ids.withColumnRenamed("id", "file_id")
    dead = vectors.join(owners.withColumn("_dead", F.lit(True)), "file_id", "left")
    marked = dead.withColumn("file_id", F.when(F.col("_dead"), F.lit(-1).cast("long")).otherwise(F.col("file_id"))).select(*vectors.columns)
    return files.join(ids, "id", "left_anti"), chunks.join(owners, "file_id", "left_anti").select(*chunks.columns), marked


def compact(chunks: DataFrame) -> DataFrame:
    """old and new row numbers of live chunks: files in order of their first row, the rows of a file together."""
    first = chunks.groupBy("file_id").agg(F.min("row").alias("first"))
    ordered = numbered_rows(chunks.select("row", "file_id").join(first, "file_id"), ["first", "file_id", "row"])
    return ordered.select(F.col("row").alias("old"), (F.col("number") - 1).cast("long").alias("new"))


def renumber(chunks: DataFrame, vectors: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and vectors with the rows of compact(); dead vectors are left out."""
    old = mapping.select(F.col("old").alias("row"), "new")
    moved = lambda df: df.join(old, "row").drop("row").withColumnRenamed("new", "row").select(*df.columns)
    return moved(chunks), moved(vectors.where("file_id >= 0"))


def needs_compaction(vectors: DataFrame, share: float = 0.3) -> bool:
    """Whether so many vectors are dead that they should be rewritten."""
    dead = vectors.agg(F.avg((F.col("file_id") < 0).cast("double"))).first()[0]
    return dead is not None and dead >= share


def progress(done: Column | float, total: Column | float, session: Column | float, elapsed: Column | float) -> tuple[Column, Column]:
    """Percent done, to one digit, and seconds left: none in the first five seconds or without work done in this session."""
    done, total, session, elapsed = (x if isinstance(x, Column) else F.lit(float(x)) for x in (done, total, session, elapsed))
    percent = F.when(total > 0, F.bround(100 * done / total, 1)).otherwise(0.0)
    left = F.when((elapsed >= 5) & (session > 0), F.greatest(F.lit(0.0), (total - done) * elapsed / session))
    return percent, left


def status_report(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: files, by_status and by_kind as maps, live vectors and the share of dead ones."""
    counted = lambda c: files.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    rows = files.agg(F.count("*").alias("files"))
    live = vectors.agg(F.count_if(F.col("file_id") >= 0).alias("vectors"), F.avg((F.col("file_id") < 0).cast("double")).alias("dead"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    out = one(rows)
    for part in (counted("status"), counted("kind"), live):
        out = out.join(one(part), "_one")
    return out.drop("_one")
