"""Folders as tables: a walk that leaves folders out before it looks into them, and the bytes of what it finds.

Folders are walked by the workers in rounds: each goes through its folders until it has seen so many entries and hands
back those it has not looked into, which the next round spreads over all workers.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recall_engine.functions.vocabulary import PACKAGES, SKIPPED_FILES, SKIPPED_FOLDERS, SKIPPED_SUFFIXES
from recall_engine.operators.catalog import MAX_BYTES, attributes, distinct_roots
from recall_engine.operators.increments import nfc
from recall_engine.plans.tables import materialize

#: Entries a worker sees below one folder of a round before it hands the rest back.
BUDGET = 10_000


def _regex(globs: tuple[str, ...] | list[str]) -> str:
    """One pattern that matches a whole name by any of the globs."""
    return "^(?:" + "|".join(re.sub(r"\\Z$|\\z$", "", fnmatch.translate(g)) for g in globs) + ")$" if globs else "(?!)"


def excluded(path: Column, roots: list[str], folders: tuple[str, ...] = SKIPPED_FOLDERS, files: tuple[str, ...] = SKIPPED_FILES) -> Column:
    """Whether a path lies under no root, in a hidden or skipped folder, or has a hidden or skipped name."""
    inside, below = F.lit(False), path
    for root in reversed([r.rstrip("/") for r in roots]):
        under = path.startswith(root + "/")
        inside, below = inside | under, F.when(under, F.substring(path, len(root) + 2, 1 << 20)).otherwise(below)
    parts = F.split(below, "/")
    parents, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    suffix = "(?:" + "|".join(map(re.escape, SKIPPED_SUFFIXES)) + ")$"
    skipped = F.exists(parents, lambda p: p.startswith(".") | p.isin(*folders) | p.rlike(suffix))
    return ~inside | skipped | name.startswith(".") | name.rlike(_regex(files))


@dataclass(frozen=True)
class Child:
    """An entry of a folder. Symbolic links are none."""

    name: str
    path: str
    is_folder: bool
    size: int
    mtime: float
    ctime: float | None


def children(folder: str) -> Iterator[Child]:
    """Entries of a folder of the local file system, or by its address of another one; what can't be read is left out."""
    if "://" in folder and not folder.startswith("file:"):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        base = folder.rstrip("/")
        for x in system.get_file_info(fs.FileSelector(path)):
            if x.type in (fs.FileType.File, fs.FileType.Directory):
                yield Child(x.base_name, f"{base}/{x.base_name}", x.type == fs.FileType.Directory, x.size or 0, x.mtime.timestamp() if x.mtime else 0.0, None)
        return
    with os.scandir(re.sub("^file:(?://)?", "", folder)) as entries:
        for x in entries:
            try:
                if not x.is_symlink() and (x.is_dir(follow_symlinks=False) or x.is_file(follow_symlinks=False)):
                    s = x.stat(follow_symlinks=False)
                    yield Child(x.name, x.path, x.is_dir(follow_symlinks=False), s.st_size, s.st_mtime, s.st_ctime)
            except OSError:
                continue


_FOUND = "root string, raw string, size long, mtime double, ctime double, what string"


def walk(spark: SparkSession, roots: list[str], folders: tuple[str, ...] = SKIPPED_FOLDERS, files: tuple[str, ...] = SKIPPED_FILES, budget: int = BUDGET) -> DataFrame:
    """raw (path as it is), size, mtime, ctime of every file and package under the roots.

    Hidden and skipped folders are not looked into, nor are virtual environments, which are told by the file that marks
    them; hidden and skipped files, links and what can't be read are left out. A package is one entry of size 0 with the
    time of its folder. The rounds run while the plan is built.
    """
    skipped_file, skipped_end = re.compile(_regex(files)), SKIPPED_SUFFIXES
    names = frozenset(folders)

    def look(folder: str) -> tuple[list[tuple], list[str]]:
        """Rows of the files and packages of a folder, and the folders in it that are to be walked."""
        try:
            inside = list(children(folder))
        except OSError:
            return [], []
        if any(c.name == "pyvenv.cfg" for c in inside) and folder not in roots:
            return [], []
        rows, below = [], []
        for c in inside:
            if c.is_folder:
                ext = c.name.rpartition(".")[2].lower() if "." in c.name else ""
                if ext in PACKAGES and not c.name.startswith("."):
                    rows.append((c.path, 0, c.mtime, c.ctime, "package"))
                elif not (c.name in names or c.name.startswith(".") or c.name.endswith(skipped_end)):
                    below.append(c.path)
            elif not (c.name.startswith(".") or skipped_file.match(c.name)):
                rows.append((c.path, c.size, c.mtime, c.ctime, "file"))
        return rows, below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                todo, out, seen = [start], [], 0
                while todo and seen < budget:
                    rows, below = look(todo.pop())
                    out += rows
                    todo += below
                    seen += len(rows) + len(below) + 1
                out += [(path, 0, 0.0, None, "folder") for path in todo]
                columns = zip(*out, strict=True) if out else ((),) * 5
                types = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(out), pa.string()), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=["root", "raw", "size", "mtime", "ctime", "what"])

    frontier = spark.createDataFrame([(r, r) for r in roots], "root string, raw string")
    out = None
    while frontier is not None:
        cores = spark.sparkContext.defaultParallelism
        found = materialize(frontier.repartition(cores * 4, F.xxhash64("raw")).mapInArrow(run, _FOUND), "walked")
        kept = found.where("what <> 'folder'").select("raw", "size", "mtime", "ctime", "what")
        out = kept if out is None else out.unionByName(kept)
        left = found.where("what = 'folder'").select("root", "raw")
        frontier = None if left.isEmpty() else left
    return out


def with_content(found: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of walk() with the bytes of each file; null for a package, for more than max_bytes, and for what can't be read."""

    def read(path: str) -> bytes | None:
        try:
            if "://" in path and not path.startswith("file:"):
                from pyarrow import fs

                system, inside = fs.FileSystem.from_uri(path)
                with system.open_input_stream(inside) as f:
                    return f.read()
            with open(re.sub("^file:(?://)?", "", path), "rb") as f:
                return f.read()
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row at a time, as one may have many bytes
                row = b.slice(i, 1)
                wanted = row.column("what")[0].as_py() == "file" and row.column("size")[0].as_py() <= max_bytes
                content = read(row.column("raw")[0].as_py()) if wanted else None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], names=[*row.schema.names, "content"])

    return found.mapInArrow(run, "raw string, size long, mtime double, ctime double, what string, content binary")


def scan(spark: SparkSession, roots: list[str], content: bool = False, folders: tuple[str, ...] = SKIPPED_FOLDERS, files: tuple[str, ...] = SKIPPED_FILES) -> DataFrame:
    """path (composed Unicode), size, mtime and ctime (epoch seconds), name, ext, kind, root, rel_parent[, content] of
    everything walk() finds under the roots."""
    roots = distinct_roots(roots)
    found = walk(spark, roots, folders, files)
    rows = with_content(found) if content else found
    plain = nfc(F.regexp_replace("raw", "^file:(?://)?", ""))
    return attributes(rows.select(plain.alias("path"), "size", "mtime", "ctime", *(["content"] if content else [])), roots)
