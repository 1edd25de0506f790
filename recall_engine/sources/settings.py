"""Settings from a TOML file over defaults, and the files of an evaluation."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from recall_engine.functions.vocabulary import SKIPPED_FILES, SKIPPED_FOLDERS


@dataclass(frozen=True)
class Settings:
    """What is scanned and how much is extracted."""

    roots: tuple[str, ...] = ("~/Documents", "~/Desktop", "~/Downloads")
    exclude_dirs: tuple[str, ...] = SKIPPED_FOLDERS
    exclude_files: tuple[str, ...] = SKIPPED_FILES
    max_content_mb: float = 50
    max_content_chars: int = 200_000
    extract_timeout_s: float = 20
    max_chunks_per_file: int = 16
    rerank: bool = True


def load(path: str | None = None) -> Settings:
    """Defaults, overlaid by the known keys of a TOML file; unknown keys and a missing file change nothing."""
    given: dict = {}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            given = tomllib.load(f)
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})


def read_queries(spark: SparkSession, path: str, home: str = "") -> DataFrame:
    """query, expected of a file with a JSON object per line; blank lines and those that begin with # are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not line like '#%'")
    rows = lines.select(F.from_json("line", "query string, expected array<string>").alias("x")).select("x.*")
    return rows.withColumn("expected", F.transform("expected", lambda p: F.regexp_replace(p, "^~", home or os.path.expanduser("~"))))


def write_queries(queries: DataFrame, path: str, home: str = "") -> None:
    """Write query, expected[, source] as JSON lines, with the home folder as ~."""
    short = F.transform("expected", lambda p: F.replace(p, F.lit(home or os.path.expanduser("~")), F.lit("~")))
    queries.withColumn("expected", short).write.mode("overwrite").json(path)


def report(rows: list[dict]) -> str:
    """A Markdown table of variants with MRR, recall and latency."""
    head = "| Variant | MRR | R@1 | R@3 | R@10 | p50 | p95 |\n| --- | --- | --- | --- | --- | --- | --- |"
    line = "| {variant} | {mrr:.3f} | {r1:.0%} | {r3:.0%} | {r10:.0%} | {p50:.0f} ms | {p95:.0f} ms |"
    return "\n".join([head, *(line.format(**r) for r in rows)])
