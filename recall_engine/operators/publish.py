"""The text index and the catalogue, published together and names first.

A first version makes every file findable by its name and folders before any content is read; the second one has the
content. Of each the index is written first and the catalogue after it, into one folder, and one commit makes both the
current ones, so a reader never sees an index without its catalogue. A run that is interrupted goes on with the stage it
was in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from recall_engine.operators import lexical as L
from recall_engine.plans.versions import Versions

NAMES, CONTENT = "names", "content"


@dataclass(frozen=True)
class Published:
    """What readers see: the index, the catalogue it belongs to, the stage and the state of the source."""

    index: L.TextIndex
    files: DataFrame
    stage: str
    state: str


def published(spark: SparkSession, folder: str) -> Published | None:
    """The current version, if there is one."""
    at = Versions(spark, folder).current()
    if at is None:
        return None
    return Published(L.load(spark, f"{at['data']}/index"), spark.read.parquet(f"{at['data']}/files"), at["stage"], at["state"])


def _publish(spark: SparkSession, folder: str, records: DataFrame, files: DataFrame, stage: str, state: str, stem: bool) -> None:
    versions = Versions(spark, folder)
    at = versions.current()
    number = at["number"] + 1 if at else 0
    data = versions.data_folder(number)
    L.save(L.build(records, stem, keep=False), f"{data}/index")
    files.write.parquet(f"{data}/files")
    if not versions.publish(number, data, stage=stage, state=state):
        raise RuntimeError(f"another run has published version {number} of {folder}")
    versions.drop_abandoned(number - 1)
    versions.forget_before(number - 1)


def index_names_first(spark: SparkSession, folder: str, files: DataFrame, records: DataFrame, contents: Callable[[], DataFrame], state: str, stem: bool = False) -> Published:
    """Publish the names of records(id, name, path), then all of contents(), which gives (id, content) and may take long.

    files is the catalogue; a file counts as indexed (lexical_mtime is its mtime) once its content is. state names the
    state of the source: what is published for it already is not done again, be it the names only or all.
    """
    done = published(spark, folder)
    stage = done.stage if done and done.state == state else None
    names = records.select("id", "name", "path")
    if stage is None:
        waiting = files.withColumn("lexical_mtime", F.lit(None).cast("double"))
        _publish(spark, folder, names.withColumn("content", F.lit(None).cast("string")), waiting, NAMES, state, stem)
    if stage != CONTENT:
        texts = contents().select("id", "content")
        indexed = files.drop("lexical_mtime").join(texts.select("id", F.lit(True).alias("_read")), "id", "left")
        indexed = indexed.withColumn("lexical_mtime", F.when(F.col("_read"), F.col("mtime"))).select(*files.columns)
        _publish(spark, folder, names.join(texts, "id", "left"), indexed, CONTENT, state, stem)
    return published(spark, folder)
