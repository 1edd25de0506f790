"""Tables kept in the shared folder of the cluster.

A table written here cuts the lineage of a plan: it survives the loss of an executor, because every executor reads
the same files. The folder is spark.checkpoint.dir; only where that is unset (local tests) a temporary one is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if "dir" not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        keep = tempfile.TemporaryDirectory(prefix="recall-")
        _local["dir"], _local["keep"] = f"file://{keep.name}", keep
    return _local["dir"]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system it lies on."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone
            pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; it is removed when the driver process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder, in a folder for each value of the column by if one is named, and return a scan of it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_folder"] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that materialize() gave, once nothing reads them any more, so that a lasting driver keeps no disk."""
    for df in tables:
        path = df.__dict__.pop("_folder", None)
        if path:
            remove(df.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores, where a scan has fewer partitions than there are cores, as of one small file.

    Large inputs have more partitions than cores and stay as they are, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows
