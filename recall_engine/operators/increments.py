"""Problem 2: each run processes the records that are new or changed since the last successful one.

Method: the state of every key is kept with a hash of its content. A run hashes the rows that arrived since the last
successful run, joins them with the state, tells new and changed keys, and writes the next version of the state to a
folder of its own; one rename (plans.versions) makes that version the current one. A run that fails before the rename has
committed nothing: the next one reads the same state and the same rows again. A run that is repeated after its rename
gives the cases it committed and changes nothing. So no record is skipped or repeated. Late rows belong to the run that
first sees them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from recall_engine.plans.tables import materialize, new_folder, remove
from recall_engine.plans.versions import Versions

#: The state of a path: two hashes of it, the last observation, a hash of size and mtime, and whether it is a placeholder.
STATE = "k1 long, k2 long, observed timestamp_ntz, entry_id long, content long, dataless boolean"
_VERSION = f"{STATE}, path string, changed boolean"


@F.pandas_udf(T.StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(x: Column | str) -> Column:
    """Composed Unicode; null stays null. Only texts beyond ASCII go to Python."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(_composed(F.when(x.rlike(r"[^\x00-\x7f]"), x)), x)


def _keys(path: Column) -> list[Column]:
    """128 bits of a path: two paths of ten billion agree with probability 1 in 10 ** 18."""
    return [F.xxhash64(path).alias("k1"), F.xxhash64(F.lit("second"), path).alias("k2")]


class StateStore:
    """Versions of the state in a folder. The cases of every run stay; of the states, the current one and the one before,
    which may still be read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, folder)

    def current(self) -> dict | None:
        """number, run_id, seen (started of that run) and data (the folder) of the last commit, if there is one."""
        return self.versions.current()

    def _read(self, data: str) -> DataFrame:
        return self.spark.read.schema(_VERSION).parquet(data)

    def state(self, at: dict | None = None) -> DataFrame:
        """The rows of a commit's version, by default of the current one."""
        at = at or self.current()
        return self._read(at["data"]) if at else self.spark.createDataFrame([], _VERSION)

    def cases(self, run_id: int) -> DataFrame | None:
        """run_id, path of what a run committed; None if it has committed nothing."""
        for n in reversed(self.versions.numbers()):
            at = self.versions.commit_of(n)
            if at["run_id"] == run_id:
                return self._cases(at)
        return None

    def _cases(self, at: dict) -> DataFrame:
        return self._read(at["data"]).where("changed").select(F.lit(at["run_id"]).cast("long").alias("run_id"), "path")

    def publish(self, number: int, data: str, run_id: int, seen: str) -> None:
        """Make a version the current one and remove what no run can need any more."""
        if not self.versions.publish(number, data, run_id=run_id, seen=seen):
            raise RuntimeError(f"another run has committed version {number} of {self.folder}")
        self.versions.drop_abandoned(number - 1)
        if number >= 2:
            self.versions.drop(f"{self.versions.commit_of(number - 2)['data']}/changed=false")


def usable(entries: DataFrame) -> DataFrame:
    """The columns of scan rows that matter, without rows that lack a path, size, mtime, observation or arrival."""
    needed = ("path", "size", "mtime", "observed", "arrived", "entry_id")
    kept = entries
    for c in needed:
        kept = kept.where(F.col(c).isNotNull())
    return kept.select("path", "size", "mtime", F.coalesce("dataless", F.lit(False)).alias("dataless"), F.col("observed").cast("timestamp_ntz").alias("observed"), F.col("arrived").cast("timestamp_ntz").alias("arrived"), "entry_id")


def process(entries: DataFrame, store: StateStore, run_id: int, started: str, succeeds: bool = True) -> DataFrame | None:
    """One run over scan rows (usable()): run_id, path of what is new or changed, committed with the next state.

    started: the rows that arrived until then are seen. succeeds=False does the work and stops before the commit, as a
    failure would, and gives None. A run_id that has committed before gives its cases of then, whatever the rows are now.
    A path is a case if its state didn't exist at the last commit, has another size or mtime, or is dataless no more.
    Rows delivered twice and late rows change nothing that is newer. Of a path seen twice at one moment the greater
    entry_id counts. The rows of the run are aggregated before their shuffle; the state is joined by hashes of the path,
    without the path itself. If another run commits first, this one raises and can be repeated.
    """
    done = store.cases(run_id)
    if done is not None:
        return done
    at = store.current()
    number = at["number"] + 1 if at else 0
    moment = lambda x: F.lit(x).cast("timestamp_ntz")
    fresh = entries.where(F.col("arrived") <= moment(started))
    if at:
        fresh = fresh.where(F.col("arrived") > moment(at["seen"]))
    hashed = fresh.select(nfc("path").alias("path"), "observed", "entry_id", F.xxhash64("size", "mtime").alias("content"), "dataless")
    hashed = hashed.select(*_keys(F.col("path")), F.struct("observed", "entry_id", "content", "dataless", "path").alias("s"))
    latest = hashed.groupBy("k1", "k2").agg(F.max("s").alias("s")).select("k1", "k2", *[F.col(f"s.{c}").alias(f"new_{c}") for c in ("observed", "entry_id", "content", "dataless", "path")])
    old = store.state(at).select("k1", "k2", "observed", "entry_id", "content", "dataless")
    both = old.join(latest, ["k1", "k2"], "full_outer")
    newer = F.col("new_observed").isNotNull() & (F.col("observed").isNull() | (F.struct("new_observed", "new_entry_id") > F.struct("observed", "entry_id")))
    changed = newer & (F.col("observed").isNull() | (F.col("new_content") != F.col("content")) | (F.col("dataless") & ~F.col("new_dataless")))
    take = lambda c: F.when(newer, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    # the path is kept with the version for the cases only; the two parts are folders, so that a state can go and its cases stay
    following = both.select("k1", "k2", *[take(c) for c in ("observed", "entry_id", "content", "dataless")], F.when(changed, F.col("new_path")).alias("path"), F.coalesce(changed, F.lit(False)).alias("changed"))
    data = store.versions.data_folder(number)
    following.write.partitionBy("changed").parquet(data)
    if not succeeds:
        return None
    store.publish(number, data, run_id, started)
    return store.cases(run_id)


def replay(entries: DataFrame, runs: DataFrame, folder: str | None = None) -> DataFrame:
    """run_id, path of the cases of every run with status ok, the runs taken in the order of their starts.

    Runs that did not succeed do their work too and stop before their commit; those without a start see nothing. An empty
    table of either kind gives no rows. The table of runs is a fixed log, which the driver walks; the rows are first laid
    out by the run that sees them first, so that a run reads no others.
    """
    spark = entries.sparkSession
    store = StateStore(spark, folder or new_folder(spark, "increments"))
    known = runs.where("started is not null and run_id is not null").select("run_id", "status", F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started")).distinct().orderBy("started", "run_id").collect()
    starts = F.array(*[F.lit(r.started).cast("timestamp_ntz") for r in known]).cast("array<timestamp_ntz>")
    slot = F.size(F.filter(starts, lambda s: s < F.col("arrived")))
    rows = materialize(usable(entries).withColumn("slot", slot).where(F.col("slot") < len(known)), "arrivals", by="slot")
    out, seen, done = None, -1, set()
    for i, r in enumerate(known):
        if r.run_id in done:
            continue  # a repetition of a run that has committed
        mine = rows.where((F.col("slot") > seen) & (F.col("slot") <= i)).drop("slot")
        cases = process(mine, store, r.run_id, r.started, r.status == "ok")
        if r.status == "ok":
            out, seen = cases if out is None else out.unionByName(cases), i
            done.add(r.run_id)
    return out if out is not None else spark.createDataFrame([], "run_id long, path string")


def forget(store: StateStore) -> None:
    """Remove the state, so that the next run sees every record as new."""
    remove(store.spark, store.folder)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(spark.read.parquet(f"{sf_dir}/scan_entries.parquet"), spark.read.parquet(f"{sf_dir}/index_runs.parquet"))


P2_SQL = """
WITH runs AS (
  SELECT run_id, started, lag(started) OVER (ORDER BY started, run_id) AS before FROM index_runs WHERE status = 'ok' AND started IS NOT NULL
), rows AS (
  SELECT nfc_normalize(path) AS path, size, mtime, dataless, observed, arrived, entry_id FROM scan_entries
  WHERE size IS NOT NULL AND mtime IS NOT NULL AND path IS NOT NULL
), states AS (
  SELECT r.run_id, e.path, r.before, arg_max({'s': e.size, 'm': e.mtime, 'd': e.dataless}, {'o': e.observed, 'e': e.entry_id}) AS now,
    arg_max({'s': e.size, 'm': e.mtime, 'd': e.dataless}, {'o': e.observed, 'e': e.entry_id}) FILTER (WHERE e.arrived <= r.before) AS was
  FROM runs r JOIN rows e ON e.arrived <= r.started GROUP BY r.run_id, e.path, r.before
)
SELECT CAST(run_id AS BIGINT) AS run_id, path FROM states
WHERE was IS NULL OR was.s <> now.s OR was.m <> now.m OR (was.d AND NOT now.d)
"""
