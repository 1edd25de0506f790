"""Versions of data in the shared folder, of which a small file names the current one.

A version is written to a folder of its own that is never written again; publishing it renames a file that was written
aside to the next number, which happens whole or not at all and only if nobody has taken that number. This needs a file
system with an atomic rename that refuses an existing target, as HDFS and those of its kind have; on a plain object store
keep the folder of commits on such a file system.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from recall_engine.plans.tables import remove


class Versions:
    """Numbered commits in a folder; each is a JSON object that names the data folder of its version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        sc = spark.sparkContext
        self._jvm, self._conf = sc._jvm, sc._jsc.hadoopConfiguration()
        at = self._path(self.folder)
        self._fs = at.getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _names(self, start: str) -> list[str]:
        at = self._path(self.folder)
        found = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in found if n.startswith(start))

    def numbers(self) -> list[int]:
        """Numbers of the commits there are, ascending."""
        return [int(n.removeprefix("commit-")) for n in self._names("commit-")]

    def commit_of(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/commit-{number:09d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> dict | None:
        """The last commit, with its number."""
        numbers = self.numbers()
        return self.commit_of(numbers[-1]) if numbers else None

    def data_folder(self, number: int) -> str:
        """Where an attempt at a version may write; another attempt gets another folder."""
        return f"{self.folder}/data-{number:09d}-{uuid.uuid4().hex}"

    def publish(self, number: int, data: str, **more: object) -> bool:
        """Make a data folder the version of a number; False if that number is taken."""
        aside, final = self._path(f"{self.folder}/aside-{uuid.uuid4().hex}"), self._path(f"{self.folder}/commit-{number:09d}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps({**more, "number": number, "data": data}).encode()))
        out.close()
        # without options the rename refuses a target that exists
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(aside, final, none)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e) or self._fs.exists(final):
                return False
            raise
        return True

    def drop(self, path: str) -> None:
        remove(self.spark, path)

    def drop_abandoned(self, number: int) -> None:
        """Remove the folders of attempts at a version that another attempt published, if there is that version. Call it for
        the version before the last: attempts at the last may still be under way, to be refused when they end."""
        if number < 0:
            return
        kept = self.commit_of(number)["data"].rsplit("/", 1)[-1]
        for name in self._names(f"data-{number:09d}-"):
            if name != kept:
                self.drop(f"{self.folder}/{name}")

    def forget_before(self, number: int) -> None:
        """Remove commits below a number together with their data."""
        for n in self.numbers():
            if n < number:
                self.drop(self.commit_of(n)["data"])
                self.drop(f"{self.folder}/commit-{n:09d}")
