"""Named queries over the tables of a folder, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The moment queries are asked at: 2024-01-18 00:00 UTC, in epoch seconds. Never the clock.
NOW = 1705536000.0

Query = Callable[[SparkSession, str], DataFrame]


class Book(dict):
    """Queries by name, with their SQL."""

    def add(self, sql: str | None = None, name: str | None = None):
        def keep(f: Query) -> Query:
            self[name or f.__name__] = (f, sql)
            return f

        return keep


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
