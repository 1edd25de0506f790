"""Joins of many rows with one row per key, where a key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a key from which its rows are spread over several tasks, as many as this size fits.
HOT = 200_000
#: Hot keys that may be broadcast. There are at most rows / HOT.
KEYS = 100_000


def join_totals(rows: DataFrame, totals: DataFrame, key: str, spread_by: str, hot: int = HOT) -> DataFrame:
    """Inner join of rows with totals, which has one row per key and the number of its rows in n.

    The rows of a key with more than hot rows are salted by a hash of spread_by and its total is copied to each salt.
    """
    large = totals.where(F.col("n") > hot).select(key, F.ceil(F.col("n") / hot).cast("int").alias("salts"))
    if large.isEmpty():
        return rows.join(totals, key)
    small = large.count() <= KEYS
    salted = rows.join(F.broadcast(large) if small else large, key, "left")
    salted = salted.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.col("salts")))).drop("salts")
    copies = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.when(F.col("n") > hot, F.ceil(F.col("n") / hot) - 1).otherwise(0)).cast("int"))))
    return salted.join(copies.withColumn("salt", F.col("salt").cast("long")), [key, "salt"]).drop("salt")
