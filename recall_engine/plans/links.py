"""Links between classes of equal rows, expanded to links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a class that meet in one task; a larger class is split into blocks, and each pair of blocks is joined on its own.
BLOCK = 4096


def expand(pairs: DataFrame, members: DataFrame, full: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links between rows from links between classes: all of them, unless full is given.

    pairs(rep_a, rep_b): distinct links between representatives. members(id, rep, size, tag): one row per row; size is
    the size of its class, rep its smallest id. Rows of one tag are not linked (a null tag links to all). With full, a
    class above that size is linked through its representative and its smallest row of another tag only, for what needs
    connections rather than pairs.
    Returns (id_a, id_b), id_a < id_b. Empty inputs give no rows.
    """
    free = F.coalesce(F.col("tag_a") != F.col("tag_b"), F.lit(True))
    kept = members.select("id", "rep", "size", "tag")
    if full is not None:
        large = kept.where(F.col("size") > full)
        first = large.where(F.col("id") == F.col("rep")).select("rep", F.col("id").alias("a"), F.col("tag").alias("tag_a"))
        other = large.withColumnRenamed("tag", "tag_b").join(first, "rep").where(F.col("tag_a").isNotNull() & free)
        second = other.groupBy("rep").agg(F.min(F.struct("id", "tag_b")).alias("x")).select("rep", "x.id", "x.tag_b")
        heads = first.unionAll(second)
        kept = kept.where(F.col("size") <= full).unionByName(heads.select(F.col("a").alias("id"), "rep", F.lit(1).cast("long").alias("size"), F.col("tag_a").alias("tag")))
    blocks = F.ceil(F.col("size") / block).cast("int")
    split = kept.where(F.col("size") > block).groupBy("rep").agg(F.max(blocks).alias("blocks"))
    same = kept.where("size > 1").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).distinct()
    every = pairs.select("rep_a", "rep_b").unionByName(same)
    for x in "ab":
        every = every.join(split.select(F.col("rep").alias(f"rep_{x}"), F.col("blocks").alias(f"blocks_{x}")), f"rep_{x}", "left")
        every = every.withColumn(f"block_{x}", F.explode(F.sequence(F.lit(0), F.coalesce(f"blocks_{x}", F.lit(1)) - 1)))
    every = every.where((F.col("rep_a") != F.col("rep_b")) | (F.col("block_a") <= F.col("block_b")))
    side = lambda x: kept.select(F.col("rep").alias(f"rep_{x}"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias(f"block_{x}"), F.col("id").alias(x), F.col("tag").alias(f"tag_{x}"))
    met = every.join(side("a"), ["rep_a", "block_a"]).join(side("b"), ["rep_b", "block_b"]).where(free)
    met = met.where((F.col("rep_a") != F.col("rep_b")) | (F.col("block_a") < F.col("block_b")) | (F.col("a") < F.col("b"))).select("a", "b")
    if full is not None:
        right = large.select("rep", F.col("id").alias("b"), F.col("tag").alias("tag_b"))
        met = met.unionByName(right.join(heads, "rep").where((F.col("b") != F.col("a")) & (F.col("b") != F.col("rep")) & free).select("a", "b"))
    return met.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
