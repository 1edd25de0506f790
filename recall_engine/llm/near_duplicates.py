"""Problem 6: records whose texts are the same but for small edits, insertions or moved passages.

Method: bit-sliced comparison. A text becomes 128 bits, each a bit of a minimum over its shingles, so that the expected
share of equal bits is (1 + similarity) / 2. Texts that share all minima of any band meet in a bucket; there the bits
stand in vertical planes, many distances are updated at once by carry-save counters, and words of the block whose
distances all exceed the radius are abandoned. What remains is checked exactly on the sets of shingles. Bands and their
minima follow from the similarity (banding()): a pair that is just as similar misses all bands with probability 0.2 % at
most (at 0.6, 14 bands of two minima), and the radius with 1 in 10 000.

Equal sets of shingles are one class from the start: only its representative is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recall_engine.llm.bitslice import group_pairs
from recall_engine.llm.words import Words, mix, ragged, shingles, slices
from recall_engine.plans.links import expand
from recall_engine.plans.tables import materialize, release, spread

BITS = 128
#: Probability at most that a pair of the similarity asked for meets in no band, and bands at most where a band has several minima.
MISS, BANDS = 0.002, 20
#: Distance in bits up to which a pair is checked exactly: mean and 4.3 standard deviations at similarity 0.6.
RADIUS = 45
#: Rows of a bucket that one task compares with each other; a larger bucket is split into blocks, each pair of blocks a task.
BLOCK = 4096
#: Ids or keys that may be broadcast; a larger set is joined by a shuffle.
SMALL = 500_000
_rng = np.random.default_rng(20240131)
_MULTIPLIERS = _rng.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)



def banding(similarity: float) -> tuple[int, int]:
    """Number of bands and minima of each: the most minima with which few bands miss no more than MISS.

    More minima let fewer dissimilar texts meet. A similarity so low that even BITS bands of one minimum would miss more
    is refused.
    """
    bands = lambda rows: int(np.ceil(np.log(MISS) / np.log(1 - min(similarity, 1 - 1e-9) ** rows))) if similarity < 1 else 1
    if not 0 < similarity <= 1 or bands(1) > BITS:
        raise ValueError(f"similarity {similarity} is not between 0.05 and 1")
    rows = max((r for r in range(1, 9) if bands(r) <= BANDS and bands(r) * r <= BITS), default=1)
    return bands(rows), rows


_SKETCHED = "id long, k1 long, k2 long, n int, sketch binary, bands array<long>, shingles array<int>"


def _sketch(ids: pa.Array, texts: list[str], k: int, least: int, bands_of: tuple[int, int]) -> pa.RecordBatch:
    many, rows = bands_of
    w = Words(texts)
    h, at = shingles(w, k)
    size = np.diff(at)
    keep = np.flatnonzero((np.diff(w.first) >= least) & (size > 0))
    h, size = h[ragged(at[:-1][keep], size[keep])], size[keep]
    begin = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
    n = len(keep)
    if not n:
        return pa.RecordBatch.from_pylist([], schema=pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int32()))]))
    doc = np.repeat(np.arange(n), size)
    order = np.lexsort((h, doc))
    h = h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    h, doc = h[new], doc[new]
    size = np.bincount(doc, minlength=n)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    minima = np.empty((BITS, n), np.uint64)
    for j in range(BITS):
        minima[j] = np.minimum.reduceat(h * _MULTIPLIERS[j], begin)
    bits = (mix(minima) >> np.uint64(20) & np.uint64(1)).astype(np.uint8)
    sketch = np.packbits(bits, axis=0, bitorder="little").T
    bands = np.empty((n, many), np.uint64)
    for b in range(many):
        x = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + minima[b * rows + r])
        bands[:, b] = x
    keys = [np.add.reduceat(mix(h ^ np.uint64(c)), begin).view(np.int64) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    flat = np.ascontiguousarray(sketch).tobytes()
    width = BITS // 8
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(keep)),
            pa.array(keys[0]),
            pa.array(keys[1]),
            pa.array(size.astype(np.int32)),
            pa.array([flat[i * width : (i + 1) * width] for i in range(n)], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * many), pa.array(bands.ravel().view(np.int64))),
            pa.ListArray.from_arrays(pa.array(np.append(begin, len(h)).astype(np.int32)), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32))),
        ],
        names=["id", "k1", "k2", "n", "sketch", "bands", "shingles"],
    )


def sketches(texts: DataFrame, k: int, least: int, similarity: float = 0.8) -> DataFrame:
    """Sketch, bands (of a similarity) and shingles of every text (id, content) with at least so many words."""
    bands_of = banding(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in slices(b.column(1)):
                yield _sketch(b.column(0).slice(low, high - low), b.column(1).slice(low, high - low).to_pylist(), k, least, bands_of)

    return spread(texts).mapInArrow(run, _SKETCHED)


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Pairs within the radius of the rows (key, side, id, sketch), which come sorted by key; a group is at most two blocks."""
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        key, ids = rows["key"].to_numpy(), rows["id"].to_numpy()
        side = rows["side"].to_numpy()
        flat = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        a, b = group_pairs(flat, begins, radius)
        keep = (side[a] < 0) | (side[a] != side[b])
        x, y = ids[a[keep]], ids[b[keep]]
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < 60_000:
            continue
        rows = pa.Table.from_batches(held)
        key = rows["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # the group that may go on
        if last:
            yield pairs(rows.slice(0, last))
        held, count = rows.slice(last).to_batches(), len(key) - last
    if count:
        yield pairs(pa.Table.from_batches(held))


def candidates(reps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of representatives in a common bucket whose sketches are within the radius.

    Buckets above block rows are found by a count that is combined before its shuffle. Their rows are spread over blocks
    by a hash of the id, and every pair of blocks is a group of its own, so no task sees more than about two blocks.
    """
    rows = reps.select(F.explode("bands").alias("key"), "id", "sketch")
    hot = materialize(rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot")
    many = hot.count()
    if many:
        joined = rows.join(F.broadcast(hot) if many <= SMALL else hot, "key", "left")
        mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = joined.withColumn("mine", F.coalesce(mine, F.lit(-1))).withColumn("other", other)
        # rows of one block meet twice in (block, block); there the sides are not told apart
        same = F.col("mine") == F.col("other")
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        rows = split.select(F.when(F.col("mine") < 0, F.col("key")).otherwise(F.xxhash64("key", low, high)).alias("key"), F.when(same, -1).otherwise(F.col("mine")).cast("int").alias("side"), "id", "sketch")
    else:
        rows = rows.select("key", F.lit(-1).alias("side"), "id", "sketch")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(parts, "key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(lambda x: _compare(x, radius), "a long, b long").distinct()


def links(records: DataFrame, id_column: str = "id", text_column: str = "content", k: int = 5, similarity: float = 0.8, least: int = 1, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between representatives (rep_a, rep_b, similarity) and membership (id, rep, size, tag null).

    similarity is that of the sets of k consecutive words; texts under least words, null and empty ones have no link.
    Repeated ids count once in a class, other columns are ignored, an empty table gives no rows.
    """
    if radius is None:
        p = (1 - similarity) / 2
        radius = int(np.ceil(BITS * p + 4.3 * np.sqrt(BITS * p * (1 - p))))
    texts = records.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("content")).where("id is not null and length(content) > 0")
    table = materialize(sketches(texts, k, least, similarity), "sketches")
    reps = materialize(table.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.countDistinct("id").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "representatives")
    pairs = materialize(candidates(reps, radius), "candidates")
    needed = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    small = needed.count() <= SMALL
    sets = table.select("id", "n", "shingles").join(F.broadcast(needed) if small else needed, "id", "left_semi").dropDuplicates(["id"])
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    value = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    found = both.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), value.alias("similarity")).where(F.col("similarity") >= similarity)
    members = table.select("id", "k1", "k2").distinct().join(reps.select("k1", "k2", F.col("id").alias("rep"), "size"), ["k1", "k2"]).select("id", "rep", "size", F.lit(None).cast("long").alias("tag"))
    return found, members


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and group (the smallest id of its connected component) of each node; edges (a, b).

    Smallest labels travel along edges and along labels themselves, so long chains take logarithmically many rounds; each
    round is a table in the shared folder. Labels are joined and reduced by shuffles; nothing is collected.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = old = materialize(nodes.select("id", F.col("id").alias("group")).distinct(), "labels")
    while True:
        best = both.join(labels.select(F.col("id").alias("a"), "group"), "a").groupBy(F.col("b").alias("id")).agg(F.min("group").alias("seen"))
        step = labels.join(best, "id", "left").select("id", F.least("group", F.coalesce("seen", "group")).alias("next"), "group")
        over = labels.select(F.col("id").alias("next"), F.col("group").alias("far"))
        new = materialize(step.join(over, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("group"), (F.col("group") != F.least("next", F.coalesce("far", "next"))).alias("changed")), "labels")
        done = new.where("changed").isEmpty()
        release(old)
        old, labels = new, new.select("id", "group")
        if done:
            release(both)
            return labels


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return links(spark.read.parquet(f"{sf_dir}/lexical_index.parquet"), k=3, similarity=0.6, least=40, radius=RADIUS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = _found(spark, sf_dir)
    return expand(pairs, materialize(members, "members"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, group, linked (representatives its class is linked to), copies, of every record in a group of two or more."""
    pairs, members = _found(spark, sf_dir)
    pairs = materialize(pairs, "links")
    members = materialize(members, "members")
    labels = components(members.select(F.col("rep").alias("id")).distinct(), pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    degree = pairs.select(F.col("rep_a").alias("rep")).union(pairs.select("rep_b")).groupBy("rep").agg(F.count("*").alias("linked"))
    named = members.join(labels.withColumnRenamed("id", "rep"), "rep").join(degree, "rep", "left").select("id", "group", F.coalesce("linked", F.lit(0)).alias("linked"), (F.col("size") - 1).alias("copies"))
    return named.where("linked > 0 or copies > 0")
