"""Problem 5: the most similar vectors of every vector.

Method: vantage-point trees per shard, with pruning by the triangle inequality. A tree over a bounded sample routes
every vector to its shard and, as a query, to the shards its ball may reach; in a shard a tree of the same kind is
walked by all queries at once, down to blocks that are compared by matrix products. A query leaves out a side if it is
further from the boundary than FACTOR times its radius; factor one restores exact search. Equal vectors are one class,
which is stored and searched once. A shard larger than a task should hold is split into blocks of its vectors and blocks
of its queries, every pair of which is a task, so nothing is lost and no task grows with the collection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recall_engine.llm.words import mix
from recall_engine.plans.links import expand
from recall_engine.plans.tables import materialize

COSINE = 0.9
#: Share of the radius that is kept beyond a boundary. Of a pair d apart, the distances to a vantage point differ by d at
#: most but by about d / 8 as a rule in 64 dimensions, so that few pairs are lost.
FACTOR, FACTOR_NEAREST = 0.18, 0.4
#: Vectors the routing tree is built on, at most, and those of one shard as a rule.
SAMPLE, SHARD = 16_384, 32_000
#: Stored vectors below which a block is compared as a whole.
LEAF = 192


def _unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _away(x: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    """Distance of unit vectors to a unit vector."""
    return np.sqrt(np.maximum(2 - 2 * (x @ vantage), 0))


def _vantage(x: np.ndarray) -> np.ndarray:
    """Of a few vectors spread over x the one whose distances to the others vary most."""
    few, some = x[:: max(1, len(x) // 8)][:8], x[:: max(1, len(x) // 256)]
    return few[np.sqrt(np.maximum(2 - 2 * (some @ few.T), 0)).var(0).argmax()]


class Router:
    """A vantage-point tree without its points: node i has the children 2i + 1 and 2i + 2, leaves are the shards."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        inner = (1 << depth) - 1
        self.points, self.bound = np.zeros((inner, sample.shape[1]), np.float32), np.zeros(inner, np.float32)
        parts = {0: sample}
        for i in range(inner):
            x = parts.pop(i)
            self.points[i] = _vantage(x)
            d = _away(x, self.points[i])
            self.bound[i] = np.median(d)
            near = d <= self.bound[i]
            parts[2 * i + 1], parts[2 * i + 2] = (x[near], x[~near]) if 0 < near.sum() < len(x) else (x, x)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The shard each vector is stored in."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, self.points[node]), 0))
            node = 2 * node + 1 + (d > self.bound[node])
        return node - ((1 << self.depth) - 1)

    def visits(self, x: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vector numbers and the shards they have to be compared in."""
        at, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x[at], self.points[node]), 0))
            left, right = d <= self.bound[node] + margin[at], d > self.bound[node] - margin[at]
            at, node = np.concatenate([at[left], at[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return at, node - ((1 << self.depth) - 1)


def walk(stored: np.ndarray, queries: np.ndarray, margin: np.ndarray, visit) -> None:
    """Call visit(stored numbers, query numbers) for every leaf of a vantage-point tree that the queries can't leave out."""
    todo = [(np.arange(len(stored)), np.arange(len(queries)))]
    while todo:
        s, q = todo.pop()
        if not len(q) or not len(s):
            continue
        if len(s) <= LEAF:
            visit(s, q)
            continue
        point = _vantage(stored[s])
        ds, dq = _away(stored[s], point), _away(queries[q], point)
        bound = np.median(ds)
        near = ds <= bound
        if near.all():
            visit(s, q)
            continue
        todo += [(s[near], q[dq <= bound + margin[q]]), (s[~near], q[dq > bound - margin[q]])]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def live(vectors: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """row, file_id, q of the vectors that can be compared, and their length, the commonest if it isn't given.

    Left out: a null row, a null file or -1 (dead), a null or all-zero q, a null in q, and a q of another length.
    """
    kept = vectors.where((F.col("file_id") != -1) & F.col("row").isNotNull() & F.exists("q", lambda x: x != 0) & ~F.exists("q", lambda x: x.isNull()))
    kept = kept.select(F.col("row").cast("long").alias("row"), F.col("file_id").cast("long").alias("file_id"), F.col("q").cast("array<tinyint>").alias("q"))
    if dim is None:
        most = kept.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = most["d"] if most else 1
    return kept.where(F.size("q") == dim), dim


def _router(reps: DataFrame, dim: int, sample: int = SAMPLE, shard: int = SHARD) -> tuple[Router, np.ndarray, int]:
    """The routing tree, its sample and the number of vectors. The sample is of the smallest hashes, so it is the same again."""
    n = reps.count()
    rows = reps.orderBy(F.xxhash64("q"), "q").select("q").limit(sample).toArrow()
    x = _unit(_matrix(rows["q"], dim)) if n else np.zeros((0, dim), np.float32)
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    depth = min(depth, max(0, int(np.log2(max(1, len(x) / 16)))))
    return Router(x, depth), x, n


class Plan:
    """The routing tree, how far a query looks beyond a boundary, and the blocks each shard is split into."""

    def __init__(self, router: Router, stored: np.ndarray, asked: np.ndarray, shard: int):
        self.router = router
        self.stored, self.asked = (np.maximum(1, -(-x // (2 * shard))).astype(np.int64) for x in (stored, asked))

    def solo(self, shard: np.ndarray) -> np.ndarray:
        return (self.stored[shard] == 1) & (self.asked[shard] == 1)

    def spread(self, shard: np.ndarray, key: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and group keys of rows in a shard: a stored row meets every block of queries, a query every block of stored rows."""
        mine, others = (self.stored, self.asked) if role == STORED else (self.asked, self.stored)
        at = np.repeat(np.arange(len(shard)), others[shard])
        other = np.arange(len(at)) - np.repeat(np.concatenate([[0], np.cumsum(others[shard])[:-1]]), others[shard]) if len(at) else at
        own = (mix(key.astype(np.int64).view(np.uint64)) >> np.uint64(8)).astype(np.int64)[at] % mine[shard[at]]
        s, q = (own, other) if role == STORED else (other, own)
        return at, (shard[at] << 40) | (s << 20) | q


#: What a row of a group is there for.
BOTH, STORED, ASKED = 0, 1, 2


def _counted(rows: DataFrame, router: Router, margin_of, dim: int, shard: int) -> Plan:
    """How many stored rows and queries each shard has, from one light pass; rows(key, file, ask, q)."""
    held = rows.sparkSession.sparkContext.broadcast(router)
    shards = 1 << router.depth

    def run(batches):
        tree = held.value
        total = np.zeros((2, shards), np.int64)
        for b in batches:
            x, ask = _unit(_matrix(b.column(3), dim)), b.column(2).to_numpy()
            total[0] += np.bincount(tree.homes(x[ask != ASKED]), minlength=shards)
            i = np.flatnonzero(ask != STORED)
            total[1] += np.bincount(tree.visits(x[i], margin_of(x[i], b.column(1).to_numpy()[i]))[1], minlength=shards)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["shard", "stored", "asked"])

    stored, asked = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
    counts = rows.mapInArrow(run, "shard long, stored long, asked long").groupBy("shard").agg(F.sum("stored").alias("stored"), F.sum("asked").alias("asked")).toArrow()  # a row per shard
    at = counts["shard"].to_numpy()
    stored[at], asked[at] = counts["stored"].to_numpy(), counts["asked"].to_numpy()
    return Plan(router, stored, asked, shard)


def _routed(rows: DataFrame, plan: Plan, margin_of, dim: int) -> DataFrame:
    """group, role, margin, key, file, q: rows(key, file, ask, q) once for each group they have a part in.

    In a shard of one block a row that is stored and asked comes once for both.
    """
    held = rows.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        plan = held.value
        for b in batches:
            key, file, ask = (b.column(i).to_numpy() for i in range(3))
            x = _unit(_matrix(b.column(3), dim))
            home = plan.router.homes(x)
            margin = np.zeros(len(x), np.float32)
            asks = np.flatnonzero(ask != STORED)
            margin[asks] = margin_of(x[asks], file[asks])
            at, shard = plan.router.visits(x[asks], margin[asks])
            at = asks[at]
            both = (ask[at] == BOTH) & (shard == home[at]) & plan.solo(shard)
            own = np.flatnonzero(ask != ASKED)
            once = (ask[own] == BOTH) & plan.solo(home[own])
            parts = [(own[once], home[own[once]] << 40, BOTH)]
            for who, where, role in ((own[~once], home[own[~once]], STORED), (at[~both], shard[~both], ASKED)):
                i, group = plan.spread(where, key[who], role)
                parts.append((who[i], group, role))
            who, group = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            role = np.concatenate([np.full(len(p[0]), p[2], np.int8) for p in parts])
            taken = b.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(role), pa.array(margin[who]), taken.column(0), taken.column(1), taken.column(3)], names=["group", "role", "margin", "key", "file", "q"])

    return rows.mapInArrow(run, "group long, role byte, margin float, key long, file long, q array<tinyint>")


def similar(vectors: DataFrame, cosine: float = COSINE, factor: float = FACTOR, dim: int | None = None, shard: int | None = None) -> DataFrame:
    """row_a, row_b, row_a < row_b: vectors of different files with at least that cosine.

    Equal vectors are one class that is searched once and expanded afterwards (see plans.links). Repeated rows count
    once, other columns are ignored, an empty table gives no rows. Copies of vectors are shuffled once to each shard
    their ball may reach. The sample of the routing tree is collected and shards are counted while the plan is built.
    """
    kept, dim = live(vectors, dim)
    kept = kept.dropDuplicates(["row"])
    # q is the key of a class; a class of several files has no file of its own
    reps = materialize(kept.groupBy("q").agg(F.min("row").alias("rep"), F.count("*").alias("size"), F.min("file_id").alias("low"), F.max("file_id").alias("high")), "classes")
    shard = shard or SHARD
    router, *_ = _router(reps, dim, shard=shard)
    margin = factor * float(np.sqrt(2 - 2 * cosine))
    margin_of = lambda x, file: np.full(len(x), margin, np.float32)
    file = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(-1)).alias("file")
    rows = reps.select(F.col("rep").alias("key"), file, F.lit(BOTH).cast("byte").alias("ask"), "q")
    routed = _routed(rows, _counted(rows, router, margin_of, dim, shard), margin_of, dim)

    def compare(table: pa.Table) -> pa.Table:
        q, role = _matrix(table["q"], dim), table["role"].to_numpy()
        x, rep, file = _unit(q), table["key"].to_numpy(), table["file"].to_numpy()
        inside, asks = np.flatnonzero(role != ASKED), np.flatnonzero(role != STORED)
        out_a, out_b = [], []

        def visit(s: np.ndarray, k: np.ndarray) -> None:
            s, k = inside[s], asks[k]
            for at in range(0, len(k), 8192):
                part = k[at : at + 8192]
                i, j = np.nonzero(x[part] @ x[s].T >= cosine - 1e-4)
                a, b = part[i], s[j]
                keep = (rep[a] != rep[b]) & ((file[a] != file[b]) | (file[a] < 0))
                a, b = a[keep], b[keep]
                # the cosine once more in whole numbers
                u, v = q[a].astype(np.int64), q[b].astype(np.int64)
                dot, size = np.einsum("ij,ij->i", u, v), np.einsum("ij,ij->i", u, u).astype(float) * np.einsum("ij,ij->i", v, v)
                keep = dot >= cosine * np.sqrt(size)
                out_a.append(np.minimum(rep[a[keep]], rep[b[keep]]))
                out_b.append(np.maximum(rep[a[keep]], rep[b[keep]]))

        walk(x[inside], x[asks], np.full(len(asks), margin, np.float32), visit)
        pair = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1) if out_a else np.zeros((2, 0), np.int64)
        return pa.table({"rep_a": pair[0], "rep_b": pair[1]})

    pairs = routed.groupBy("group").applyInArrow(compare, "rep_a long, rep_b long").distinct()
    members = kept.join(reps.select("q", "rep", "size"), "q").select(F.col("row").alias("id"), "rep", "size", F.col("file_id").alias("tag"))
    return expand(pairs, materialize(members, "members")).select(F.col("id_a").alias("row_a"), F.col("id_b").alias("row_b")).distinct()


def _representatives(kept: DataFrame, k: int) -> DataFrame:
    """Of each class of equal vectors the rows that may be among the k smallest outside any one file: of each file its k
    smallest, of the files the k + 1 with the smallest rows. The limits apply before the shuffles."""
    place = F.row_number().over(Window.partitionBy("q", "file_id").orderBy("row"))
    few = kept.withColumn("place", place).where(F.col("place") <= k)
    heads = few.where("place = 1").withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy("row"))).where(F.col("turn") <= k + 1)
    return few.drop("place").join(heads.select("q", "file_id"), ["q", "file_id"], "left_semi").select("row", "file_id", "q")


def nearest(vectors: DataFrame, k: int = 10, every: int = 20, factor: float = FACTOR_NEAREST, dim: int | None = None, shard: int | None = None) -> DataFrame:
    """row_a, rank, row_b, cosine: of each row divisible by every, the k rows of other files with the largest cosine.

    A query's radius is the distance of its k-th nearest in the routing sample, which the k-th nearest of all can't
    exceed (of other files; a query with fewer of them in the sample searches everything). Ties go to the smaller row;
    a row with fewer rows of other files has fewer neighbours. Every live row is searched; of equal vectors those that
    can't be an answer are left out beforehand, and equal vectors of one file are asked once.
    """
    kept, dim = live(vectors, dim)
    kept = materialize(kept.dropDuplicates(["row"]), "vectors")
    shard = shard or SHARD
    stored = materialize(_representatives(kept, k), "stored")
    router, *_ = _router(stored, dim, shard=shard)
    rows = stored.orderBy(F.xxhash64("q"), "q", "row").select("q", "file_id").limit(SAMPLE).toArrow()
    sample, files = _unit(_matrix(rows["q"], dim)) if rows.num_rows else np.zeros((0, dim), np.float32), rows["file_id"].to_numpy()
    asked = kept.where(F.col("row") % every == 0)
    groups = materialize(asked.groupBy("q", "file_id").agg(F.min("row").alias("rep")), "asked")
    table = stored.select(F.col("row").alias("key"), F.col("file_id").alias("file"), F.lit(STORED).cast("byte").alias("ask"), "q")
    table = table.unionByName(groups.select(F.col("rep").alias("key"), F.col("file_id").alias("file"), F.lit(ASKED).cast("byte").alias("ask"), "q"))
    held = vectors.sparkSession.sparkContext.broadcast((sample, files))

    def margin_of(x: np.ndarray, file: np.ndarray) -> np.ndarray:
        sample, files = held.value
        radius = np.full(len(x), 2 / factor, np.float32)
        for at in range(0, len(x), 512):
            c = np.where(file[at : at + 512][:, None] == files[None, :], -2.0, x[at : at + 512] @ sample.T)
            if c.shape[1] >= k:
                best = np.partition(c, -k, axis=1)[:, -k]
                radius[at : at + 512] = np.where(best > -2, np.sqrt(np.maximum(2 - 2 * best, 0)), 2 / factor)
        return radius * factor

    def compare(table: pa.Table) -> pa.Table:
        q = _matrix(table["q"], dim)
        x, role = _unit(q), table["role"].to_numpy()
        row, file, margin = table["key"].to_numpy(), table["file"].to_numpy(), table["margin"].to_numpy()
        inside, asks = np.flatnonzero(role == STORED), np.flatnonzero(role == ASKED)
        # the k-th nearest of the sample is among the rows, so nothing worse than it is needed
        radius = margin[asks] / factor
        least = np.where(radius < 2, 1 - radius * radius / 2 - 1e-5, -2).astype(np.float32)
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def shrink() -> None:
            """Keep the k best of each query of what was found so far."""
            nonlocal held
            if not found:
                return
            a, c, w = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((row[w], -c, a))
            a, c, w = a[order], c[order], w[order]
            start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
            last = place == k - 1
            least[a[last]] = np.maximum(least[a[last]], c[last] - np.float32(2e-6))
            keep = (place < k) | (c >= least[a])  # as good ones stay until cosines are told exactly
            found[:] = [(a[keep], c[keep], w[keep])]
            held = int(keep.sum())

        def visit(s: np.ndarray, who: np.ndarray) -> None:
            nonlocal held
            s = inside[s]
            for at in range(0, len(who), 4096):
                part = who[at : at + 4096]
                c = x[asks[part]] @ x[s].T
                i, j = np.nonzero(c >= least[part][:, None])
                keep = file[asks[part[i]]] != file[s[j]]
                i, j = i[keep], j[keep]
                found.append((part[i], c[i, j], s[j]))
                held += len(i)
                if held > 4_000_000:
                    shrink()

        walk(x[inside], x[asks], margin[asks], visit)
        shrink()
        a, _, w = found[0] if found else (np.zeros(0, np.int64),) * 3
        u, v = q[asks[a]].astype(np.int64), q[w].astype(np.int64)
        size = np.einsum("ij,ij->i", u, u).astype(float) * np.einsum("ij,ij->i", v, v)
        return pa.table({"rep": row[asks[a]], "row_b": row[w], "cosine": np.einsum("ij,ij->i", u, v) / np.sqrt(size)})

    routed = _routed(table, _counted(table, router, margin_of, dim, shard), margin_of, dim)
    found = routed.groupBy("group").applyInArrow(compare, "rep long, row_b long, cosine double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc(F.rint(F.col("cosine") * 1e9)), "row_b"))).where(F.col("rank") <= k)
    every_row = asked.join(groups, ["q", "file_id"]).select(F.col("row").alias("row_a"), "rep")
    return every_row.join(ranked, "rep").select("row_a", "rank", "row_b", F.round("cosine", 5).alias("cosine"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/vectors.parquet"))


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/vectors.parquet"))
