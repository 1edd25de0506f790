"""Problem 9: documents that hold passages of evaluation items.

Method: a positional inverted index, distributed by document. Every shard (some documents of one task) stores, term by
term, the sorted positions of its words; the index is written once and serves any evaluation set. For each window of n
consecutive words of an item the list of its rarest term in the corpus is read first; its positions, shifted by the
place of the term in the item, are alignments of the item with a document. The lists of the other terms around it are
shifted likewise and intersected with them: an alignment that stays in n lists in a row is a phrase match, one that stays
in most lists but for insertions is a proximity match. Of the index only the lists of the items' terms are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from recall_engine.llm.words import Words, ragged, slices
from recall_engine.plans.tables import materialize, spread

#: Words that a match must have in a row.
RUN = 13
#: Of the 2 * RUN - 1 words around an aligned rare word, so many must agree, within one word's shift, for proximity.
NEAR = 18
#: Characters of evaluation texts that are sent to the workers at once; more are searched in several passes.
BLOCK = 20_000_000
#: Alignments that are compared at once.
STEP = 100_000
#: Characters and positions from which a shard is closed; bounds what a task holds, but for a single longer text.
SHARD, PLACES = 8_000_000, 6_000_000
#: Empty positions between documents of a shard, so that no window reaches from one into the next.
GAP = 64


class Items:
    """Words of evaluation items, the vocabulary and, for a window length, the rarest position of each window."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = Words(texts)
        self.ids, self.hash, self.first = np.array(ids, np.int64), w.hash, w.first
        self.vocabulary, self.term = np.unique(self.hash, return_inverse=True)
        self.owner = np.repeat(np.arange(len(ids)), np.diff(w.first))

    def anchors(self, frequency: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the rarest term of each window of n words, sorted by term, and where each term's begin."""
        size = np.diff(self.first) - n + 1
        begin = ragged(self.first[:-1], np.maximum(size, 0))
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(len(self.vocabulary) + 1, np.int64)
        best = begin.copy()
        cost = frequency[self.term]
        for j in range(1, n):
            best = np.where(cost[begin + j] < cost[best], begin + j, best)
        best = np.unique(best)
        best = best[np.argsort(self.term[best], kind="stable")]
        return best, np.searchsorted(self.term[best], np.arange(len(self.vocabulary) + 1))


_INDEX = "shard long, term long, n int, first int, steps binary, docs array<long>, starts array<long>"


@dataclass(frozen=True)
class Postings:
    """The stored index. A row is the list of a term in a shard: n positions, the first and the steps to the next ones; the
    row without a term has the documents of the shard and the positions where they begin."""

    table: DataFrame


def build(documents: DataFrame) -> Postings:
    """The index of documents(doc_id, text), written to the shared folder without a shuffle. Null ids and texts have no part."""

    def batch(shard: int, docs: list, firsts: list, hashes: list) -> pa.RecordBatch:
        h = np.concatenate(hashes)
        place = np.concatenate([np.zeros(0, np.int64), *firsts])
        sizes = [len(x) for x in hashes]
        position = np.arange(len(h)) + np.repeat(place - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        order = np.argsort(h, kind="stable")
        h, position = h[order], position[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(begin, len(h)))
        step = np.diff(position, prepend=0)
        step[begin] = 0
        wide = np.maximum.reduceat(step, begin) > 0xFFFF if len(h) else np.zeros(0, bool)
        two, four = step.astype("<u2").tobytes(), step.astype("<u4").tobytes()
        steps = [four[4 * (b + 1) : 4 * (b + k)] if w else two[2 * (b + 1) : 2 * (b + k)] for b, k, w in zip(begin.tolist(), n.tolist(), wide.tolist(), strict=True)]
        none = lambda t: pa.nulls(len(begin), t)
        long = pa.list_(pa.int64())
        one = lambda x, t: pa.concat_arrays([x, pa.array([None], t)])
        arrays = [
            pa.array(np.full(len(begin) + 1, shard)), one(pa.array(h[begin].view(np.int64)), pa.int64()), one(pa.array(n.astype(np.int32)), pa.int32()), one(pa.array(position[begin].astype(np.int32)), pa.int32()),
            one(pa.array(steps, pa.binary()), pa.binary()), pa.concat_arrays([none(long), pa.array([docs], long)]), pa.concat_arrays([none(long), pa.array([place.tolist()], long)]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "term", "n", "first", "steps", "docs", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        docs, firsts, hashes = [], [], []
        at = characters = 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for low, high in slices(b.column(1)):
                w = Words(b.column(1).slice(low, high - low).to_pylist())
                size = np.diff(w.first)
                kept = np.flatnonzero(size)
                docs += [ids[low + i] for i in kept.tolist()]
                starts = at + np.concatenate([[0], np.cumsum(size[kept] + GAP)])
                firsts.append(starts[:-1])
                hashes += [w.hash[w.first[i] : w.first[i + 1]] for i in kept.tolist()]
                at, characters = int(starts[-1]), characters + len(w.code)
                if (characters >= SHARD or at >= PLACES) and docs:
                    yield batch(shard, docs, firsts, hashes)
                    shard, docs, firsts, hashes, at, characters = shard + 1, [], [], [], 0, 0
        if docs:
            yield batch(shard, docs, firsts, hashes)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    return Postings(materialize(spread(texts).mapInArrow(run, _INDEX), "postings"))


def _wanted(index: Postings, vocabulary: np.ndarray) -> DataFrame:
    """The lists of the terms, and the documents of every shard. The vocabulary is of one block of evaluation texts."""
    spark = index.table.sparkSession
    terms = spark.createDataFrame(pa.table({"term": vocabulary.view(np.int64)}))
    lists = index.table.where("term is not null").join(F.broadcast(terms), "term", "left_semi").select("shard", "term", "n", "first", "steps", F.lit(None).cast("array<long>").alias("docs"), F.lit(None).cast("array<long>").alias("starts"))
    return lists.unionByName(index.table.where("term is null"))


def _frequency(wanted: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of the vocabulary occurs in the whole corpus, from the lengths of its lists."""
    out = np.zeros(len(vocabulary), np.int64)
    table = wanted.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    out[np.searchsorted(vocabulary, table["term"].to_numpy().view(np.uint64))] = table["n"].to_numpy()
    return out


def matches_of(items: Items, places: np.ndarray, starts: np.ndarray, lists: dict[int, np.ndarray], begins: np.ndarray, size: int, n: int, near: int) -> tuple[np.ndarray, ...]:
    """Of one shard: text number, item number, longest run of equal words, words agreeing nearby; for each pair the best.

    lists: sorted positions of a term by its number in the vocabulary. Membership of a shifted position in a list is
    looked up in an array of the shard's positions, which holds the number of the term there.
    """
    term_at = np.full(size + 2 * GAP, -1, np.int32)
    for t, x in lists.items():
        term_at[x] = t
    rare = [t for t in lists if starts[t + 1] > starts[t]]
    mine = np.concatenate([np.zeros(0, np.int64), *[np.repeat(lists[t], starts[t + 1] - starts[t]) for t in rare]])
    theirs = np.concatenate([np.zeros(0, np.int64), *[np.tile(places[starts[t] : starts[t + 1]], len(lists[t])) for t in rare]])
    found: list[tuple[np.ndarray, ...]] = []
    k = np.arange(-n - 1, n + 2)
    for at in range(0, len(mine), STEP):
        p, e = mine[at : at + STEP], theirs[at : at + STEP]
        item = items.owner[e]
        x, y = np.maximum(p[:, None] + k, -1), e[:, None] + k
        a = term_at[x]  # -1 is in the empty end
        inside = (y >= items.first[item][:, None]) & (y < items.first[item + 1][:, None])
        b = np.where(inside, items.term[np.clip(y, 0, len(items.term) - 1)], -2)
        equal = a == b
        close = equal.copy()
        close[:, 1:] |= a[:, :-1] == b[:, 1:]
        close[:, :-1] |= a[:, 1:] == b[:, :-1]
        close = close[:, 2:-2].sum(1)
        left = np.cumprod(equal[:, n + 1 :: -1][:, 1:n], 1).sum(1)
        right = np.cumprod(equal[:, n + 2 : 2 * n + 1], 1).sum(1)
        run = left + right + 1
        keep = (run >= n) | (close >= near)
        found.append((np.searchsorted(begins, p[keep], "right") - 1, item[keep], run[keep], close[keep]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text, item, run, close = (np.concatenate(x) for x in zip(*found, strict=True))
    only, group = np.unique(text * len(items.ids) + item, return_inverse=True)
    best_run, best_close = np.zeros(len(only), np.int64), np.zeros(len(only), np.int64)
    np.maximum.at(best_run, group, run)
    np.maximum.at(best_close, group, close)
    return only // len(items.ids), only % len(items.ids), best_run, best_close


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """The evaluation texts in pieces of about block characters; the sizes are looked at first."""
    kept = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // block)
    for i in range(parts):
        yield [tuple(r) for r in kept.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).select("item_id", "text").collect()]


def _matcher(held, n: int, near: int):
    """Of the lists of one shard, the matches with the evaluation items held."""

    def run(table: pa.Table) -> pa.Table:
        asked, places, starts = held.value
        term = table["term"].to_pylist()
        at = term.index(None)
        docs, begins = np.array(table["docs"][at].as_py(), np.int64), np.array(table["starts"][at].as_py(), np.int64)
        number = np.searchsorted(asked.vocabulary, np.array([t or 0 for t in term], np.int64).view(np.uint64)).tolist()
        lists, size = {}, 0
        for t, i, first, count, steps in zip(term, number, table["first"].to_pylist(), table["n"].to_pylist(), table["steps"].to_pylist(), strict=True):
            if t is not None:
                step = np.frombuffer(steps, "<u4" if len(steps) == 4 * (count - 1) else "<u2").astype(np.int64)
                lists[i] = first + np.concatenate([[0], np.cumsum(step)])
                size = max(size, int(lists[i][-1]) + 1)
        text, item, longest, close = matches_of(asked, places, starts, lists, begins, size, n, near)
        return pa.table({"doc_id": docs[text], "item_id": asked.ids[item], "run": longest.astype(np.int32), "near": close.astype(np.int32)})

    return run


def search(index: Postings, items: DataFrame, n: int = RUN, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, run, near, match of items(item_id, text) in an index; see leaks().

    The evaluation texts go to the workers in blocks of a bounded size; for each block the lists of its terms are read
    twice, to count and to match, and shuffled by shard once.
    """
    spark = index.table.sparkSession
    schema = "doc_id long, item_id long, run int, near int"
    out = spark.createDataFrame([], schema)
    for rows in _blocks(items, block):
        asked = Items(*map(list, zip(*rows, strict=True))) if rows else None
        if asked is None or not len(asked.vocabulary):
            continue
        wanted = _wanted(index, asked.vocabulary)
        places, starts = asked.anchors(_frequency(wanted, asked.vocabulary), n)
        held = spark.sparkContext.broadcast((asked, places, starts))

        out = out.unionByName(wanted.groupBy("shard").applyInArrow(_matcher(held, n, near), schema))
    best = out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("near").alias("near"))
    return best.withColumn("match", F.when(F.col("run") >= n, "phrase").otherwise("proximity"))


def leaks(documents: DataFrame, items: DataFrame, n: int = RUN, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, run (longest run of equal words around a rare word, n - 1 to each side at most), near, match.

    documents(doc_id, text), items(item_id, text); other columns are ignored. match is 'phrase' (run >= n) or
    'proximity'. Null and empty texts match nothing, an item under n words has no match, null ids are left out,
    repeated rows count once, an empty side gives no rows. Words are compared as 64-bit hashes. The index is written while
    the plan is built, and the evaluation terms are counted; texts are read once and not shuffled.
    """
    return search(build(documents), items, n, near, block)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(*_tables(spark, sf_dir)).where("match = 'phrase'").select("doc_id", "item_id")


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(*_tables(spark, sf_dir))
