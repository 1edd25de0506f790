"""Problem 8: token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: length-bucketed padded numpy matrices. The distinct pieces of a batch become rows of byte ids, bucketed by
length and padded; in each round every row merges its leftmost pair of minimum rank, found through a hashed pair table,
and rows are compacted; finished rows leave the matrix. A piece of LONG bytes or more, as of unbroken text, would take as
many rounds as it has merges, each over its whole length; its pairs are kept in a heap instead, which gives the same
merges in the same order. No tokenizer library takes part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from recall_engine.llm.words import mix, ragged, slices
from recall_engine.plans.tables import spread

#: Fixed value of the public vocabulary: how a text is cut before pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces kept between batches of one worker; the cache is emptied when it is full, results don't depend on it.
CACHE = 400_000
#: Bytes from which a piece is merged by a heap.
LONG = 256
_PAD = -1
_NONE = np.int64(1) << 40


class PairTable:
    """Open-addressed hash table from a pair of ids to the id of their merge, which is also its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * len(left)).bit_length() + 1)
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int64)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = (mix(key.view(np.uint64)) & self.mask).astype(np.int64)
        todo = np.arange(len(key))
        self.probes = 0
        self.single: dict[int, int] = {}
        while len(todo):
            self.probes += 1
            at, first = np.unique(slot[todo], return_index=True)
            free = self.keys[at] == -1
            put = todo[first[free]]
            self.keys[slot[put]], self.values[slot[put]] = key[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merges, _NONE where there is none; negative ids are padding."""
        key = (left.astype(np.int64) << 32) | right
        out = np.full(key.shape, _NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = (mix(key.ravel()[todo].view(np.uint64)) & self.mask).astype(np.int64)
        flat = out.ravel()
        keys = key.ravel()[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            seen = self.keys[slot]
            hit = seen == keys
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (seen != -1)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & int(self.mask)
        return flat.reshape(key.shape)

    def one(self, left: int, right: int) -> int:
        """The merge of a single pair, by the same table as a dictionary."""
        if not self.single:
            used = self.keys >= 0
            self.single = dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))
        return self.single.get(left << 32 | right, int(_NONE))


@lru_cache(2)
def load(path: str) -> tuple[np.ndarray, PairTable]:
    """The ids of the 256 bytes and the pair table of a vocabulary of ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    triples = [t for token, rank in ranks.items() if len(token) > 1 and (t := _parts(token, rank, ranks))]
    left, right, merged = (np.array(x, np.int64) for x in zip(*triples, strict=True))
    return byte_ids, PairTable(left, right, merged)


def _parts(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int, int] | None:
    """The two tokens a token is merged from: what is left of its bytes when only earlier merges are applied."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best >= rank:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return ranks[parts[0]], ranks[parts[1]], rank


def _round(matrix: np.ndarray, rank: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge in each row its leftmost pair of minimum rank, then compact. rank holds the merges of neighbours."""
    n, width = matrix.shape
    rows = np.arange(n)
    at = rank.argmin(1)
    matrix[rows, at] = rank[rows, at]
    column = np.arange(width)
    source = np.minimum(column + (column > at[:, None]), width - 1)
    matrix = np.take_along_axis(matrix, source, 1)
    matrix[:, -1] = _PAD
    none = np.full((n, 1), _NONE)
    rank = np.where(column[:-1] < at[:, None], rank, np.concatenate([rank[:, 1:], none], 1))
    # only the pairs on both sides of the merge are new
    rank[rows, at] = table.find(matrix[rows, at], np.where(at + 1 < width, matrix[rows, np.minimum(at + 1, width - 1)], _PAD))
    has = np.flatnonzero(at > 0)
    rank[has, at[has] - 1] = table.find(matrix[has, at[has] - 1], matrix[has, at[has]])
    return matrix, rank


def _merged(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """Ids of one long piece: of all neighbours the leftmost pair of minimum rank is merged until none is left.

    Neighbours are linked, and a merge changes the two pairs beside it only, so n bytes take n log n steps.
    """
    n = len(ids)
    rank = [*table.find(ids[:-1], ids[1:]).tolist(), int(_NONE)]
    token, after, before = ids.tolist(), [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, i) for i, r in enumerate(rank) if r < _NONE]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        if rank[i] != r:
            continue  # merged or changed since
        j = after[i]
        token[i], after[i], rank[j] = r, after[j], -1
        if after[j] >= 0:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0:
                new = table.one(token[left], token[after[left]]) if after[left] >= 0 else int(_NONE)
                rank[left] = new
                if new < _NONE:
                    heappush(heap, (new, left))
    out, i = [], 0
    while i >= 0:
        out.append(token[i])
        i = after[i]
    return np.array(out, np.int64)


def encode_pieces(pieces: list[bytes], byte_ids: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, flat and their counts, in the order given."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    ids, which = [data[begin[size == 1]]], [np.flatnonzero(size == 1)]
    count = np.where(size == 1, 1, 0)
    bounds = [2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 40, 64, 128, LONG]
    for i in np.flatnonzero(size >= LONG).tolist():
        whole = _merged(data[begin[i] : begin[i] + size[i]], table)
        count[i] = len(whole)
        ids.append(whole)
        which.append(np.full(len(whole), i))
    for low, high in zip(bounds, bounds[1:], strict=False):
        whole = np.flatnonzero((size >= low) & (size < high))
        step = max(1, 500_000 // high)
        for part in range(0, len(whole), step):
            live = whole[part : part + step]
            width = int(size[live].max())
            matrix = np.full((len(live), width), _PAD, np.int64)
            inside = np.arange(width) < size[live][:, None]
            matrix[inside] = data[ragged(begin[live], size[live])]
            rank = table.find(matrix[:, :-1], matrix[:, 1:])
            while len(live):
                more = rank.min(1) < _NONE if rank.shape[1] else np.zeros(len(live), bool)
                if not more.all():
                    done = matrix[~more]
                    keep = done >= 0
                    count[live[~more]] = keep.sum(1)
                    ids.append(done[keep])
                    which.append(np.repeat(live[~more], keep.sum(1)))
                    live, matrix, rank = live[more], matrix[more], rank[more]
                if len(live):
                    used = int((matrix >= 0).sum(1).max())
                    matrix, rank = _round(matrix[:, :used], rank[:, : used - 1], table)
    flat, owner = np.concatenate(ids), np.concatenate(which)
    order = np.argsort(owner, kind="stable")
    return flat[order].astype(np.int32), count


class Encoder:
    """Ids of texts; keeps the pieces it has met."""

    def __init__(self, path: str = DEFAULT):
        self.byte_ids, self.table = load(path)
        self.cut = regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        flat, count = encode_pieces([x.encode("utf-8", "replace") for x in new], self.byte_ids, self.table)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.concatenate([[0], np.cumsum(count)])[:-1]])
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text; null and empty texts have none."""
        if len(self.index) > CACHE:
            self._clear()
        pieces: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                pieces += self.cut(t)
            ends.append(len(pieces))
        new = [x for x in dict.fromkeys(pieces) if x not in self.index]
        if new:
            at = len(self.index)
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
            self._learn(new)
        piece = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        count = self.count[piece]
        total = np.concatenate([[0], np.cumsum(count)])
        return self.flat[ragged(self.begin[piece], count)], np.diff(total[ends])


def token_ids(documents: DataFrame, path: str = DEFAULT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row, without special tokens, whose strings are ordinary text.

    Null, empty: an empty list. Repeated rows stay repeated; a null id stays null; other columns are ignored. The
    vocabulary is read by each worker from path, which is a parameter. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for b in batches:
            text = b.column(1)
            for low, high in slices(text):
                flat, count = encode(text.slice(low, high - low).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), ids], names=["doc_id", "ids"])

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
