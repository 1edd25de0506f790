"""Problem 3: long texts in pieces under a limit, cut at natural boundaries, with an overlap.

Method: content-defined chunking. A rolling hash over a window of characters marks landmarks. The end of a piece is the
first landmark between the minimum and maximum size (else the one with the smallest hash), moved to the nearest natural
boundary there: end of a sentence or line, else of a word. As landmarks depend only on the characters around them, an
edit alters only neighbouring pieces. Only where the text has no white space for a whole piece a cut is forced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recall_engine.llm.words import mix, powers, slices
from recall_engine.plans.tables import spread

MAXIMUM, MINIMUM, OVERLAP, LEAST_OVERLAP = 1100, 500, 180, 60
#: Characters under the rolling hash; one of so many positions is a landmark.
WINDOW, RARITY = 32, 128
#: A sentence or line end is taken up to so far from the landmark, beyond it a nearer word end.
REACH = 250


@lru_cache(1)
def _space() -> np.ndarray:
    """By code point: white space."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x3100) if chr(c).isspace()]] = True
    return table


#: Characters that end a sentence, and those that may follow before the white space.
_STOP, _CLOSE = np.array([ord(c) for c in ".!?…:;。！？"], np.uint32), np.array([ord(c) for c in "\"')]»”’"], np.uint32)


def _rolling(code: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW characters before each position 0..n (fewer at the start)."""
    n = len(code)
    p, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    begin = np.maximum(np.arange(n + 1) - WINDOW, 0)
    return mix((total - total[begin]) * inverse[begin])


def _nearest(marks: np.ndarray, low: int, high: int, at: int) -> int:
    """The mark in [low, high] nearest to at, the earlier of two; -1 if there is none."""
    i, j = np.searchsorted(marks, (low, high + 1))
    if i == j:
        return -1
    k = int(np.searchsorted(marks[i:j], at)) + i
    near = [int(marks[x]) for x in (k - 1, k) if i <= x < j]
    return min(near, key=lambda x: (abs(x - at), x))


def spans(text: str, maximum: int = MAXIMUM, minimum: int = MINIMUM, overlap: int = OVERLAP, least: int = LEAST_OVERLAP) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of each piece in code points. forced: its end is inside a run without white space.

    Pieces are at most maximum long, cover the text from 0 to its end, and start at most overlap before the end of the
    one before, at a natural boundary if there is one there.
    """
    n = len(text)
    if n <= maximum:
        return [(0, n, False)] if n else []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _space()[code]
    natural = np.concatenate([[True], space[:-1] | space[1:], [True]])  # cuts 0..n that split no word
    ends = np.flatnonzero(natural & np.concatenate([[False], ~space]))
    stop = np.isin(code, _STOP)
    closed = stop.copy()
    closed[1:] |= np.isin(code[1:], _CLOSE) & stop[:-1]
    line = np.flatnonzero((code == 10) | (code == 13))
    sentences = np.unique(np.concatenate([np.flatnonzero(closed & natural[1:]) + 1, line + 1, line]))
    begins = np.flatnonzero(natural & np.concatenate([~space, [False]]))
    fresh = np.unique(begins[np.searchsorted(begins, sentences[sentences <= begins[-1]])]) if len(begins) else begins
    cuts = np.flatnonzero(natural)
    rolling = _rolling(code)
    landmarks = np.flatnonzero(rolling < np.uint64((1 << 64) // RARITY))
    out, start = [], 0
    while n - start > maximum:
        low, high = start + minimum, start + maximum
        i = int(np.searchsorted(landmarks, low))
        mark = int(landmarks[i]) if i < len(landmarks) and landmarks[i] <= high else low + int(rolling[low : high + 1].argmin())
        end = _nearest(sentences, low, high, mark)
        if end < 0 or abs(end - mark) > REACH:
            word = _nearest(ends, low, high, mark)
            end = word if word >= 0 else end
        if end < 0:  # no word ends late enough: the last natural cut before, else the landmark itself
            i = int(np.searchsorted(cuts, high, "right")) - 1
            end = int(cuts[i]) if cuts[i] > start else -1
        forced = end < 0
        end = mark if forced else end
        out.append((start, end, forced))
        floor = max(end - overlap, start + 1)
        goal = max(end - least, floor)
        again = -1
        for marks in (fresh, begins, cuts):
            i = int(np.searchsorted(marks, goal, "right")) - 1
            if i >= 0 and marks[i] >= floor:
                again = int(marks[i])
                break
        # an overlap may not lead back to the same end
        start = again if again > start and (again + minimum <= end or n - again > maximum) and again < end else end
    out.append((start, n, False))
    return out


def pieces(records: DataFrame, id_column: str = "id", text_column: str = "content", **sizes: int) -> DataFrame:
    """id, start, end, forced of every piece of every record.

    Null and empty texts have no piece, a text within the maximum has one. Repeated rows give repeated pieces, null ids
    stay null, other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in slices(b.column(1)):
                found = [spans(t, **sizes) for t in b.column(1).slice(low, high - low).to_pylist()]
                owner = np.repeat(np.arange(low, high), [len(x) for x in found])
                flat = [p for x in found for p in x]
                start, end, forced = zip(*flat, strict=True) if flat else ((), (), ())
                arrays = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(forced, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "end", "forced"])

    rows = records.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("content")).where("length(content) > 0")
    return spread(rows).mapInArrow(run, "id long, start int, end int, forced boolean")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark.read.parquet(f"{sf_dir}/lexical_index.parquet"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that were split, and whether a cut was forced; a piece's rows are combined before the shuffle."""
    long_ones = spark.read.parquet(f"{sf_dir}/lexical_index.parquet").where(F.length("content") > MAXIMUM)
    return pieces(long_ones).groupBy("id").agg(F.max("forced").alias("any")).select("id", F.when(F.col("any"), "forced").otherwise("natural").alias("cut"))
