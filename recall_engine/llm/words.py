"""Words of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of letters and digits of the lower-cased, NFKD-decomposed text without combining marks.
Texts are joined with NUL, normalised in one call, and words are hashed by differences of prefix sums, so no Python
code runs per word or per character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters that are handled at once; bounds the memory of a worker, not the length of a text.
CHUNK = 1_000_000
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: letter or digit; combining mark."""
    word, mark = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for c in (*range(0x33480), *range(0xE0100, 0xE01F0)):
        x = chr(c)
        word[c], mark[c] = x.isalnum(), unicodedata.combining(x) > 0
    return word, mark


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n, modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, CHUNK * 2)
        one = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            for k, b in (("p", _B), ("i", _INV)):
                _powers[k] = np.concatenate([one, np.cumprod(np.full(m, b, np.uint64))])
    return _powers["p"][:n], _powers["i"][:n]


class Words:
    """Words of a list of texts: hash, first and end position in code, and the number of words before each text."""

    __slots__ = ("code", "ends", "first", "hash", "starts", "text_at")

    def __init__(self, texts: list[str]):
        word, mark = _kinds()
        joined = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts).lower()
        if not joined.isascii():
            joined = unicodedata.normalize("NFKD", joined)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        marks = mark[code]
        if marks.any():
            code = code[~marks]
        self.code = code
        edge = np.diff(np.concatenate([[0], word[code].view(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        p, inverse = powers(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * p[: len(code)], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])
        self.text_at = np.concatenate([[-1], np.flatnonzero(code == 0), [len(code)]]) if texts else np.zeros(1, int)
        self.first = np.searchsorted(self.starts, self.text_at)
        self.first[0] = 0

    def word(self, i: int) -> str:
        return self.code[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le", "surrogatepass")


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one text, and how many of them come before each text."""
    n = len(w.hash)
    count = np.maximum(np.diff(w.first) - (k - 1), 0)
    at = np.concatenate([[0], np.cumsum(count)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(_B) + w.hash[j : n - k + 1 + j]
    return mix(h[ragged(w.first[:-1], count)]), at


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    out = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(counts) else np.zeros(0, np.int64)
    return out + np.arange(total)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about limit bytes each; one longer text is a range of its own."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield at, end
        at = end
