"""Hamming distances of many sketches at once, on bit planes stored vertically.

Plane k of a block holds bit k of 64 sketches in each word. The planes of differences are added up by carry-save adders,
so one operation updates 64 distances; words whose lanes have all exceeded the radius are left out of the next planes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes that are added before exceeded words are left out.
STEP = 16


def planes_of(sketches: np.ndarray) -> np.ndarray:
    """Vertical bit planes: from (n, bits / 8) bytes to (bits, ceil(n / 64)) words; lane i of a word is row 64 * w + i."""
    bits = np.unpackbits(sketches, axis=1, bitorder="little").T
    pad = -bits.shape[1] % 64
    bits = np.pad(bits, ((0, 0), (0, pad))) if pad else bits
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full adder: sum and carry of three planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _sixteen(x: list[np.ndarray], low: list[np.ndarray]) -> np.ndarray:
    """Add 16 planes into ones, twos, fours and eights; returns the carry, which counts sixteen."""
    level = x
    for j in range(4):
        carries, acc = [], low[j]
        for i in range(0, len(level), 2):
            acc, c = _add(acc, level[i], level[i + 1])
            carries.append(c)
        low[j], level = acc, carries
    return level[0]


def _exceeds(number: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose number, given from its lowest bit, is greater than radius."""
    over, equal = np.zeros_like(number[0]), np.full_like(number[0], ALL)
    for j in reversed(range(max(len(number), radius.bit_length()))):
        bit = number[j] if j < len(number) else np.zeros_like(equal)
        if radius >> j & 1:
            equal &= bit
        else:
            over |= equal & bit
            equal &= ~bit
    return over


def within(plane: Callable[[int, np.ndarray], np.ndarray], bits: int, live: np.ndarray, radius: int) -> np.ndarray:
    """Lanes at most radius apart. plane(k, words): differences in bit k of the words named; live: lanes to look at.

    bits is a multiple of 16. The result has the shape of live, which is flat.
    """
    out = np.zeros_like(live)
    words = np.flatnonzero(live)
    live = live[words]
    low = [np.zeros_like(live) for _ in range(4)]
    high: list[np.ndarray] = []
    for at in range(0, bits, STEP):
        carry = _sixteen([plane(k, words) for k in range(at, at + STEP)], low)
        for j in range(len(high)):
            high[j], carry = high[j] ^ carry, high[j] & carry
        high.append(carry)
        if at + STEP < bits:
            live = live & ~_exceeds([*low, *high], radius)
            keep = live != 0
            if not keep.any():
                return out
            if not keep.all():
                words, live = words[keep], live[keep]
                low, high = [x[keep] for x in low], [x[keep] for x in high]
    out[words] = live & ~_exceeds([*low, *high], radius)
    return out


def lanes(mask: np.ndarray) -> np.ndarray:
    """Positions of the set bits of flat words."""
    words = np.flatnonzero(mask)
    bits = np.unpackbits(mask[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, b = np.nonzero(bits)
    return words[w] * 64 + b


def group_pairs(sketches: np.ndarray, begins: np.ndarray, radius: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i, j), i < j, in the same group and at most radius apart; groups are runs that start at begins.

    Short groups are compared with themselves shifted by 1, 2, ... lanes, all groups at once; a long one row block by
    row block against its planes. other: rows of different values only are compared (the two sides of a split group).
    """
    n, bits = sketches.shape[0], sketches.shape[1] * 8
    size = np.diff(np.append(begins, n))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    short = np.repeat((size > 1) & (size <= 64), size)
    rows = np.flatnonzero(short)
    if len(rows):
        p = planes_of(sketches[rows])
        left = np.repeat(begins + size, size)[rows] - rows - 1  # rows that follow in the group
        for shift in range(1, int(left.max()) + 1):
            whole, part = divmod(shift, 64)
            more = left >= shift
            live = np.packbits(np.pad(more, (0, -len(more) % 64)), bitorder="little").view(np.uint64)

            def plane(k: int, words: np.ndarray, whole=whole, part=part) -> np.ndarray:
                x = p[k]
                moved = np.concatenate([x[whole:], np.zeros(whole + 1, np.uint64)])
                y = moved[words] >> np.uint64(part)
                if part:
                    y |= moved[words + 1] << np.uint64(64 - part)
                return x[words] ^ y

            i = lanes(within(plane, bits, live, radius))
            found.append((rows[i], rows[i + shift]))
    for g in np.flatnonzero(size > 64):
        at, m = int(begins[g]), int(size[g])
        p = planes_of(sketches[at : at + m])
        width = p.shape[1]
        valid = np.packbits(np.pad(np.ones(m, np.uint8), (0, -m % 64)), bitorder="little").view(np.uint64)
        own = np.unpackbits(sketches[at : at + m], axis=1, bitorder="little").astype(bool)
        for q in range(0, m, 64):
            block = own[q : q + 64]
            flip = np.where(block, ALL, np.uint64(0))  # (rows, bits)

            def plane(k: int, words: np.ndarray, flip=flip) -> np.ndarray:
                return p[k][words % width] ^ flip[words // width, k]

            i = lanes(within(plane, bits, np.tile(valid, len(block)), radius))
            a, b = q + i // (width * 64), i % (width * 64)
            keep = a < b
            found.append((at + a[keep], at + b[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    if other is not None:
        keep = other[a] != other[b]
        a, b = a[keep], b[keep]
    return a, b
