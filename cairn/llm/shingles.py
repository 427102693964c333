"""Distinct word-shingle hashes of texts, vectorised over the UTF-8 bytes of an Arrow batch.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the 64-bit hashes of the distinct ``k``-word shingles. A text
with fewer than ``k`` words has one element, its whole word sequence; null, empty and blank texts have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cairn.llm.common import byte_blocks, flat

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each row) for flat UTF-8 bytes and row offsets."""
    rows = len(offsets) - 1
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    up, down = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODES[data] * up, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return h, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """One sorted array of distinct 64-bit shingle hashes per row, in row order."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    mult = mix(np.arange(101, 101 + k, dtype=np.uint64))| np.uint64(1)
    for a, b in byte_blocks(texts):
        w, counts = word_hashes(*flat(texts.slice(a, b - a)))
        if len(w) >= k:
            h = np.zeros(len(w) - k + 1, np.uint64)
            for j in range(k):
                h += w[j : len(w) - k + 1 + j] * mult[j]
            h = mix(h)
        ends = np.cumsum(counts)
        for i in range(b - a):
            n, to = int(counts[i]), int(ends[i])
            if n >= k:
                yield np.unique(h[to - n : to - k + 1])
            elif n:
                yield mix((w[to - n : to] * mult[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
