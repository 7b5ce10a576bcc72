"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are hashed at once; a longer text is a run of its own.
RUN_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts texts into runs of about RUN_BYTES, given their byte offsets."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, "right")) - 1
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column without nulls, and their n + 1 offsets."""
    column = column.cast(pa.large_string()) if len(column) else pa.array([""], pa.large_string()).slice(0, 0)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's set of shingles: sorted distinct hashes, empty without words.

    A-Z are lower-cased; words are runs without white space; a text of fewer words is one
    shingle of all of them.
    """
    data, offsets = utf8(column)
    for lo, hi in runs(offsets):
        base = int(offsets[lo])
        text = _LOWER[data[base : int(offsets[hi])]]
        edge = offsets[lo : hi + 1] - base
        n = len(text)
        cut = np.zeros(n + 1, bool)
        cut[edge] = True
        solid = ~_SPACE[text]
        start = solid.copy()
        start[1:] &= ~solid[:-1] | cut[1:n]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | cut[1:n]
        first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
        up, down = _tables(RUN_BYTES) if n <= RUN_BYTES else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        word = mix(((total[last] - total[first]) * down[first]) if len(first) else np.zeros(0, np.uint64))
        word += (last - first).astype(np.uint64)
        bounds = np.searchsorted(first, edge)
        joined = np.zeros(max(len(word) - words + 1, 0), np.uint64)
        for j in range(words):
            joined = joined * np.uint64(0xD6E8FEB86659FD93) + mix(word[j : j + len(joined)])
        joined = mix(joined)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(joined[a : b - words + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for w in word[a:b]:
                    whole = whole * np.uint64(0xD6E8FEB86659FD93) + mix(w[None])
                yield mix(whole + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
