"""Two-stage suffix sorting of short texts, and what adjacent suffixes share."""

from __future__ import annotations

import numpy as np

#: Stands between texts; no byte of UTF-8 is as large.
SEPARATOR = 0xFF


def _word(text: np.ndarray, at: np.ndarray, skip: int) -> np.ndarray:
    """Eight bytes from ``at + skip`` on, as numbers that order like the bytes."""
    view = np.ndarray((len(text) - 7,), ">u8", buffer=text.data, strides=(1,))
    return view[at + skip].astype(np.uint64)


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the text's end is smallest."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1
    decided = np.flatnonzero(step)
    return step[decided[np.searchsorted(decided, np.arange(n))]] > 0


def direct_sort(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of their suffixes' first ``depth`` bytes or more.

    Ties of the words so far are ordered by the next word, and only they.
    """
    key = _word(text, at, 0)
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    for skip in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(new[where])
        key = _word(text, at[where], skip)
        order = np.lexsort((key, group))
        at[where] = at[where][order]
        key = key[order]
        new[where[1:]] |= key[1:] != key[:-1]
    return at


def two_stage_sort(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes in order of their first ``depth`` bytes (or more).

    Suffixes smaller than their successors are sorted directly. All others are induced:
    a scan of the buckets of first bytes, in order, puts each one's predecessor at the end
    of its own bucket. ``wanted`` must hold, with a position that isn't sorted directly,
    its successor. ``text`` needs ``depth`` + 8 bytes after the last wanted position.
    """
    small = suffix_types(text)
    direct = direct_sort(text, np.flatnonzero(wanted & small), depth)
    induced = wanted & ~small
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for byte in range(256):
        queue = buckets[byte]
        k = 0
        while k < len(queue):  # runs of one byte induce within their own bucket
            before = queue[k] - 1
            before = before[(before >= 0) & induced[before] & (text[before] == byte)]
            if len(before):
                queue.append(before)
            k += 1
        full = [*queue, direct[bounds[byte] : bounds[byte + 1]]]
        out += full
        here = np.concatenate(full)
        before = here - 1
        before = before[(before >= 0) & induced[before]]
        to = text[before]
        before, to = before[to > byte], to[to > byte]
        if len(to):
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(to)], strict=True):
                buckets[to[lo]].append(before[lo:hi])
        buckets[byte] = []
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, sorted_at: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, ``most`` at most (0 for the first)."""
    shared = np.zeros(len(sorted_at), np.int64)
    same = np.arange(1, len(sorted_at))
    for skip in range(0, most, 8):
        key = _word(text, sorted_at[same], skip) ^ _word(text, sorted_at[same - 1], skip)
        shared[same] += 8 - np.searchsorted(_FIRST_BYTE, key, "right")
        same = same[key == 0]
    return np.minimum(shared, most)


#: The least word whose eighth, seventh, ... first byte isn't zero.
_FIRST_BYTE = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


def least_owner(segments: list[np.ndarray], starts: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each start in each segment, the least owner of a segment with that string.

    Segment i has starts 0 to ``starts[i]`` - 1, each with ``length`` bytes after it.
    Returns the values of all segments in one array.
    """
    sizes = np.array([len(s) for s in segments])
    parts = [x for s in segments for x in (s, _GAP)]
    text = np.concatenate([*parts, np.full(length + 16, SEPARATOR, np.uint8)])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    small = suffix_types(text)
    # Up to the first directly sorted suffix from the last start on: induction begins there.
    direct = np.flatnonzero(small)
    last = direct[np.searchsorted(direct, begin + starts - 1)]
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, last + 1, -1)
    order = two_stage_sort(text, np.cumsum(edge[:-1]) > 0, length)
    edge[:] = 0
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + starts, -1)
    valid = np.cumsum(edge[:-1]) > 0
    order = order[valid[order]]
    number = np.cumsum(valid) - 1  # place of a start among all starts
    of = np.repeat(owner, starts)
    groups = np.flatnonzero(common_prefixes(text, order, length) < length)
    by_order = of[number[order]]
    least = np.minimum.reduceat(by_order, groups) if len(groups) else by_order
    out = np.empty(len(of), owner.dtype)
    out[number[order]] = np.repeat(least, np.diff([*groups, len(order)]))
    return out


_GAP = np.full(1, SEPARATOR, np.uint8)
