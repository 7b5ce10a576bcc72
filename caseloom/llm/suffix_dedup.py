"""Removal of strings that repeat across documents, by suffix arrays.

Sorting every suffix of the corpus would move each byte many times. Instead:

1. Documents are packed, a few MB to a row, and written once.
2. Anchors: in each window of ``LENGTH`` bytes the gram with the least hash. Equal windows
   have equal anchors, so only windows whose anchor occurs in two documents can repeat.
   Packs send the hashes of their anchors, each once, and learn which occur elsewhere.
3. Segments, the text that the windows of such an anchor cover, go to the task of that
   anchor, each different one once per pack. A two-stage suffix array of the segments and
   the common prefixes of adjacent suffixes give, for each window, the least document.
   Anchors with more than ``HOT_SEGMENTS`` segments send single windows instead, each to
   the task of its own hash: a window needs only its equals. Segments of anchors that
   more than ``WIDE_PACKS`` packs have are merged first, by groups of packs: of N packs
   about sqrt(N) meet in a group, and as many groups in the anchor's task.
4. Packs learn a bit for each window, mark what a smaller document has, cut it, and digest
   the rest.

No step collects a group: a passage that many documents hold is one segment (or window) per
pack, then one per group of packs, and an anchor in many contexts is spread over all tasks.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .shingles import mix, utf8
from .suffix_array import least_owner

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
#: Text of one pack, text of one anchor task, and text of one suffix array (bytes).
PACK_BYTES, PART_BYTES, ARRAY_BYTES = 2 << 20, 8 << 20, 1 << 19
#: Text whose anchors are computed at once; a long document takes several slices.
SLICE = 1 << 17
#: Segments of an anchor (at most 80 bytes each) that may share a suffix array.
HOT_SEGMENTS = 8192
#: Packs that may send their segments of one anchor to one task.
WIDE_PACKS = 64
NO_ID = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 40) - 1)
_HOT, _WIDE = 1, 2


@functools.cache
def _codecs() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _zip(data: bytes) -> bytes:
    return _codecs()[0].compress(data)


def _unzip(data: bytes) -> bytes:
    return _codecs()[1].decompress(data)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick(min or max) of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _inner(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of ``sizes``, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class Slice:
    """Anchors of one slice of a pack's text."""

    at: np.ndarray
    key: np.ndarray  # task of the anchor (upper bits) and 40 bits of its hash
    rank: np.ndarray
    padded: np.ndarray  # least rank of each window from ``begin`` - SPAN + 1 on; 0: no window
    begin: int

    def ranges(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each of the anchors ``hit``."""
        at, rank = self.at[hit], self.rank[hit]
        lo, hi = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for k in range(0, len(at), 8192):
            cut = slice(k, k + 8192)
            # windows that start SPAN - 1 before the anchor to at the anchor
            own = self.padded[at[cut, None] - self.begin + np.arange(SPAN)] == rank[cut, None]
            lo[cut] = at[cut] - (SPAN - 1) + own.argmax(axis=1)
            hi[cut] = at[cut] - own[:, ::-1].argmax(axis=1)
        return lo, hi


@dataclass
class Pack:
    """Documents of one row: ids, byte lengths, and their bytes end to end."""

    ids: np.ndarray
    sizes: np.ndarray
    text: np.ndarray

    def __post_init__(self):
        self.ends = np.cumsum(self.sizes)

    def slices(self, parts: int) -> Iterator[Slice]:
        """Anchors by slices of SLICE bytes, so that a long text needs no long arrays."""
        n = len(self.text)
        if n < LENGTH or self.sizes.max() < LENGTH:
            return
        for begin in range(0, n, SLICE):
            end = min(begin + SLICE, n)
            first = max(0, begin - SPAN + 1)
            m = min(end + SPAN - 1, n) - first  # grams, some of which run over the text's end
            t = np.zeros(m + GRAM + 4, np.uint64)
            part = self.text[first : first + m + GRAM]
            t[: len(part)] = part
            t = t[:-1] | (t[1:] << np.uint64(8))
            t = t[:-2] | (t[2:] << np.uint64(16))
            t = t[:-4] | (t[4:] << np.uint64(32))
            h = t[:m] * np.uint64(0x9E3779B97F4A7C15)
            h += t[8 : m + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
            h += t[GRAM - 8 : m + GRAM - 8] * np.uint64(0xD6E8FEB86659FD93)
            del t
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            rank = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            padded = np.zeros(end - begin + SPAN - 1, np.uint32)
            if m >= SPAN:
                least = _sliding(rank, SPAN, np.minimum)
                self._no_windows(least, first)
                at = first - (begin - SPAN + 1)
                padded[at : at + len(least)] = least[: len(padded) - at]
            own = slice(begin - first, end - first)
            here = np.flatnonzero(_sliding(padded, SPAN, np.maximum) == rank[own])
            key = mix(h[own][here])
            task = (key >> np.uint64(40)) % np.uint64(parts)
            yield Slice(here + begin, (task << np.uint64(40)) | (key & _LOW), rank[own][here], padded, begin)

    def _no_windows(self, least: np.ndarray, first: int) -> None:
        """Windows that would run over a document's end aren't any."""
        ends = self.ends[np.searchsorted(self.ends, first, "right") : np.searchsorted(self.ends, first + len(least) + LENGTH)]
        for end in ends.tolist():
            least[max(0, end - first - LENGTH + 1) : max(0, end - first)] = 0

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def once(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Different keys of the anchors, and a byte for each: 128 if two documents of the pack
        have it, plus the least power of 2 that its anchors don't exceed."""
        found = [(s.key, s.at) for s in self.slices(parts)]
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        key, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key, kind="stable")  # places ascend within a key
        key, doc = key[order], self.doc(at[order])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.r_[first[1:], len(key)] - 1
        power = np.ceil(np.log2(last - first + 1)).astype(np.uint8)
        return key[first], (doc[first] != doc[last]).astype(np.uint8) << np.uint8(7) | power

    def segments(self, known: np.ndarray, flags: np.ndarray, parts: int) -> "Segments":
        """Segments of the anchors whose key is in ``known`` (sorted); single windows where hot."""
        found: list[tuple[np.ndarray, ...]] = []
        for s in self.slices(parts) if len(known) else ():
            where = np.minimum(np.searchsorted(known, s.key), len(known) - 1)
            hit = np.flatnonzero(known[where] == s.key)
            lo, hi = s.ranges(hit)
            found.append((s.key[hit], flags[where[hit]], lo, hi))
        if not found:
            found.append((np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)))
        key, flag, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        wide = (flag & _WIDE) > 0
        split = (flag & _HOT) > 0
        if split.any():
            n = (hi - lo + 1)[split]
            window, one = np.unique(np.repeat(lo[split], n) + _inner(n), return_index=True)
            own = _digest(self.text, window, window)
            own = (((own >> np.uint64(40)) % np.uint64(parts)) << np.uint64(40)) | (own & _LOW)
            key = np.concatenate([key[~split], own])
            wide = np.concatenate([wide[~split], np.repeat(wide[split], n)[one]])
            lo, hi = np.concatenate([lo[~split], window]), np.concatenate([hi[~split], window])
        return Segments(self, key, wide, lo, hi, self.doc(lo))


def _digest(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each segment: its first and its last window cover it."""
    text = np.concatenate([text, np.zeros(8, np.uint8)])
    view = np.ndarray((len(text) - 7,), "<u8", buffer=text.data, strides=(1,))
    both = (hi - lo).astype(np.uint64)
    for at in (lo, hi):
        for skip in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            both = mix(both * np.uint64(0x9E3779B97F4A7C15) + view[at + skip])
    return both


@dataclass
class Segments:
    """Windows from ``lo`` to ``hi`` around each anchor; equal ones are sent once."""

    pack: Pack
    key: np.ndarray
    wide: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray

    def __post_init__(self):
        both = _digest(self.pack.text, self.lo, self.hi)
        order = np.lexsort((self.pack.ids[self.doc], both, self.key, self.wide))
        w, k, c = self.wide[order], self.key[order], both[order]
        new = np.r_[True, (w[1:] != w[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
        self.first = order[new]  # of equal segments, the one of the least document
        self.which = np.empty(len(order), np.int64)  # each segment's place among the different ones
        self.which[order] = np.cumsum(new) - 1

    def by_part(self) -> Iterator[tuple[int, bool, np.ndarray]]:
        part, wide = (self.key[self.first] >> np.uint64(40)).astype(np.int64), self.wide[self.first]
        cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (wide[1:] != wide[:-1])]) if len(part) else []
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            yield int(part[a]), bool(wide[a]), self.first[a:b]

    def blob(self, which: np.ndarray) -> bytes:
        starts = (self.hi - self.lo + 1)[which]
        body = b"".join(self.pack.text[a : b + LENGTH].tobytes() for a, b in zip(self.lo[which].tolist(), self.hi[which].tolist(), strict=True))
        return _blob(self.key[which], self.pack.ids[self.doc[which]], starts, body)

    def repeats(self, told: dict[tuple[int, bool], bytes]) -> np.ndarray:
        """Starts of windows that a smaller document has, as a mask of the pack's bytes.

        ``told`` has, for the least document of each different segment, a bit for each window.
        """
        ids, n = self.pack.ids, self.hi - self.lo + 1
        hit = np.zeros(len(self.pack.text), bool)
        if not len(n):
            return hit
        bits = [np.unpackbits(np.frombuffer(_unzip(told[part, wide]), np.uint8), count=int(n[one].sum())) for part, wide, one in self.by_part()]
        bits = np.concatenate(bits).view(bool)
        begin = np.cumsum(n[self.first]) - n[self.first]
        for k in range(0, len(n), 4096):
            cut = slice(k, k + 4096)
            inner, which, own = _inner(n[cut]), self.which[cut], n[cut]
            later = ids[self.doc[cut]] > ids[self.doc[self.first[which]]]
            seen = bits[np.repeat(begin[which], own) + inner] | np.repeat(later, own)
            hit[(np.repeat(self.lo[cut], own) + inner)[seen]] = True
        return hit


def _blob(key: np.ndarray, owner: np.ndarray, starts: np.ndarray, body: bytes) -> bytes:
    head = [np.array([len(key)], "<i8"), key.astype("<u8"), owner.astype("<i8"), starts.astype("<i8")]
    return _zip(b"".join(x.tobytes() for x in head) + body)


def covered(hit: np.ndarray) -> np.ndarray:
    """Bytes within LENGTH of the start of a hit, by slices."""
    gone, last = np.zeros(len(hit), bool), -LENGTH
    for k in range(0, len(hit), SLICE):
        own = hit[k : k + SLICE]
        at = np.arange(k, k + len(own))
        near = np.maximum.accumulate(np.where(own, at, last))
        gone[k : k + SLICE] = at - near < LENGTH
        last = int(near[-1])
    return gone


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive documents of a task, about PACK_BYTES to a row."""
    part, n = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    texts: list[bytes] = []
    held = 0

    def row() -> pa.RecordBatch:
        nonlocal n, held
        cols = [
            pa.array([(part << 32) | n], pa.int64()),
            pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
            pa.array([np.concatenate(sizes).astype("<i8").tobytes()], pa.binary()),
            pa.array([_zip(b"".join(texts))], pa.binary()),
            pa.array([held], pa.int64()),
        ]
        n, held = n + 1, 0
        for x in (ids, sizes, texts):
            x.clear()
        return pa.RecordBatch.from_arrays(cols, names=["pack", "ids", "sizes", "body", "n_bytes"])

    for batch in batches:
        data, offs = utf8(batch.column(1))
        own = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(own):
            hi = max(int(np.searchsorted(offs, offs[lo] + PACK_BYTES - held, "right")) - 1, lo + 1)
            ids.append(own[lo:hi])
            sizes.append(np.diff(offs[lo : hi + 1]))
            texts.append(data[offs[lo] : offs[hi]].tobytes())
            held += len(texts[-1])
            if held >= PACK_BYTES * 3 // 4:
                yield row()
            lo = hi
    if ids:
        yield row()


def _pack(ids: bytes, sizes: bytes, body: bytes) -> Pack:
    return Pack(np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8"), np.frombuffer(_unzip(body), np.uint8))


def _batch(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _to_five(low: np.ndarray) -> bytes:
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _send_anchors(parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, *blobs in zip(*(batch.column(i) for i in range(4)), strict=True):
                key, seen = _pack(*(b.as_py() for b in blobs)).once(parts)
                if not len(key):
                    continue
                part = (key >> np.uint64(40)).astype(np.int64)
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                rows = [
                    (int(part[a]), pack.as_py(), _to_five(key[a:b] & _LOW), seen[a:b].tobytes())
                    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)
                ]
                yield _batch(["part", "pack", "keys", "seen"], rows, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return send


def _known_elsewhere(hot_segments: int, wide_packs: int):
    def elsewhere(table: pa.Table) -> pa.Table:
        """For each pack of a part, its keys that occur in two documents anywhere, and flags."""
        part = table.column("part")[0].as_py()
        keys = [_five(x.as_py()) for x in table.column("keys")]
        sizes = [len(k) for k in keys]
        seen = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("seen")])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        first = np.flatnonzero(new)
        packs = np.diff([*first, len(key)])  # a pack states a key once
        many = (packs > 1) | (np.maximum.reduceat(seen[order], first) >= 128)
        most = np.add.reduceat(np.int64(1) << (seen[order] & np.uint8(127)).astype(np.int64), first) > hot_segments
        flag = (most * _HOT + (packs > wide_packs) * _WIDE).astype(np.uint8)
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new) - 1
        hit, flag = many[group], flag[group]
        rows, at = [], 0
        for pack, own, n in zip(table.column("pack").to_pylist(), keys, sizes, strict=True):
            mine = hit[at : at + n]
            if mine.any():
                rows.append((pack, part, _to_five(own[mine]), flag[at : at + n][mine].tobytes()))
            at += n
        return pa.Table.from_batches([_batch(["pack", "part", "keys", "flags"], rows, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])])

    return elsewhere


def _found(batch: pa.RecordBatch, i: int, parts: int) -> tuple[Pack, Segments | None]:
    """A row's pack and its segments; the same at each call."""
    of = lambda c: batch.column(batch.schema.names.index(c))[i].as_py()
    pack = _pack(*(of(c) for c in ("ids", "sizes", "body")))
    known = of("known")
    if not known:
        return pack, None
    keys = np.concatenate([_five(k["keys"]) | np.uint64(k["part"] << 40) for k in known])
    flags = np.concatenate([np.frombuffer(k["flags"], np.uint8) for k in known])
    order = np.argsort(keys)
    return pack, pack.segments(keys[order], flags[order], parts)


def _send_segments(parts: int, groups: int):
    """Segments of an anchor go to its task (group 0); those of wide anchors to the pack's group first."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, segments = _found(batch, i, parts)
                if segments is not None:
                    pack = batch.column(0)[i].as_py()
                    group = 1 + int(mix(np.array([pack], np.uint64))[0] % np.uint64(groups))
                    rows = [(part, group if wide else 0, pack, segments.blob(which)) for part, wide, which in segments.by_part()]
                    yield _batch(["part", "group", "pack", "segments"], rows, [pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    return send


class Strings:
    """Segments of several senders, equal ones once."""

    def __init__(self, blobs: pa.ChunkedArray):
        key, owner, starts, source, body = [], [], [], [], []
        for s, data in enumerate(blobs):
            data = _unzip(data.as_py())
            m = int(np.frombuffer(data[:8], "<i8")[0])
            k, o, n = (np.frombuffer(data, "<u8" if j == 0 else "<i8", m, 8 + 8 * m * j) for j in range(3))
            key.append(k), owner.append(o), starts.append(n), source.append(m)
            ends = 8 + 24 * m + np.cumsum(n + LENGTH - 1)
            body += [data[e - size : e] for e, size in zip(ends.tolist(), (n + LENGTH - 1).tolist(), strict=True)]
        self.bounds = np.cumsum([0, *source])  # of each sender's segments
        self.owner = np.concatenate(owner)
        number: dict[bytes, int] = {}
        self.which = np.fromiter((number.setdefault(b, len(number)) for b in body), np.int64, len(body))
        self.body = list(number)
        self.least = np.full(len(number), NO_ID, np.int64)
        np.minimum.at(self.least, self.which, self.owner)
        one = np.empty(len(number), np.int64)
        one[self.which] = np.arange(len(self.which))
        self.key, self.starts = np.concatenate(key)[one], np.concatenate(starts)[one]

    def seen(self) -> list[bytes]:
        """For each sender, a bit for each window of its segments: a smaller document has it."""
        order = np.argsort(self.key, kind="stable")  # segments of an anchor stand together
        sizes = np.cumsum(self.starts[order] + LENGTH)
        begin = np.cumsum(self.starts) - self.starts
        least = np.empty(int(self.starts.sum()), np.int64)
        lo = 0
        while lo < len(order):
            hi = max(int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + ARRAY_BYTES)), lo + 1)
            while hi < len(order) and self.key[order[hi]] == self.key[order[hi - 1]]:
                hi += 1
            mine = order[lo:hi]
            n = self.starts[mine]
            got = least_owner([np.frombuffer(self.body[j], np.uint8) for j in mine.tolist()], n, self.least[mine], LENGTH)
            least[np.repeat(begin[mine], n) + _inner(n)] = got
            lo = hi
        out = []
        for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            own, n = self.which[a:b], self.starts[self.which[a:b]]
            bits = least[np.repeat(begin[own], n) + _inner(n)] < np.repeat(self.owner[a:b], n)
            out.append(_zip(np.packbits(bits).tobytes()))
        return out

    def places(self) -> list[bytes]:
        """For each sender, the merged segment of each of its own, negative where a smaller document has it."""
        place = np.where(self.owner > self.least[self.which], ~self.which, self.which).astype("<i4")
        return [_zip(place[a:b].tobytes()) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]


_TOLD = "part long, group long, pack long, kind string, body binary"
_TOLD_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _told_rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(["part", "group", "pack", "kind", "body"], rows, _TOLD_KINDS)])


def _least_documents(table: pa.Table) -> pa.Table:
    """Of an anchor task (group 0) the bits of each pack; of a group, its segments merged and their places."""
    part, group = table.column("part")[0].as_py(), table.column("group")[0].as_py()
    table = table.sort_by("pack")
    packs, found = table.column("pack").to_pylist(), Strings(table.column("segments"))
    if group == 0:
        return _told_rows([(part, 0, p, "bits", x) for p, x in zip(packs, found.seen(), strict=True)])
    merged = _blob(found.key, found.least, found.starts, b"".join(found.body))
    return _told_rows([(part, group, None, "merged", merged), *((part, group, p, "places", x) for p, x in zip(packs, found.places(), strict=True))])


def _least_of_groups(table: pa.Table) -> pa.Table:
    """The bits of each group's merged segments, and how many windows each segment has."""
    table = table.sort_by("group")
    part, found = table.column("part")[0].as_py(), Strings(table.column("body"))
    rows = []
    for s, (group, bits) in enumerate(zip(table.column("group").to_pylist(), found.seen(), strict=True)):
        n = found.starts[found.which[found.bounds[s] : found.bounds[s + 1]]].astype("<i4")
        rows.append((part, group, None, "bits", _zip(np.array([len(n)], "<i8").tobytes() + n.tobytes() + _unzip(bits))))
    return _told_rows(rows)


def _to_packs(places: pa.Table, merged: pa.Table) -> pa.Table:
    """A group's bits, dealt to its packs."""
    data = _unzip(merged.column("body")[0].as_py())
    m = int(np.frombuffer(data[:8], "<i8")[0])
    n = np.frombuffer(data, "<i4", m, 8).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 4 * m), count=int(n.sum())).view(bool)
    begin = np.cumsum(n) - n
    rows = []
    for part, group, pack, place in zip(*(places.column(c).to_pylist() for c in ("part", "group", "pack", "body")), strict=True):
        place = np.frombuffer(_unzip(place), "<i4").astype(np.int64)
        which = np.where(place < 0, ~place, place)
        own = n[which]
        seen = bits[np.repeat(begin[which], own) + _inner(own)] | np.repeat(place < 0, own)
        rows.append((part, group, pack, "bits", _zip(np.packbits(seen).tobytes())))
    return _told_rows(rows)


def _cut(parts: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text", "input_sha256"] * with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * 2 * with_text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack, segments = _found(batch, i, parts)
                if segments is None:
                    gone = np.zeros(len(pack.text), bool)
                else:
                    told = batch.column(batch.schema.names.index("told"))[i].as_py() or []
                    gone = covered(segments.repeats({(x["part"], x["group"] > 0): x["body"] for x in told}))
                rows = []
                for doc, a, b in zip(pack.ids.tolist(), (pack.ends - pack.sizes).tolist(), pack.ends.tolist(), strict=True):
                    off = gone[a:b]
                    kept = pack.text[a:b][~off].tobytes()
                    spans = int(off[:1].sum()) + int((off[1:] & ~off[:-1]).sum())
                    row = (None if doc == NO_ID else doc, b - a, int(off.sum()), spans, hashlib.sha256(kept).hexdigest())
                    if with_text:
                        row = (*row, whole_characters(pack.text[a:b], off), hashlib.sha256(pack.text[a:b].tobytes()).hexdigest())
                    rows.append(row)
                yield _batch(names, rows, kinds)

    return cut


def whole_characters(text: np.ndarray, gone: np.ndarray) -> str:
    """What is left as text: a character goes if one of its bytes does."""
    if gone.any():
        gone, inner = gone.copy(), (text & 0xC0) == 0x80
        for _ in range(3):  # a character has four bytes at most
            gone[:-1] |= gone[1:] & inner[1:]
        for _ in range(3):
            gone[1:] |= gone[:-1] & inner[1:]
    return text[~gone].tobytes().decode(errors="replace")


def suffix_dedup(
    docs: DataFrame,
    with_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_segments: int = HOT_SEGMENTS,
    wide_packs: int = WIDE_PACKS,
) -> DataFrame:
    """Remove bytes covered by a 50-byte string that a document of smaller id has too.

    One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if
    asked for, the text left (whole characters) and input_sha256 (of the text before, which
    tells apart rows that share an id or have none). Matches lie within documents. Null texts
    are empty. Rows that repeat an id aren't smaller than each other, so neither loses
    bytes to the other; a row without an id is larger than all. Texts under 50 bytes stay
    whole; a very long text is a pack of its own, worked on by slices. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packs = stage(plain.mapInArrow(_pack_rows, "pack long, ids binary, sizes binary, body binary, n_bytes long"), "suffix-packs")
    n_packs, n_bytes = packs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    parts, groups = max(8, -(-n_bytes // PART_BYTES)), math.isqrt(n_packs) + 1
    packs = packs.drop("n_bytes")
    anchors = packs.mapInArrow(_send_anchors(parts), "part long, pack long, keys binary, seen binary")
    known = anchors.groupBy("part").applyInArrow(_known_elsewhere(hot_segments, wide_packs), "pack long, part long, keys binary, flags binary")
    known = stage(known.groupBy("pack").agg(F.collect_list(F.struct("part", "keys", "flags")).alias("known")), "suffix-known")
    both = packs.join(known, "pack", "left")
    sent = both.mapInArrow(_send_segments(parts, groups), "part long, group long, pack long, segments binary")
    told = stage(sent.groupBy("part", "group").applyInArrow(_least_documents, _TOLD), "suffix-told")
    merged = told.where("kind = 'merged'").groupBy("part").applyInArrow(_least_of_groups, _TOLD)
    dealt = told.where("kind = 'places'").groupBy("part", "group").cogroup(merged.groupBy("part", "group")).applyInArrow(_to_packs, _TOLD)
    bits = told.where("kind = 'bits'").unionByName(dealt).groupBy("pack").agg(F.collect_list(F.struct("part", "group", "body")).alias("told"))
    bits = stage(bits, "suffix-bits")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string, input_sha256 string" * with_text
    return both.join(bits, "pack", "left").mapInArrow(_cut(parts, with_text), schema)


#: Every 50-byte string of every text with its least document, for small tables. Bytes are hex digits here.
ORACLE_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM d) x),
c AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM w) x WHERE least < doc_id),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM c) x),
sp AS MATERIALIZED (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT sp.doc_id, a, b, substr(h, 2 * before + 1, 2 * (a - before)) AS piece FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM sp) sp JOIN d ON d.doc_id = sp.doc_id),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS head FROM k GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
