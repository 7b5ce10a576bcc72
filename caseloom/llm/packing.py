"""Hierarchical packing of token streams into windows of several lengths.

A document's tokens fill whole long windows first; what is left goes to the tier of the
smallest window that holds it. Each tier's window takes one such rest and is filled up from
shorter tiers, the last filler being cut to fit, so that every window is full. Windows join
step groups of equal token counts.
"""

from __future__ import annotations

import base64
import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (doc row, start in the document, length)
Piece = tuple[int, int, int]


class TierPacker:
    """Packs pieces of one task; ``add`` and ``close`` yield full windows.

    A window is (capacity, pieces). ``held`` rests wait at most: beyond that the longest
    waiting ones are packed, so memory is bounded whatever the input.
    """

    def __init__(self, window: int = 2048, tiers: int = 5, held: int = 4096):
        if window & (window - 1) or window >> (tiers - 1) < 1:
            raise ValueError("window must be a power of two with room for the tiers")
        self.sizes = [window >> i for i in range(tiers)]
        self.wait: dict[int, deque[Piece]] = {s: deque() for s in self.sizes}
        self.held, self.n, self.tokens = held, 0, 0

    def _put(self, piece: Piece) -> None:
        size = next(s for s in reversed(self.sizes) if s >= piece[2])
        self.wait[size].append(piece)
        self.n += 1
        self.tokens += piece[2]

    def _pop(self, size: int) -> Piece:
        piece = self.wait[size].popleft()
        self.n -= 1
        self.tokens -= piece[2]
        return piece

    def add(self, row: int, length: int) -> Iterator[tuple[int, list[Piece]]]:
        long, at = self.sizes[0], 0
        while length - at >= long:
            yield long, [(row, at, long)]
            at += long
        if at < length:
            self._put((row, at, length - at))
        if self.n > self.held:
            yield from self._pack(self.held // 2)

    def _take(self, gap: int) -> Piece | None:
        """A rest for a gap: the longest tier that fits whole, else the shortest there is."""
        fits = next((s for s in self.sizes if s <= gap and self.wait[s]), None)
        size = fits or next((s for s in reversed(self.sizes) if self.wait[s]), None)
        return None if size is None else self._pop(size)

    def _pack(self, leave: int) -> Iterator[tuple[int, list[Piece]]]:
        while self.n > leave:
            size = next(s for s in self.sizes if self.wait[s])
            if self.tokens < size:
                return  # only a part of one window is left
            pieces, room = [], size
            piece: Piece | None = self._pop(size)
            while piece:
                row, at, n = piece
                used = min(n, room)
                pieces.append((row, at, used))
                room -= used
                if used < n:
                    self._put((row, at + used, n - used))
                piece = self._take(room) if room else None
            yield size, pieces

    def close(self) -> Iterator[tuple[int, list[Piece]]]:
        """The rest, too short for a window of its tier, in windows of powers of two."""
        yield from self._pack(0)
        left = deque(p for s in self.sizes for p in self.wait[s])
        total = sum(p[2] for p in left)
        for size in (1 << k for k in reversed(range(total.bit_length()))):
            if not total & size:
                continue
            pieces, room = [], size
            while room:
                row, at, n = left.popleft()
                used = min(n, room)
                pieces.append((row, at, used))
                room -= used
                if used < n:
                    left.appendleft((row, at + used, n - used))
            yield size, pieces


class StepGroups:
    """Deals windows to the open step with the fewest tokens that has room."""

    def __init__(self, tokens: int, open_steps: int = 4):
        self.tokens, self.width = tokens, open_steps
        self.load: dict[int, int] = {}
        self.next = 0

    def of(self, size: int) -> int:
        fits = [k for k, v in self.load.items() if v + size <= self.tokens]
        if not fits or len(self.load) < self.width:
            step, self.next = self.next, self.next + 1
            self.load[step] = 0
        else:
            step = min(fits, key=lambda k: (self.load[k], k))
        self.load[step] += size
        if self.load[step] == self.tokens or len(self.load) > 2 * self.width:
            full = max(self.load, key=lambda k: (self.load[k], -k))
            del self.load[full]
        return step


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    special: dict[str, int],
    end_id: int = 1,
    window: int = 2048,
    step_windows: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document's ids, ``end_id`` last, into windows of at most ``window``.

    A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, window, step_id. Every id lies in one piece; windows
    are full, of lengths that are powers of two. Null and empty texts are the end id alone;
    very long texts fill windows of their own; rows that repeat an id, or have none, are
    packed each, ties in the order of the task's rows; an empty table gives no rows; other
    columns are ignored, whatever their names. Each task packs its own rows: no shuffle, and no key that could be hot. Strings in
    ``special`` are their ids, as the vocabulary file states.
    """
    marks = tuple(special.items())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern, marks)
        part = TaskContext.get().partitionId()
        packer, steps = TierPacker(window), StepGroups(window * step_windows)
        held: dict[int, tuple[int | None, np.ndarray, int]] = {}  # id, the ids not yet packed, count of all
        n_rows = n_seqs = 0
        cols: list[list] = [[] for _ in range(9)]

        def emit(windows):
            nonlocal n_seqs
            for size, pieces in windows:
                seq, step, offset = (part << 40) | n_seqs, (part << 40) | steps.of(size), 0
                n_seqs += 1
                for row, at, n in pieces:
                    doc, rest, total = held[row]  # pieces of a document come in order
                    values = (doc, at, n, rest[:n].tobytes(), total, seq, offset, size, step)
                    for col, v in zip(cols, values, strict=True):
                        col.append(v)
                    offset += n
                    held[row] = (doc, rest[n:], total)
                    if len(rest) == n:
                        del held[row]

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            for c in cols:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=NAMES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                marked = any(m in text for m, _ in marks)
                ids = enc.encode(text, allowed_special="all") if marked else enc.encode_ordinary(text)
                ids.append(end_id)
                held[n_rows] = (doc, np.array(ids, "<u4"), len(ids))
                emit(packer.add(n_rows, len(ids)))
                if n_rows in held:  # only what waits is kept, not the views' whole array
                    held[n_rows] = (doc, held[n_rows][1].copy(), len(ids))
                n_rows += 1
                if len(cols[0]) >= 4096:
                    yield flush()
        emit(packer.close())
        if cols[0]:
            yield flush()

    NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_id"]
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(
        pack,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_id long",
    )


def op10(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    out = pack_documents(docs, ranks_path, pattern, {"<|endoftext|>": 50256})
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_id"
    )
