"""Byte-level BPE by replaying merges over a corpus of words.

A task's texts are cut into words; each different word is held once. An inverted index
from a pair's rank to the word positions where the pair stands gives, in rank order, the
positions to merge; a merge looks at its two neighbours only. Ids of a text are the ids of
its words in order.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text whose words are held at once.
CHUNK_BYTES = 8 << 20
#: Words whose ids a Python worker keeps between chunks; it starts anew beyond that.
KEPT_WORDS = 400_000


class Merges:
    """Which token two neighbouring tokens make, for arrays of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        pairs = [
            ((left << 32) | right, r)
            for token, r in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        ]
        pairs.sort()
        self.pair, self.rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, NONE if it makes none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NONE)


NONE = np.iinfo(np.int64).max


def _together(p, own, r, token, after, before, merges) -> np.ndarray:
    """Which of the places ``p`` (ascending, of the words ``own``) merge now.

    Of places that overlap every second one stands back. A word's places merge from the
    left as long as no pair of rank ``r`` or lower comes up beside them.
    """
    linked = np.r_[False, after[p[:-1]] == p[1:]]
    head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(p))))
    out = (np.arange(len(p)) - head) % 2 == 0
    s, own = p[out], own[out]
    q, left = after[s], before[s]
    right = after[q]
    merged = np.r_[False, (q[:-1] == left[1:]) & (left[1:] >= 0)]
    beside = np.where(merged, r, token[left])
    low = (left >= 0) & (merges.of(beside, np.full(len(s), r)) <= r)
    low |= (right >= 0) & (merges.of(np.full(len(s), r), token[right]) <= r)
    before_it = np.cumsum(low) - low
    start = np.r_[True, own[1:] != own[:-1]]
    out[out] = before_it == np.maximum.accumulate(np.where(start, before_it, 0))
    return out


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """Ids of each word: the lowest-ranked pair is merged first, the leftmost of equals.

    All words lie in one array of parts. ``places`` is the inverted index: rank of a pair
    -> positions of its left part. In rank order, all words that have the pair merge it at
    once and look at the neighbours of the merged places only. Where a pair of no higher
    rank comes up in a word, its places further right come again after that. Positions
    that a merge has changed since are skipped. A word that is itself a token is that token.
    """
    ranks = merges.ranks
    out: list[list[int]] = [[ranks[w]] if w in ranks else [] for w in words]
    todo = [i for i, ids in enumerate(out) if not ids and words[i]]
    if not todo:
        return out
    sizes = np.array([len(words[i]) for i in todo])
    token = merges.single[np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)]
    n, ends = len(token), np.cumsum(sizes)
    word = np.repeat(np.arange(len(todo)), sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = before[ends - sizes] = -1
    rank, alive = np.full(n, NONE), np.ones(n, bool)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = merges.of(token[inner], token[inner + 1])
    start = inner[rank[inner] < NONE]
    start = start[np.argsort(rank[start], kind="stable")]
    cuts = np.flatnonzero(np.diff(rank[start])) + 1
    places: dict[int, list[int]] = {int(rank[at[0]]): at.tolist() for at in np.split(start, cuts) if len(at)}
    heap = list(places)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        p = np.array(places.pop(r))
        p = p[rank[p] == r]
        if len(p) > 1:
            p.sort()
            p = p[np.r_[True, p[1:] != p[:-1]]]
            own = word[p]
            if (own[1:] == own[:-1]).any():
                first = _together(p, own, r, token, after, before, merges)
                if not first.all():
                    places[r] = p[~first].tolist()
                    heapq.heappush(heap, r)
                    p = p[first]
        elif not len(p):
            continue
        q = after[p]
        right = after[q]
        token[p], rank[q], alive[q], after[p] = r, NONE, False, right
        rank[p] = NONE
        some = right >= 0
        there, right = p[some], right[some]
        before[right] = there
        rank[there] = merges.of(token[there], token[right])
        left = before[p]
        left = left[left >= 0]
        rank[left] = merges.of(token[left], token[after[left]])
        touched = np.concatenate([left, there])
        for at, new in zip(touched.tolist(), rank[touched].tolist(), strict=True):
            if new == NONE:
                continue
            if new in places:
                places[new].append(at)
            else:
                places[new] = [at]
                heapq.heappush(heap, new)
    ids, bounds = token[alive].tolist(), np.cumsum(np.bincount(word[alive], minlength=len(todo))).tolist()
    lo = 0
    for i, hi in zip(todo, bounds, strict=True):
        out[i] = ids[lo:hi]
        lo = hi
    return out


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes texts by one rank file and splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str, merges: Merges | None = None):
        self.merges = Merges(load_ranks(ranks_path)) if merges is None else merges
        self.ranks = self.merges.ranks
        self.split = regex.compile(pattern).findall
        self.ids: dict[str, tuple[int, ...]] = {}
        self.token = {i: b for b, i in self.ranks.items()}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text. Words not seen yet are replayed together first."""
        cut = [self.split(t) for t in texts]
        new = set().union(*cut).difference(self.ids)
        if len(self.ids) + len(new) > KEPT_WORDS:
            self.ids.clear()
            new = set().union(*cut)
        fresh = list(new)
        self.ids.update(zip(fresh, replay([w.encode() for w in fresh], self.merges), strict=True))
        get = self.ids.__getitem__
        for words in cut:
            ids: list[int] = []
            for w in map(get, words):
                ids += w
            yield ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def shared_merges(spark: SparkSession, ranks_path: str) -> Broadcast:
    """The table of pairs, built once on the driver; it is as large as the vocabulary, whatever the corpus."""
    return spark.sparkContext.broadcast(Merges(load_ranks(ranks_path)))


def codec(shared: Broadcast, ranks_path: str, pattern: str) -> Codec:
    """A worker's codec of the broadcast pairs; it keeps it, and the words that it has seen, for its next tasks."""
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks_path, pattern, shared.value)
    return _CODECS[key]


def chunks(texts: list[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters, with the index of their first."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: doc_id, ids (array of int).

    Null and empty texts have no ids; very long texts are encoded whole. Repeated rows, and
    rows without an id, are encoded each; of equal pairs in a word the leftmost merges first;
    an empty table gives an empty one; other columns are ignored, whatever their names. No
    shuffle: each task encodes its own rows.
    """
    shared = shared_merges(docs.sparkSession, ranks_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared, ranks_path, pattern)
        for batch in batches:
            for lo, texts in chunks(batch.column(1).to_pylist()):
                ids = pa.array(list(own.encode(texts)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), ids], names=["doc_id", "ids"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(encode, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Bytes of every row's ids: doc_id, decoded (binary)."""
    shared = shared_merges(encoded.sparkSession, ranks_path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared, ranks_path, pattern)
        for batch in batches:
            out = [own.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, decoded binary")


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and keep the digests only, in one pass over the texts.

    Same rules as ``bpe_encode``; ids and bytes never leave the task.
    """
    shared = shared_merges(docs.sparkSession, ranks_path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared, ranks_path, pattern)
        shown = [str(i) for i in range(max(own.ranks.values()) + 1)]
        for batch in batches:
            for lo, texts in chunks(batch.column(1).to_pylist()):
                n, enc, dec = [], [], []
                for ids in own.encode(texts):
                    n.append(len(ids))
                    enc.append(hashlib.sha256(" ".join([shown[i] for i in ids]).encode()).hexdigest())
                    dec.append(hashlib.sha256(own.decode(ids)).hexdigest())
                cols = [batch.column(0).slice(lo, len(texts)), pa.array(np.array(n, np.int64)), pa.array(enc), pa.array(dec)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
