"""Pieces of a SentencePiece BPE model, by vectorised merge rounds.

A task's texts are cut into words (a run of blanks and what follows it: no piece holds a blank
after another character); each different word is held once. All words lie in flat numpy arrays
of symbols. A round finds each word's least pair rank, merges the leftmost pairs of that rank
in all words at once, and closes the gaps; a word without a pair leaves the arrays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text whose words are held at once, and words whose pieces a Python worker keeps.
CHUNK_CHARS, KEPT_WORDS = 4 << 20, 400_000
#: The blank as the model writes it, and what an unknown piece decodes to: fixed values.
BLANK, UNKNOWN = "▁", " ⁇ "
NONE = np.iinfo(np.int64).max
_WORD = re.compile(" *[^ ]+| +")


class Model:
    """Tables of a model: which piece two neighbouring symbols make, and its rank.

    A symbol is the id of a piece, or ``size`` plus the code point of a character that is no
    piece. Ranks order scores downwards; pieces of equal score share a rank.
    """

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = own.get_piece_size()
        text = [own.id_to_piece(i).replace(BLANK, " ") for i in range(self.size)]
        plain = [not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i)) for i in range(self.size)]
        if any(own.is_unused(i) for i in range(self.size)) or any(plain[i] and " " in t.lstrip(" ") for i, t in enumerate(text)):
            raise ValueError("the model has unused pieces or pieces with a blank after another character")
        self.prefix = own.encode("a", out_type=str)[0].startswith(BLANK)
        self.byte = np.array([own.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        #: Bytes that a piece stands for; those of byte pieces are single.
        self.bytes_of = [t.encode() if p else b"" for t, p in zip(text, plain, strict=True)]
        for b, i in enumerate(self.byte.tolist()):
            self.bytes_of[i] = bytes([b])
        for i in range(self.size):
            if own.is_unknown(i):
                self.bytes_of[i] = UNKNOWN.encode()
        known = {t: i for i, t in enumerate(text) if plain[i]}
        symbol = lambda t: known.get(t, self.size + ord(t) if len(t) == 1 else None)
        scores = np.array([own.get_score(i) for i in range(self.size)], np.float32)
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs = sorted(
            ((left << 32) | right, i)
            for t, i in known.items()
            for k in range(1, len(t))
            if (left := symbol(t[:k])) is not None and (right := symbol(t[k:])) is not None
        )
        self.pair, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.array([-1]), np.array([0]))
        self.rank = rank[self.made].astype(np.int64)
        single = sorted((ord(t), i) for t, i in known.items() if len(t) == 1)
        self.code, self.of_code = (np.array(x, np.int64) for x in zip(*single, strict=True)) if single else (np.array([-1]), np.array([0]))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        return np.where(self.code[at] == codes, self.of_code[at], codes + self.size)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they make none) and piece of neighbouring symbols."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NONE), self.made[at]


def _together(p: np.ndarray, symbol: np.ndarray, last: np.ndarray, first: np.ndarray, own: np.ndarray, least: np.ndarray, model: Model) -> np.ndarray:
    """Which places of ``p``, the pairs of their word's least rank, merge now.

    Of places that overlap, every second one falls away with the one before it. A word's places
    go from the left as long as none leaves a pair of that rank or a lower one beside it: such a
    pair is older than the places further right, which wait for the next round.
    """
    linked = np.r_[False, p[1:] == p[:-1] + 1]
    head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(p))))
    out = (np.arange(len(p)) - head) % 2 == 0
    s, own = p[out], own[out]
    if (own[1:] == own[:-1]).any():
        made, r = model.lookup(symbol[s], symbol[s + 1])[1], least[own]
        beside = np.r_[False, s[1:] == s[:-1] + 2]
        before = np.where(beside, np.r_[0, made[:-1]], symbol[s - 1])
        low = ~first[s] & (model.lookup(before, made)[0] <= r)
        after = np.minimum(s + 2, len(symbol) - 1)
        low |= ~last[s + 1] & (model.lookup(made, symbol[after])[0] <= r)
        seen = np.cumsum(low) - low
        begins = np.r_[True, own[1:] != own[:-1]]
        out[out] = seen == np.maximum.accumulate(np.where(begins, seen, 0))
    return out


def merge_rounds(words: list[str], model: Model) -> list[list[int]]:
    """Ids of each word: the pair of the best score is merged first, of equals the leftmost."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if not total:
        return [[] for _ in words]
    symbol = model.symbols(np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64))
    home, left, n_left = np.cumsum(sizes) - sizes, np.zeros(total, np.int64), np.zeros(len(words), np.int64)
    word = np.flatnonzero(sizes)
    length = sizes[word]
    rank = np.full(total, NONE)
    rank[:-1] = model.lookup(symbol[:-1], symbol[1:])[0]
    rank[np.cumsum(length) - 1] = NONE
    while len(word):
        start = np.cumsum(length) - length
        least = np.minimum.reduceat(rank, start)
        done = least == NONE
        if done.any():
            rest = np.repeat(done, length)
            into = np.repeat(home[word[done]], length[done])
            inside = np.arange(len(into)) - np.repeat(np.cumsum(length[done]) - length[done], length[done])
            left[into + inside] = symbol[rest]
            n_left[word[done]] = length[done]
            symbol, rank, word, length, least = symbol[~rest], rank[~rest], word[~done], length[~done], least[~done]
            if not len(word):
                break
            start = np.cumsum(length) - length
        own = np.repeat(np.arange(len(word)), length)
        p = np.flatnonzero(rank == least[own])
        first, last = np.zeros(len(symbol), bool), np.zeros(len(symbol), bool)
        first[start] = last[start + length - 1] = True
        p = p[_together(p, symbol, last, first, own[p], least, model)]
        symbol[p] = model.lookup(symbol[p], symbol[p + 1])[1]
        last[p] |= last[p + 1]
        keep = np.ones(len(symbol), bool)
        keep[p + 1] = False
        length = length - np.bincount(own[p], minlength=len(word))
        place = (np.cumsum(keep) - 1)[p]
        symbol, rank, first, last = symbol[keep], rank[keep], first[keep], last[keep]
        changed = np.zeros(len(symbol), bool)
        changed[place] = changed[place[~first[place]] - 1] = True
        touched = np.flatnonzero(changed)
        inner = touched[~last[touched]]
        rank[touched] = NONE
        rank[inner] = model.lookup(symbol[inner], symbol[inner + 1])[0]
    inside = np.arange(total) - np.repeat(home, sizes)
    flat = left[inside < np.repeat(n_left, sizes)]
    ids, out, lo = flat.tolist(), [], 0
    strange = np.add.reduceat(np.r_[flat >= model.size, False].astype(np.int64), np.minimum(np.cumsum(n_left) - n_left, len(flat))) * (n_left > 0)
    for hi, odd in zip(np.cumsum(n_left).tolist(), strange.tolist(), strict=True):
        part = ids[lo:hi]
        if odd:  # characters that are no piece fall back to their bytes
            part = [i for s in part for i in ([s] if s < model.size else model.byte[list(chr(s - model.size).encode())].tolist())]
        out.append(part)
        lo = hi
    return out


class Words:
    """What ``keep`` makes of the ids of each word, kept for words seen again."""

    def __init__(self, model: Model, keep: Callable[[list[int]], object]):
        self.model, self.keep, self.seen = model, keep, {}

    def of(self, texts: list[str]) -> Iterator[list]:
        """For each text, what is kept of its words in order. New words are merged together first."""
        blank = " " if self.model.prefix else ""
        cut = [_WORD.findall(blank + t.replace(BLANK, " ")) if t else [] for t in texts]
        new = set().union(*cut).difference(self.seen)
        if len(self.seen) + len(new) > KEPT_WORDS:
            self.seen.clear()
            new = set().union(*cut)
        fresh = list(new)
        self.seen.update(zip(fresh, map(self.keep, merge_rounds(fresh, self.model)), strict=True))
        get = self.seen.__getitem__
        for words in cut:
            yield list(map(get, words))


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK_CHARS characters, with the index of their first."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def _shared(spark: SparkSession, model_path: str):
    """The model's tables, built once on the driver; some megabytes, whatever the corpus."""
    return spark.sparkContext.broadcast(Model(model_path))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def decode_ids(ids: list[int], model: Model) -> bytes:
    """The text of ids as the encoder gives them, in UTF-8; the blank that it put in front goes."""
    out = b"".join(map(model.bytes_of.__getitem__, ids))
    return out[1:] if model.prefix and out.startswith(b" ") else out


def piece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Piece ids of every whole text: doc_id, ids (array of int), without begin or end ids.

    Null and empty texts have no ids; very long texts are encoded whole. Of equal scores the
    leftmost pair merges first. Repeated rows, and rows without an id, are encoded each; an
    empty table gives an empty one; other columns are ignored, whatever their names. No
    shuffle: each task encodes its own rows.
    """
    shared = _shared(docs.sparkSession, model_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value, tuple)
        for batch in batches:
            for lo, texts in _chunks(batch.column(1).to_pylist()):
                ids = pa.array([[i for w in found for i in w] for found in words.of(texts)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), ids], names=["doc_id", "ids"])

    return _plain(docs, id_col, text_col).mapInArrow(encode, "doc_id long, ids array<int>")


def piece_decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Texts of every row's ids, as ``piece_encode`` gives them: doc_id, text. Null ids are none."""
    shared = _shared(encoded.sparkSession, model_path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids or [], shared.value).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and keep the digests only, in one pass over the texts.

    Same rules as ``piece_encode``. A word's ids are written out and decoded once; a character's
    bytes never lie in two words, so the words' decoded bytes make the text's.
    """
    shared = _shared(docs.sparkSession, model_path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(model, lambda ids: (len(ids), ",".join(map(str, ids)), b"".join(map(model.bytes_of.__getitem__, ids))))
        for batch in batches:
            for lo, texts in _chunks(batch.column(1).to_pylist()):
                n, enc, dec = [], [], []
                for found in words.of(texts):
                    sizes, shown, back = zip(*found, strict=True) if found else ((), (), ())
                    text = b"".join(back)
                    n.append(sum(sizes))
                    enc.append(hashlib.sha256(",".join(shown).encode()).hexdigest())
                    dec.append(hashlib.sha256(text[1:] if model.prefix and text.startswith(b" ") else text).hexdigest())
                cols = [batch.column(0).slice(lo, len(texts)), pa.array(np.array(n, np.int64)), pa.array(enc), pa.array(dec)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _plain(docs, id_col, text_col).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
