"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over a vocabulary of words and word beginnings that the labels
set apart. The examples lie in a block-max inverted index: postings of a term are grouped
in blocks of examples, and each block states its largest weight, so that blocks which
can't hold a nearest example are passed over and the result is still exact. Votes weighted
by similarity give a raw score; isotonic regression on left-out examples calibrates it.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Bound of the examples that are learned from, for each of the two labels.
EXAMPLES = 6_000
#: How far the labels must set a term apart (chi-squared), and in how many examples it must stand
#: for that to mean anything. All such terms are kept.
LEAST_CHI2, LEAST_SUPPORT = 25.0, 3
PREFIXES = (4, 5, 6)
NEIGHBOURS, BLOCK = 15, 64
#: From this score on a text is called toxic.
THRESHOLD = 0.3
_MARKS = ".,;:!?\"'()[]{}<>#*$%&|-_/\\"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def term_counts(text: str) -> Counter:
    """Words and their beginnings (marked by an asterisk) with their counts."""
    out: Counter = Counter()
    for word, n in Counter(text.lower().split()).items():
        word = word.strip(_MARKS)
        if word:
            out[word] += n
            for k in PREFIXES:
                if len(word) > k:
                    out[word[:k] + "*"] += n
    return out


class Vocabulary:
    """Chosen terms; finds them in a text without listing all its terms."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.heads = {t.rstrip("*")[: PREFIXES[0]] for t in terms}

    def find(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        number, heads, least = self.number, self.heads, PREFIXES[0]
        for word, n in Counter(text.lower().split()).items():
            word = word.strip(_MARKS)
            if word[:least] in heads:
                for t in (word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]):
                    if (i := number.get(t)) is not None:
                        out[i] = out.get(i, 0) + n
        return out


class BlockMaxIndex:
    """Exact nearest examples by cosine, in blocks of ``BLOCK`` examples.

    ``vectors`` are unit vectors as (terms, weights); their order is their rank in ties.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.size, self.vectors = len(vectors), vectors
        blocks = -(-max(self.size, 1) // BLOCK)
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        doc = np.repeat(np.arange(self.size), [len(v[0]) for v in vectors])
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order], weight[order]
        self.most = np.zeros((n_terms, blocks))
        np.maximum.at(self.most, (term, doc // BLOCK), weight)
        cell = term[order] * blocks + self.doc // BLOCK
        self.cut = np.searchsorted(cell, np.arange(n_terms * blocks + 1))
        self.blocks = blocks

    @functools.cached_property
    def _rows(self) -> dict[int, np.ndarray]:
        """Postings of terms that an eighth of the examples hold, as a weight for each example."""
        rows, ends = {}, self.cut[:: self.blocks].tolist()
        for t, (a, b) in enumerate(itertools.pairwise(ends)):
            if 8 * (b - a) >= self.size:
                rows[t] = np.zeros(self.blocks * BLOCK)
                rows[t][self.doc[a:b]] = self.weight[a:b]
        return rows

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_rows"}

    def _scores(self, terms: np.ndarray, weights: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Similarities of the examples of the blocks lo to hi - 1."""
        rows, out = self._rows, np.zeros((hi - lo) * BLOCK)
        begin, end = self.cut[terms * self.blocks + lo].tolist(), self.cut[terms * self.blocks + hi].tolist()
        doc, share = [], []
        for t, w, a, b in zip(terms.tolist(), weights.tolist(), begin, end, strict=True):
            if t in rows:
                out += w * rows[t][lo * BLOCK : hi * BLOCK]
            elif b > a:
                doc.append(self.doc[a:b])
                share.append(w * self.weight[a:b])
        if doc:
            out += np.bincount(np.concatenate(doc) - lo * BLOCK, np.concatenate(share), minlength=len(out))
        return np.minimum(out, 1.0)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and examples of the k nearest above 0, nearest first, and of all as near as the k-th.

        The blocks of the highest bounds are looked at first; they give a similarity that
        the k-th nearest has at least. Then all blocks whose bounds reach it, in runs of
        neighbouring blocks.
        """
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        least = 1e-12
        for lo in order[:2].tolist():
            score = self._scores(terms, weights, lo, lo + 1)
            if without // BLOCK != lo and len(score) >= k:
                least = max(least, np.partition(score, -k)[-k] - 1e-9)
        best, found = [], []
        for lo, hi in _runs(np.flatnonzero(bound >= least)):
            score = self._scores(terms, weights, lo, hi)
            at = np.flatnonzero(score >= least)
            best.append(score[at])
            found.append(at + lo * BLOCK)
        if not best:
            return np.zeros(0), np.zeros(0, np.int64)
        score, example = np.round(np.concatenate(best), 12), np.concatenate(found)
        score[example == without] = 0
        if len(score) > k:
            near = np.flatnonzero(score >= np.partition(score, -k)[-k])
            score, example = score[near], example[near]
        near = np.lexsort((example, -score))
        near = near[score[near] > 0]
        return score[near], example[near]


def _runs(blocks: np.ndarray, most: int = 4) -> list[tuple[int, int]]:
    """Runs that cover the blocks (ascending); smaller gaps are bridged until ``most`` runs are left."""
    if not len(blocks):
        return []
    gap = np.diff(blocks)
    cuts = np.flatnonzero(gap > 1)
    if len(cuts) >= most:
        cuts = np.sort(cuts[np.argsort(-gap[cuts], kind="stable")[: most - 1]])
    first, last = np.r_[0, cuts + 1], np.r_[cuts, len(blocks) - 1]
    return list(zip(blocks[first].tolist(), (blocks[last] + 1).tolist(), strict=True))


@dataclass
class Model:
    """Everything that scoring needs; its size is bounded by the texts of 2 * EXAMPLES examples."""

    terms: list[str]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: list[int]
    labels: np.ndarray
    weights: np.ndarray  # what an example stands for among the labelled rows
    prior: float
    none: float  # score of a text without a term of the vocabulary
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0]), np.array([0.0])))

    def vector(self, found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        return unit(found, self.idf)

    def vote(self, similarity: np.ndarray, example: np.ndarray) -> float:
        """Weighted share of toxic neighbours, drawn a little towards the prior."""
        w = similarity * similarity * self.weights[example]
        return float((0.2 * self.prior + w @ self.labels[example]) / (0.2 + w.sum()))

    def score(self, raw: float) -> float:
        return float(np.interp(raw, *self.knots))


def unit(found: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.array(sorted(found), np.int64)
    w = np.array([1 + math.log(found[t]) for t in terms.tolist()]) * idf[terms] if len(terms) else np.zeros(0)
    norm = math.sqrt(float(w @ w))
    return (terms, w / norm) if norm > 0 else (terms[:0], w[:0])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of y on x by pooling neighbours; knots for interpolation."""
    pools: list[list[float]] = []  # sum w, sum w*y, sum w*x
    for i in np.argsort(x, kind="stable").tolist():
        pools.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _examples(plain: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and label of the chosen rows, written; how many ids have each label."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
        .where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )
    totals = {0: 0, 1: 0} | {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    by_hash = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    sample = by_hash(0).unionByName(by_hash(1))  # 2 * EXAMPLES ids at most
    rows = plain.join(F.broadcast(sample), "doc_id").withColumn("own", F.xxhash64("text")).dropDuplicates(["doc_id", "own"])
    # Ids that several texts share may bring more rows than ids.
    first = lambda y: rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "own").limit(EXAMPLES)
    chosen = first(0).unionByName(first(1)).select("doc_id", "text", "label")
    return stage(chosen.repartition(-(-2 * EXAMPLES // 500), "doc_id"), "toxicity-examples"), totals


def _raw_votes(model: Model, examples: DataFrame) -> np.ndarray:
    """Each example's vote by its nearest others, found in tasks."""
    spark = examples.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.column(0).to_pylist()
            raw = [own.vote(*own.index.nearest(*own.index.vectors[i], NEIGHBOURS, without=i)) for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], names=["at", "raw"])

    n = model.index.size
    out = np.zeros(n)
    for r in spark.range(0, n, 1, max(1, -(-n // 500))).withColumnRenamed("id", "at").mapInArrow(vote, "at long, raw double").collect():
        out[r.at] = r.raw  # 2 * EXAMPLES rows at most
    shared.destroy()
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most EXAMPLES labelled texts of each label, none of them held out.

    Ids with null or contradicting labels are left out; rows that repeat an id are examples
    each, equal ones once. Document frequencies cover all of ``docs``. Where examples of one
    label, or terms that set the labels apart, are missing, nothing tells texts apart and
    every score is 0.
    """
    plain = _plain(docs, id_col, text_col)
    chosen, totals = _examples(plain, labels, id_col, label_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0, 0]
        seen = [Counter(), Counter()]
        for batch in batches:
            for text, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                n[label] += 1
                seen[label].update(term_counts(text.as_py()).keys())
        rows = [("", n[0], n[1]), *((t, seen[0][t], seen[1][t]) for t in seen[0].keys() | seen[1].keys())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["term", "clean", "toxic"])

    counts = chosen.mapInArrow(count, "term string, clean long, toxic long")
    counts = stage(counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-terms")
    size = counts.where("term = ''").first()
    n0, n1 = (size.clean, size.toxic) if size else (0, 0)
    nothing = Model([], np.zeros(0), BlockMaxIndex([], 1), [], np.zeros(0), np.zeros(0), 0.0, 0.0)
    if not n0 or not n1:
        return nothing
    a, b = F.col("toxic"), F.col("clean")
    chi2 = (
        (n0 + n1) * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2))
        / ((a + b).cast("double") * (n0 + n1 - a - b) * float(n0) * float(n1))
    )
    apart = counts.where((F.col("term") != "") & (a + b >= LEAST_SUPPORT) & (a + b < n0 + n1)).where(chi2 >= LEAST_CHI2)
    terms = sorted(r.term for r in apart.select("term").collect())  # of 2 * EXAMPLES texts
    if not terms:
        return nothing
    found_in = Vocabulary(terms).find

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(1):
                n += 1
                hit = list(found_in(text.as_py()))
                seen[hit] += 1
        seen[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["term", "df"])

    df = np.zeros(len(terms) + 1)
    for r in plain.mapInArrow(frequency, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    idf = np.log1p(df[-1] / np.maximum(df[:-1], 1))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [found_in(t.as_py()) for t in batch.column(1)]
            cols = [batch.column(0), batch.column(2), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "label", "terms", "n"])

    examples = chosen.mapInArrow(vectorise, "doc_id long, label int, terms array<int>, n array<int>").collect()  # 2 * EXAMPLES rows at most
    rows = [(r.doc_id, r.label, *unit(dict(zip(r.terms, r.n, strict=True)), idf)) for r in examples]
    stands_for = {y: totals[y] / max(1, sum(r[1] == y for r in rows)) for y in (0, 1)}
    # Examples that share their strongest term are neighbours, which tightens block maxima.
    used = sorted((r for r in rows if len(r[2])), key=lambda r: (int(r[2][np.argmax(r[3])]), r[0], r[1], r[2].tolist(), r[3].tolist()))
    weight = np.array([stands_for[r[1]] for r in used])
    prior = totals[1] / (totals[0] + totals[1])
    none = [0.0, 0.0]
    for r in rows:
        if not len(r[2]):
            none[r[1]] += stands_for[r[1]]
    none_score = (none[1] + prior) / (sum(none) + 1)
    index = BlockMaxIndex([(r[2], r[3]) for r in used], len(terms))
    model = Model(terms, idf, index, [r[0] for r in used], np.array([float(r[1]) for r in used]), weight, prior, none_score)
    x, y = isotonic(_raw_votes(model, chosen), model.labels, weight)
    model.knots = (np.concatenate([[0.0], x, [1.0]]), np.concatenate([[min(none_score, y[0])], y, [max(y[-1], 0.99)]]))
    return model


def score(
    docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity_score", evidence_col: str = "toxicity_evidence"
) -> DataFrame:
    """``docs`` with toxicity_score and toxicity_evidence (nearest examples), by one pass.

    All other columns and their order stay; columns of the two names are replaced. Null and
    empty texts get the score of a text without any known term; whole texts of any length
    are scored; repeated rows are scored each; an empty table gives no rows. All examples as
    near as the last neighbour vote, so scores don't depend on ids. No shuffle, so no key can
    be hot.
    """
    docs = docs.drop(score_col, evidence_col)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        found_in = Vocabulary(own.terms).find
        known: dict[tuple, tuple[float, list]] = {}
        for batch in batches:
            out, evidence = [], []
            for text in batch.column(at):
                found = found_in(text.as_py() or "")
                key = tuple(sorted(found.items()))
                judged = known.get(key)
                if judged is None:
                    judged = own.none, []
                    if found:
                        near, which = own.index.nearest(*own.vector(found), NEIGHBOURS)
                        if len(near):
                            first = zip(near[:3].tolist(), which[:3].tolist(), strict=True)
                            judged = own.score(own.vote(near, which)), [{"doc_id": own.ids[i], "similarity": x, "toxic": int(own.labels[i])} for x, i in first]
                    if len(key) <= 8 and len(known) < 20_000:  # short ones come again
                        known[key] = judged
                out.append(judged[0])
                evidence.append(judged[1])
            cols = [*batch.columns, pa.array(out, pa.float64()), pa.array(evidence, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, score_col, evidence_col])

    evidence = "array<struct<doc_id: bigint, similarity: double, toxic: int>>"
    extra = docs.select("*", F.lit(None).cast("double").alias(score_col), F.lit(None).cast(evidence).alias(evidence_col))
    return docs.mapInArrow(judge, extra.schema)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("toxicity_evidence").alias("evidence"),
    )
