"""Retrieval: prefilters, text and vector search, fusion, merging.

``obs``: case_id, modality, mod_ord, row_ord, entity_id, ts, text, source_file. Evidence
adds graph_score, vector_score, hybrid_score and an order (query_ord, rank).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .search import cosine_topk, term_lists, text_topk

__all__ = ["cosine_topk", "text_topk"]
#: Modalities whose text is searched.
INDEXED = ("logs", "metrics", "events")
#: Bytes of text that are weighed at once.
WEIGHED_BYTES = 8 << 20
#: Keys of a run by which rows are counted to find the first ones of a modality.
HEAD_RUN = 8192
#: Bits of the filter of wanted entities (a multiple of the 32,768 of one bitmap): 2 MB.
FILTER_BITS = 1 << 24


def _one_of_each(evidence: DataFrame, order: Column) -> DataFrame:
    """The first row by ``order`` of each observation: equal case, file, entity, time and text.

    These are compared by a 128-bit digest, and rows are combined before they are shuffled.
    """
    same = F.struct("case_id", "source_file", "entity_id", F.unix_micros("ts").alias("ts"), "text")
    row = F.struct(*[F.col(f"`{c}`") for c in evidence.columns])
    keyed = evidence.select(F.unhex(F.md5(F.to_json(same))).alias("__same"), order.alias("__order"), row.alias("__row"))
    return keyed.groupBy("__same").agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")


def wanted_bits(ids: DataFrame, key: tuple[str, ...] = ("case_id", "entity_id")) -> DataFrame:
    """bucket, bits: a bit for the hash of each ``key``; FILTER_BITS in all, however many ids there are."""
    return ids.select((_bit(key) + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def _bit(key: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))


def _marked(rows: DataFrame, ids: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``rows`` with __maybe: whether their ``key`` may be among ``ids``."""
    place = F.bitmap_bit_position(_bit(key) + 1)
    bits = F.broadcast(wanted_bits(ids, key).withColumnRenamed("bucket", "__bucket"))  # FILTER_BITS / 8 bytes at most
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(__place div 8 as int) + 1"), 1)), 16, 10).cast("int")
    placed = rows.withColumns({"__bucket": F.bitmap_bucket_number(_bit(key) + 1), "__place": place})
    marked = placed.join(bits, "__bucket", "left").withColumn("__byte", F.coalesce(byte, F.lit(0)))
    return marked.select(*rows.columns, F.expr("shiftright(__byte, cast(__place % 8 as int)) & 1 = 1").alias("__maybe"))


def maybe_wanted(obs: DataFrame, ids: DataFrame, key: tuple[str, ...] = ("case_id", "entity_id")) -> DataFrame:
    """Rows whose entity (or other ``key``) is among ``ids``, and a few others: a Bloom filter that runs before rows are shuffled."""
    return _marked(obs.where(F.col(key[-1]).isNotNull()), ids, key).where("__maybe").drop("__maybe")


def first_texts(texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows (``key``, text) that are the first by ``key`` with their text, and the others: ``key``, first (of the same text).

    Digests of the texts (128 bits) are grouped. A bit map of the copies leaves them out; the keys that it takes for a copy's
    wrongly are looked up, and only texts that a bit map of these finds are shuffled.
    """
    named = texts.where("text is not null").select(key, F.unhex(F.md5("text")).alias("same"))
    groups = named.groupBy("same").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    copies = stage(named.join(groups, "same").where(F.col(key) != F.col("first")).select(key, "first"), "copies")
    marked = _marked(texts.where("text is not null").select(key, "text"), copies, (key,))
    maybe = marked.where("__maybe").drop("__maybe")
    wrong = stage(maybe.select(key).join(copies.select(key), key, "left_anti"), "no-copies")
    others = maybe_wanted(maybe, wrong, (key,)).join(wrong, key, "left_semi").select(*maybe.columns)
    return marked.where("not __maybe").drop("__maybe").unionByName(others), copies


def unresolved(obs: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows without an entity (null, not ''), capped by case and modality if asked."""
    loose = obs.where("entity_id is null")
    if cap is not None:
        w = Window.partitionBy("case_id", "modality").orderBy("row_ord", "text")
        loose = loose.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")
    return loose


def topology_filter(obs: DataFrame, inside: DataFrame, unresolved_cap: int | None = None) -> DataFrame:
    """Rows of entities inside, and rows without an entity (null, not ''), capped if asked."""
    resolved = maybe_wanted(obs, inside).join(inside.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_semi")
    return resolved.select(*obs.columns).unionByName(unresolved(obs, unresolved_cap))


def head_per_modality(obs: DataFrame, n: int) -> DataFrame:
    """The first n rows of each case and modality.

    Rows are counted by runs of HEAD_RUN keys first; only those up to the run that holds the n-th
    are sorted.
    """
    key = ["case_id", "modality"]
    run = F.coalesce(F.expr(f"row_ord div {HEAD_RUN}"), F.lit(-(2**63)))  # rows without a key come first
    so_far = F.sum("__rows").over(Window.partitionBy(*key).orderBy("__run"))
    counts = obs.groupBy(*key, run.alias("__run")).agg(F.count(F.lit(1)).alias("__rows"))
    last = counts.withColumn("__rows", so_far).where(F.col("__rows") >= n).groupBy(*key).agg(F.min("__run").alias("__last"))
    early = obs.join(F.broadcast(last), key, "left").where(F.isnull("__last") | (run <= F.col("__last"))).select(*obs.columns)  # a row for each case and modality
    w = Window.partitionBy(*key).orderBy("row_ord", "entity_id", "text")
    return early.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def corpus(obs: DataFrame, modalities: tuple[str, ...] = INDEXED) -> DataFrame:
    return obs.where(F.col("modality").isin(*modalities))


def term_weights(texts: DataFrame, key: list[str], encoder=None, listed: bool = False) -> DataFrame:
    """Unit-length sparse vectors: key columns, term, weight; ``key`` tells the texts apart.

    ``listed`` gives key columns, terms, weights instead: a row for each text that has a term.

    Terms are runs of a-z of the lower-cased text, weighted by count. ``encoder`` (a
    function for mapInPandas from key and text to key, term, weight) may stand in for it.
    A task weighs its own texts, so nothing is shuffled.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in texts.select(*key).dtypes)
    if encoder is not None:
        rows = texts.select(*key, "text").mapInPandas(encoder, f"{kinds}, term string, weight double")
        return term_lists(rows, key) if listed else rows

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(len(key))).to_numpy(zero_copy_only=False)) // WEIGHED_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
            for lo, hi in itertools.pairwise(cuts):
                part = batch.slice(lo, hi - lo)
                lists = pc.split_pattern_regex(part.column(len(key)), "[^a-z]+")
                terms = lists.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                kinds_of = max(1, len(terms.dictionary))
                pair, n = np.unique(row * kinds_of + terms.indices.to_numpy(), return_counts=True)
                row, code = pair // kinds_of, pair % kinds_of
                some = pc.not_equal(terms.dictionary, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
                row, code, n = row[some], code[some], n[some].astype(float)
                norm = np.sqrt(np.bincount(row, n * n, minlength=len(lists)))
                if listed:
                    at, count = np.unique(row, return_counts=True)
                    cut = pa.array(np.r_[0, np.cumsum(count)], pa.int32())
                    both = [pa.ListArray.from_arrays(cut, x) for x in (terms.dictionary.take(pa.array(code)), pa.array(n / norm[row]))]
                    yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(at)) for c in range(len(key))], *both], names=[*key, "terms", "weights"])
                    continue
                cols = [part.column(c).take(pa.array(row)) for c in range(len(key))]
                yield pa.RecordBatch.from_arrays([*cols, terms.dictionary.take(pa.array(code)), pa.array(n / norm[row])], names=[*key, "term", "weight"])

    lowered = texts.where("text is not null").select(*key, F.lower("text").alias("text"))
    return lowered.mapInArrow(weigh, f"{kinds}, terms array<string>, weights array<double>" if listed else f"{kinds}, term string, weight double")


def first_of_equal(texts: DataFrame, on: list[str], ids: list[str], k: int, encoder=None) -> DataFrame:
    """``on``, ``ids``, text: of rows with equal words the k first by ``ids``, and some others.

    Ties fall to ``ids``, so no other row is among the k nearest of a query of its ``on``. Each
    batch of rows drops its own, so nothing is shuffled or sorted. Without an ``encoder`` texts
    are equal where their runs of a-z are.
    """
    words = F.col("text") if encoder is not None else F.regexp_replace(F.lower("text"), "[^a-z]+", " ")
    same = F.unhex(F.md5(F.to_json(F.struct(*on, words.alias("words"))))).alias("same")
    kept = [*on, *ids, "text"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(len(kept)).dictionary_encode().indices
            rows = pa.table([code, *[batch.column(len(on) + i) for i in range(len(ids))]], names=["code", *ids])
            at = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in rows.column_names])
            code = code.take(at).to_numpy()
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
            place = np.arange(len(code)) - np.repeat(start, np.diff(np.r_[start, len(code)]))
            yield batch.take(at.filter(pa.array(place < k))).select(kept)

    asked = texts.where("text is not null").select(*kept, same)
    return asked.mapInArrow(first, ", ".join(f"{c} {t}" for c, t in asked.select(*kept).dtypes))


def fuse(hits: DataFrame, graph_scores: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """hybrid = alpha * graph + beta * vector; entities without a graph score count 0."""
    g = graph_scores.select("case_id", "entity_id", "graph_score")
    return (
        hits.join(g, ["case_id", "entity_id"], "left")
        .withColumn("graph_score", F.coalesce("graph_score", F.lit(0.0)))
        .withColumn("hybrid_score", alpha * F.col("graph_score") + beta * F.col("vector_score"))
    )


def first_query_wins(evidence: DataFrame) -> DataFrame:
    """One row per observation: that of the earliest query, not the best one."""
    return _one_of_each(evidence, F.struct("query_ord", (-F.col("hybrid_score")).alias("s"), "rank"))


def graph_direct(obs: DataFrame, graph_scores: DataFrame, members: DataFrame, alpha: float = 0.5, top: int = 10, per_entity: int = 6, inside: DataFrame | None = None) -> DataFrame:
    """First observations of the top entities, services being replaced by their members (those ``inside``, where that is given).

    Members come one after the other, so the first ``per_entity`` that have a row hold all that counts; only their rows
    are shuffled.
    """
    best = graph_scores.where(F.col("rank") <= top).select("case_id", F.col("entity_id").alias("service_id"), "graph_score")
    key = ["case_id", "entity_id"]
    wide = best.join(members, ["case_id", "service_id"], "left").select(
        "case_id", "service_id", "graph_score", F.coalesce("member_id", "service_id").alias("entity_id"), F.coalesce("member_ord", F.lit(0)).alias("member_ord")
    )
    wide = stage(wide if inside is None else wide.join(inside.select(*key), key, "left_semi").select(*wide.columns), "wide")
    named = obs.where("entity_id <> ''")
    there = maybe_wanted(named.select(*key), wide).distinct()
    place = F.dense_rank().over(Window.partitionBy("case_id", "service_id").orderBy("member_ord", "entity_id"))
    first = stage(wide.join(there, key, "left_semi").withColumn("__place", place).where(F.col("__place") <= per_entity).select(*wide.columns), "first-members")
    later = [F.asc_nulls_last(c) for c in ("row_ord", "text", "ts")]
    w = Window.partitionBy("case_id", "service_id").orderBy("member_ord", "entity_id", "mod_ord", *later)
    return (
        first.join(maybe_wanted(named, first), key)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= per_entity)
        .withColumn("vector_score", F.lit(0.0))
        .withColumn("hybrid_score", alpha * F.col("graph_score"))
        .drop("member_ord")
    )


def merge(evidence: DataFrame) -> DataFrame:
    """One row per observation: the best; of equals, that of the earlier list (list_ord)."""
    return _one_of_each(evidence, F.struct((-F.col("hybrid_score")).alias("s"), "list_ord", "rank"))


def balanced_sample(obs: DataFrame, total: int = 200) -> DataFrame:
    """An equal share for each modality, rows with an entity first; all scores 0."""
    share = max(1, total // 5)
    w = Window.partitionBy("case_id", "modality").orderBy((F.coalesce(F.col("entity_id"), F.lit("")) == "").cast("int"), "row_ord", "entity_id", "text")
    out = obs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= share)
    return out.withColumns({c: F.lit(0.0) for c in ("graph_score", "vector_score", "hybrid_score")})


def alpha_sweep(hits: DataFrame, graph_scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Fusion under each (alpha, beta) of a small table of weights."""
    both = fuse(hits, graph_scores).drop("hybrid_score").join(F.broadcast(weights))  # a handful of rows
    return both.withColumn("hybrid_score", F.col("alpha") * F.col("graph_score") + F.col("beta") * F.col("vector_score"))


def shortlist(texts: DataFrame, definitions: DataFrame, k: int = 5, encoder=None) -> DataFrame:
    """case_id, slug, rank, similarity: the fault types whose ``slug: definition`` is nearest to a text.

    ``definitions`` (slug, definition) is a dimension of some dozens of rows; whether it is
    broadcast is left to its measured size. A text gets min(k, n) types, also such of
    similarity 0; a blank text gets none, and the caller then takes all.
    """
    known = definitions.select("slug", F.concat_ws(": ", "slug", "definition").alias("text"))
    asked = texts.where(F.col("text").rlike(r"\S"))
    vectors = term_weights(known, ["slug"], encoder, listed=True)
    top = text_topk(term_weights(asked, ["case_id"], encoder, listed=True), vectors, ["case_id"], ["slug"], [], k, asked=asked, rows=known)
    return top.select("case_id", "slug", "rank", F.col("vector_score").alias("similarity"))
