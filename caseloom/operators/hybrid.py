"""Evidence of each system for all cases at once, from observations, topology and alerts.

``obs`` as in ``retrieve``; (case_id, mod_ord, row_ord) tells observations apart. In ``hybrid_evidence``
several may have one row_ord: entity_id, text and ts then decide on their order.
``alerts``: case_id, entry_entity_id (may be null), alert_text; one row for each case.
Evidence has the columns of ``obs``, graph_score, vector_score, hybrid_score and rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import alert_keywords
from ..session import stage
from . import graph, retrieve
from .search import DIGITS

#: Hits of a query, words of the alert that are queries of their own.
TOP_K, KEYWORDS = 20, 5
#: So many times the wanted hits are asked for before it is known which are inside; what too few of these are is asked for so many times more.
SPARE, MORE = 4, 8
#: Of written observations; texts are most of it.
ZSTD = {"compression": "zstd"}
_ROW = ["case_id", "mod_ord", "row_ord"]
_PLACE = ["case_id", "mod_ord", "place", "uid"]
_SCORES = ["graph_score", "vector_score", "hybrid_score"]


def alert_queries(alerts: DataFrame, keywords: int = KEYWORDS) -> DataFrame:
    """case_id, query_ord, text: the alert's text, then its first keywords."""
    words = F.slice(alert_keywords(F.col("alert_text")), 1, keywords) if keywords else F.array().cast("array<string>")
    return alerts.select("case_id", F.posexplode(F.concat(F.array("alert_text"), words)).alias("query_ord", "text"))


def search(obs: DataFrame, queries: DataFrame, k: int = TOP_K, encoder=None) -> DataFrame:
    """The ``k`` observations of its case nearest to each query: obs, query_ord, vector_score, rank.

    Observations without a word of the query score 0 and fill up what is lacking.
    """
    indexed = retrieve.corpus(obs)
    vectors = retrieve.term_weights(retrieve.first_of_equal(indexed, _ROW[:1], _ROW[1:], k, encoder), _ROW, encoder)
    asked = retrieve.term_weights(queries, ["case_id", "query_ord"], encoder)
    top = retrieve.text_topk(asked, vectors, ["case_id", "query_ord"], _ROW, ["case_id"], k, asked=queries, rows=indexed)
    return top.join(obs, _ROW)


def told_apart(obs: DataFrame) -> DataFrame:
    """``obs``, written, with uid (a number of each row) and place (row_ord, null as the last)."""
    place = F.coalesce(F.col("row_ord").cast("bigint"), F.lit(2**63 - 1))
    return stage(obs.withColumn("uid", F.monotonically_increasing_id()).withColumn("place", place), "obs", ZSTD)


def row_order() -> list[Column]:
    """The order of the rows of a case and modality."""
    return [F.asc_nulls_last("row_ord"), F.asc_nulls_first("entity_id"), F.asc_nulls_last("text"), F.asc_nulls_last("ts")]


def search_inside(obs: DataFrame, inside: DataFrame, queries: DataFrame, k: int = TOP_K, unresolved_cap: int | None = None, encoder=None) -> DataFrame:
    """As ``search``, among the rows (``told_apart``) of entities ``inside`` and those without an entity.

    The rows aren't shuffled to learn which are inside: a bit map leaves out most others, SPARE times the
    wanted hits are found among the rest, and these few meet ``inside``. A hit counts if it comes before the last
    one that was found (others may share the last one's place). Queries with fewer than ``k`` of these are asked again for
    MORE times as many, until all rows are hits.
    """
    loose = retrieve.unresolved(obs, unresolved_cap)
    if unresolved_cap is not None:
        loose = stage(loose, "unresolved", ZSTD)
    indexed = retrieve.corpus(retrieve.maybe_wanted(obs, inside).unionByName(loose))
    left, most, found = queries, SPARE * k, []
    near = F.struct((-F.round("vector_score", DIGITS)).alias("s"), "mod_ord", "place")
    key = ["case_id", "query_ord"]
    while True:
        vectors = retrieve.term_weights(retrieve.first_of_equal(indexed, _PLACE[:1], _PLACE[1:], most, encoder), _PLACE, encoder)
        asked = retrieve.term_weights(left, key, encoder)
        top = stage(retrieve.text_topk(asked, vectors, key, _PLACE, ["case_id"], most, asked=left, rows=indexed), "near")
        last = top.where(F.col("rank") == most).select(*key, near.alias("last"))
        sure = top.join(last, key, "left").where(F.isnull("last") | (near < F.col("last"))).select(*key, "uid", "vector_score")
        rows = sure.join(retrieve.maybe_wanted(obs, sure, ("uid",)), ["case_id", "uid"])
        ids = inside.select("case_id", "entity_id")
        good = stage(rows.where("entity_id is null").unionByName(rows.join(ids, ["case_id", "entity_id"], "left_semi").select(*rows.columns)), "near-inside")
        whole = left.join(last, key, "left_anti").select(*key)
        enough = good.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(*key)
        ready = stage(whole.unionByName(enough).distinct(), "ready")
        found.append(good.join(ready, key, "left_semi"))
        left = stage(left.join(ready, key, "left_anti"), "asked-again")
        if left.isEmpty():
            break
        most *= MORE
    hits = found[0]
    for part in found[1:]:
        hits = hits.unionByName(part)
    order = Window.partitionBy(*key).orderBy(F.desc(F.round("vector_score", DIGITS)), "mod_ord", *row_order())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _listed(evidence: DataFrame, obs: DataFrame, *order) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(*order, "mod_ord", *row_order()))
    return evidence.withColumn("rank", place).select(*obs.columns, *_SCORES, "rank")


def hybrid_evidence(
    obs: DataFrame, entities: DataFrame, edges: DataFrame, alerts: DataFrame, alpha: float = 0.5, beta: float = 0.5,
    unresolved_cap: int | None = None, iterations: int | None = None, encoder=None,
) -> tuple[DataFrame, DataFrame]:
    """Evidence near the alert by topology and text, and counts of each case.

    Entities around the alert are ranked; observations of these (and such without an entity)
    are searched for the alert's text and keywords; hits are fused with the entities' scores,
    and first observations of the best entities join them. Counts: candidates, observations,
    indexed, from_vector, from_direct, evidence.
    """
    seeds = alerts.select("case_id", F.col("entry_entity_id").alias("entity_id"))
    edges = stage(edges.select("case_id", "src", "dst"), "edges")
    pairs = graph.written(graph.both_ways(edges))
    inside, scores = graph.ranked_entities(graph.nodes_of(entities, edges), edges, seeds, iterations=iterations, pairs=pairs)
    rows = obs if {"uid", "place"} <= set(obs.columns) else told_apart(obs)
    hits = retrieve.fuse(search_inside(rows, inside, alert_queries(alerts), unresolved_cap=unresolved_cap, encoder=encoder), scores, alpha, beta)
    vector = stage(retrieve.first_query_wins(hits).withColumn("list_ord", F.lit(0)), "from-vector")
    members = graph.membership(entities, graph.service_rollup(entities, edges, pairs=pairs))
    direct = retrieve.graph_direct(rows, scores, members, alpha, inside=inside).withColumn("query_ord", F.lit(0)).withColumn("list_ord", F.lit(1))
    columns = [*rows.columns, *_SCORES, "query_ord", "list_ord", "rank"]
    direct = stage(direct.select(*columns), "from-direct")
    merged = retrieve.merge(vector.select(*columns).unionByName(direct))
    evidence = stage(_listed(merged.drop("uid", "place"), obs.drop("uid", "place"), F.desc(F.round("hybrid_score", 9)), "list_ord", "query_ord"), "evidence")
    count = lambda df, name: df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    counts = alerts.select("case_id").distinct()
    searched = retrieve.corpus(rows).where("entity_id is not null").groupBy("case_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    resolved = searched.join(inside.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_semi").groupBy("case_id").agg(F.sum("n").alias("n"))
    loose = count(retrieve.corpus(retrieve.unresolved(rows, unresolved_cap)), "n")
    indexed = resolved.unionByName(loose).groupBy("case_id").agg(F.sum("n").alias("indexed"))
    parts = {"candidates": inside, "observations": rows, "from_vector": vector, "from_direct": direct, "evidence": evidence}
    for part in [indexed, *(count(df, name) for name, df in parts.items())]:
        counts = counts.join(part, "case_id", "left")
    return evidence, counts.fillna(0).select("case_id", "candidates", "observations", "indexed", "from_vector", "from_direct", "evidence")


def text_evidence(obs: DataFrame, alerts: DataFrame, per_modality: int | None = None, encoder=None) -> DataFrame:
    """Evidence by text alone: hits of the alert's text among all observations, no graph score.

    ``per_modality`` keeps the first rows of each case and modality, where that is wanted.
    """
    obs = obs if per_modality is None else retrieve.head_per_modality(obs, per_modality)
    hits = search(stage(obs, "searched"), alert_queries(alerts, 0), encoder=encoder)
    scored = hits.withColumn("graph_score", F.lit(0.0)).withColumn("hybrid_score", F.col("vector_score"))
    return _listed(scored, obs, F.desc(F.round("hybrid_score", 9)))


def sampled_evidence(obs: DataFrame, total: int = 200) -> DataFrame:
    """Evidence without retrieval: an equal share of each modality, in order of modality and place."""
    sample = retrieve.balanced_sample(obs, total)
    return _listed(sample, obs, "mod_ord", F.col("rank"))
