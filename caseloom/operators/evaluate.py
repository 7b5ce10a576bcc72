"""Scores of diagnoses against ground truth; the only module that reads the truth.

Rounded parts are rounded half to even, as the published scores are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import present
from ..session import stage

#: Fixed weights of the final score and of its reasoning part.
WEIGHTS = (0.4, 0.3, 0.3)
STATS = ("total_pipeline_time_s", "total_calls", "total_tokens", "used_entity_fallback")


def chain(steps: Column) -> Column:
    """``type: target`` of each step; missing fields are the word None."""
    word = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.transform(steps, lambda s: F.concat(word(s["step_type"]), F.lit(": "), word(s["target"])))


def checkpoints(truth: DataFrame) -> DataFrame:
    """One row per step and observability entry."""
    steps = truth.select("case_id", F.explode("steps").alias("s"))
    return steps.select("case_id", "s.step", "s.step_type", "s.target", F.explode("s.observability").alias("o")).select(
        "case_id", "step", "step_type", "target", "o.source_type", "o.signal", "o.expected.comparator", "o.expected.value", "o.expected.unit"
    )


def target_ids(truth: DataFrame, resolved: DataFrame) -> DataFrame:
    """Given ids, else ids of target entities, else resolved names, else the entities' names: case_id, targets.

    ``resolved``: case_id, pos, entity_id of root cause names.
    """
    found = resolved.where("entity_id is not null").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("pos", "entity_id"))).alias("f"))
    none = F.array().cast("array<string>")
    given = F.coalesce("target_entity_ids", none)
    entities = F.coalesce("target_entities", F.array().cast("array<struct<entity_id:string,entity_name:string>>"))
    field = lambda name: F.filter(F.transform(entities, lambda t: present(t[name])), lambda x: x.isNotNull())
    of_entities = field("entity_id")
    by_name = F.coalesce(F.transform("f", lambda x: x["entity_id"]), none)
    return truth.join(found, "case_id", "left").select(
        "case_id", F.when(F.size(given) > 0, given).when(F.size(of_entities) > 0, of_entities).when(F.size(by_name) > 0, by_name).otherwise(field("entity_name")).alias("targets")
    )


def entity_localization(results: DataFrame, targets: DataFrame, lengths: DataFrame) -> DataFrame:
    """The best of 1 for an equal id and 0.5**distance otherwise: case_id, system, score."""
    predicted = results.select("case_id", "system", F.explode_outer("predicted_entity_ids").alias("entity_id"))
    hit = targets.select("case_id", F.explode("targets").alias("entity_id"), F.lit(1.0).alias("hit")).distinct()
    near = predicted.join(hit, ["case_id", "entity_id"], "left").join(lengths, ["case_id", "entity_id"], "left")
    score = F.coalesce("hit", F.pow(F.lit(0.5), F.col("hop")), F.lit(0.0))
    return near.groupBy("case_id", "system").agg(F.bround(F.max(score), 4).alias("entity_localization"))


def fault_match(predicted: Column, truth: Column) -> Column:
    """1 if equal to the slug or its last part, or if that part is contained."""
    p, t = F.lower(F.trim(predicted)), F.lower(F.trim(truth))
    part = F.element_at(F.split(t, "-"), -1)
    return F.when((p == t) | (p == part) | F.contains(p, part), 1.0).otherwise(0.0)


def _words(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(c), r"\s+")), lambda w: w != "")


def chain_overlap(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean over truth steps of the best Jaccard with a predicted step.

    ``predicted``: case_id, system, reasoning_chain; ``truth``: case_id, chain.
    """
    steps = truth.select("case_id", F.posexplode("chain").alias("pos", "step"))
    steps = steps.select("case_id", "pos", _words(F.replace(F.col("step"), F.lit(":"), F.lit(" "))).alias("t"))
    said = predicted.select("case_id", "system", F.explode_outer("reasoning_chain").alias("p"))
    both = said.join(steps, "case_id").withColumn("p", _words(F.col("p")))
    union = F.size(F.array_union("p", "t"))
    jaccard = F.when((F.size("p") > 0) & (F.size("t") > 0), F.size(F.array_intersect("p", "t")) / union).otherwise(0.0)
    best = both.groupBy("case_id", "system", "pos").agg(F.max(jaccard).alias("best"))
    scored = best.groupBy("case_id", "system").agg(F.avg("best").alias("chain_overlap"))
    return predicted.select("case_id", "system").join(scored, ["case_id", "system"], "left").select(
        "case_id", "system", F.coalesce("chain_overlap", F.lit(0.0)).alias("chain_overlap")
    )


def checkpoint_hits(points: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of checkpoints whose signal stands in any evidence text: case_id, system, rate.

    A text meets the list of its case's signals, which one ground-truth document states. The
    lists are written first: where they measure small, the join with them needs no shuffle of
    the evidence.
    """
    signals = points.groupBy("case_id", F.lower(F.coalesce("signal", F.lit(""))).alias("signal")).agg(F.count(F.lit(1)).alias("n"))
    listed = signals.groupBy("case_id").agg(F.collect_list(F.struct("signal", "n")).alias("all"), F.sum("n").alias("total"))
    seen = evidence.select("case_id", "system", "text").join(stage(listed, "signals"), "case_id", "left")
    fits = F.filter("all", lambda s: (s["signal"] != "") & F.contains(F.lower("text"), s["signal"]))
    hits = seen.select("case_id", "system", F.explode_outer(fits).alias("s"), "total").distinct()
    hit = hits.groupBy("case_id", "system").agg(F.sum("s.n").alias("hit"), F.first("total").alias("total"))
    return hit.select("case_id", "system", F.coalesce(F.col("hit") / F.col("total"), F.lit(0.0)).alias("checkpoint_rate"))


def final_score(scores: DataFrame) -> DataFrame:
    """reasoning_process and final_score from the parts of each (case_id, system)."""
    rp = F.bround(0.5 * F.col("chain_overlap") + 0.5 * F.col("checkpoint_rate"), 4)
    with_rp = scores.withColumn("reasoning_process", rp)
    a, b, c = WEIGHTS
    total = a * F.col("entity_localization") + b * F.col("fault_identification") + c * F.col("reasoning_process")
    return with_rp.withColumn("final_score", F.bround(total, 4))


def retrieval_pr(evidence: DataFrame, rollup: DataFrame, targets: DataFrame) -> DataFrame:
    """Precision and recall of distinct entities, rolled up to their services."""
    seen = evidence.where("entity_id <> ''").select("case_id", "system", "entity_id").distinct()
    up = seen.join(rollup, ["case_id", "entity_id"], "left").select("case_id", "system", F.coalesce("service_id", "entity_id").alias("entity_id")).distinct()
    truth = targets.select("case_id", F.explode("targets").alias("entity_id")).distinct()
    want = truth.groupBy("case_id").agg(F.count(F.lit(1)).alias("want"))
    hit = up.join(truth.withColumn("hit", F.lit(1)), ["case_id", "entity_id"], "left").groupBy("case_id", "system").agg(
        F.count(F.lit(1)).alias("got"), F.coalesce(F.sum("hit"), F.lit(0)).alias("tp")
    )
    return hit.join(want, "case_id", "left").select(
        "case_id", "system", F.bround(F.col("tp") / F.col("got"), 4).alias("retrieval_precision"),
        F.bround(F.coalesce(F.col("tp") / F.col("want"), F.lit(0.0)), 4).alias("retrieval_recall"),
    )


def explainability(results: DataFrame, found: DataFrame) -> DataFrame:
    """Mean of chain length, agreeing agents and evidence, each up to its full mark."""
    of = found.join(results.select("case_id", "system", "predicted_entity_ids"), ["case_id", "system"])
    per = of.groupBy("case_id", "system").agg(
        F.count_if(F.array_contains("predicted_entity_ids", F.col("entity_id"))).alias("agree"), F.sum(F.size("supporting_evidence")).alias("cited")
    )
    part = lambda c, full: F.least(c / full, F.lit(1.0))
    score = (part(F.size("reasoning_chain"), 3.0) + part(F.coalesce("agree", F.lit(0)), 2.0) + part(F.coalesce("cited", F.lit(0)), 8.0)) / 3.0
    return results.join(per, ["case_id", "system"], "left").select(
        "case_id", "system", F.when(F.size("reasoning_chain") > 0, F.bround(score, 4)).otherwise(0.0).alias("explainability")
    )


def case_report(final: DataFrame, pr: DataFrame, explained: DataFrame, stats: DataFrame) -> DataFrame:
    """All score columns and the chosen statistics of each (case_id, system)."""
    key = ["case_id", "system"]
    out = final.join(pr, key, "left").join(explained, key, "left").join(stats.select(*key, *[c for c in STATS if c in stats.columns]), key, "left")
    return out.fillna(0.0, subset=["retrieval_precision", "retrieval_recall"])


def system_grid(cases: DataFrame, systems: DataFrame, report: DataFrame, errors: DataFrame) -> DataFrame:
    """Every case under every system; failed runs have an error and null scores."""
    key = ["case_id", "system"]
    return cases.select("case_id").join(F.broadcast(systems.select("system"))).join(report, key, "left").join(errors, key, "left")  # a handful of systems


def leaderboard(grid: DataFrame) -> DataFrame:
    """Mean scores per system; failed runs are left out of the means."""
    names = ("entity_localization", "fault_identification", "reasoning_process", "final_score")
    return grid.groupBy("system").agg(*[F.avg(c).alias(c) for c in names]).orderBy("system")
