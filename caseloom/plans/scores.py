"""Queries of the evaluation operators (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, graph, resolve, summarize
from .graphs import ROLLUP, TARGETS, reach
from .ingest import INDEX
from .registry import query
from .views import view, write_views

DIST = f"{reach('t', TARGETS, 14)}, dist AS (SELECT p.case_id, system, CASE WHEN predicted = target THEN 1.0::DOUBLE ELSE coalesce(pow(0.5::DOUBLE, hop), 0) END AS s FROM fx_pred p JOIN fx_truth g ON g.case_id = p.case_id LEFT JOIN t14 ON t14.case_id = p.case_id AND t14.entity_id = predicted), el AS (SELECT case_id, system, round_even(s, 4) AS entity_localization FROM dist)"
FAULT = "fm AS (SELECT p.case_id, system, CASE WHEN lower(fault) = lower(slug) OR contains(lower(fault), split_part(lower(slug), '-', -1)) THEN 1.0::DOUBLE ELSE 0 END AS fault_identification FROM fx_pred p JOIN fx_truth t ON t.case_id = p.case_id)"
TOKENS = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"
CHAIN = f"""cs AS (SELECT case_id, pos, {TOKENS.format("replace(step, ':', ' ')")} AS t FROM fx_steps), ps AS (SELECT case_id, system, {TOKENS.format('step1')} AS p FROM fx_pred UNION ALL SELECT case_id, system, {TOKENS.format('step2')} FROM fx_pred),
jb AS (SELECT ps.case_id, system, pos, max(len(list_intersect(p, t))::DOUBLE / len(list_distinct(list_concat(p, t)))) AS best FROM ps JOIN cs ON cs.case_id = ps.case_id GROUP BY ps.case_id, system, pos), co AS (SELECT case_id, system, avg(best) AS chain_overlap FROM jb GROUP BY case_id, system)"""
SYS_EV = "se AS (SELECT e.*, system FROM fx_evidence e CROSS JOIN fx_systems y)"
HITS = f"""{SYS_EV}, sk AS (SELECT DISTINCT case_id, system FROM se), ch AS (SELECT sk.case_id, sk.system, avg(CASE WHEN signal <> '' AND EXISTS (SELECT 1 FROM se WHERE se.case_id = sk.case_id AND se.system = sk.system AND contains(lower(text), lower(signal))) THEN 1.0::DOUBLE ELSE 0 END) AS checkpoint_rate
FROM sk JOIN fx_points p ON p.case_id = sk.case_id GROUP BY sk.case_id, sk.system)"""
FINAL = f"""fp AS (SELECT el.case_id, el.system, entity_localization, fault_identification, round_even(0.5 * chain_overlap + 0.5 * coalesce(checkpoint_rate, 0), 4) AS reasoning_process FROM el JOIN fm ON fm.case_id = el.case_id AND fm.system = el.system JOIN co ON co.case_id = el.case_id AND co.system = el.system LEFT JOIN ch ON ch.case_id = el.case_id AND ch.system = el.system),
fin AS MATERIALIZED (SELECT *, round_even(0.4::DOUBLE * entity_localization + 0.3::DOUBLE * fault_identification + 0.3::DOUBLE * reasoning_process, 4) AS final_score FROM fp)"""
PR = f"""{ROLLUP}, ru AS (SELECT DISTINCT se.case_id, system, coalesce(service_id, se.entity_id) AS entity_id FROM se LEFT JOIN roll ON roll.case_id = se.case_id AND roll.entity_id = se.entity_id WHERE se.entity_id <> ''), want AS (SELECT t.case_id, coalesce(service_id, target) AS entity_id FROM fx_truth t LEFT JOIN roll ON roll.case_id = t.case_id AND roll.entity_id = target),
pr AS (SELECT ru.case_id, system, round_even(count(w.entity_id)::DOUBLE / count(*), 4) AS retrieval_precision, round_even(count(w.entity_id)::DOUBLE, 4) AS retrieval_recall FROM ru LEFT JOIN want w ON w.case_id = ru.case_id AND w.entity_id = ru.entity_id WHERE ru.case_id IN (SELECT case_id FROM want) GROUP BY ru.case_id, system)"""


def _outcomes(spark, sf):
    """The folder with calls, truth and predictions written, which the scores read several times each."""
    return write_views(spark, sf, "fx_calls", "fx_seed", "fx_truth", "fx_pred")


def _results(spark, sf):
    p = view(spark, sf, "fx_pred")
    return p.select("case_id", "system", F.array("predicted").alias("predicted_entity_ids"), F.col("fault").alias("predicted_fault_type"), F.array("step1", "step2").alias("reasoning_chain"))


def _targets(spark, sf):
    return view(spark, sf, "fx_truth").select("case_id", F.array("target").alias("targets"))


def _localization(spark, sf):
    sf = _outcomes(spark, sf)
    p = view(spark, sf, "fx_pred").select("case_id", F.col("predicted").alias("entity_id"))
    t = view(spark, sf, "fx_truth").select("case_id", F.col("target").alias("entity_id"))
    lengths = graph.path_lengths(view(spark, sf, "fx_edges"), p, t)
    return evaluate.entity_localization(_results(spark, sf), _targets(spark, sf), lengths)


def _fault(spark, sf):
    p = view(spark, sf, "fx_pred").join(view(spark, sf, "fx_truth"), "case_id")
    return p.select("case_id", "system", evaluate.fault_match(F.col("fault"), F.col("slug")).alias("fault_identification"))


def _chain(spark, sf):
    steps = view(spark, sf, "fx_steps").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("pos", "step"))).alias("s"))
    return evaluate.chain_overlap(_results(spark, sf), steps.select("case_id", F.transform("s", lambda x: x["step"]).alias("chain")))


def _system_evidence(spark, sf):
    return view(spark, sf, "SELECT e.*, system FROM fx_evidence e CROSS JOIN fx_systems y")


def _hits(spark, sf):
    return evaluate.checkpoint_hits(view(spark, sf, "fx_points"), _system_evidence(spark, sf))


def _final(spark, sf):
    sf = _outcomes(spark, sf)
    key = ["case_id", "system"]
    parts = _localization(spark, sf).join(_fault(spark, sf), key).join(_chain(spark, sf), key).join(_hits(spark, sf), key, "left")
    return evaluate.final_score(parts.fillna(0.0, subset=["checkpoint_rate"]))


def _pr(spark, sf):
    sf = write_views(spark, sf, "fx_calls", "fx_truth")
    rollup = graph.service_rollup(view(spark, sf, "fx_entities"), view(spark, sf, "fx_edges"))
    t = view(spark, sf, "fx_truth").select("case_id", F.col("target").alias("entity_id")).join(rollup, ["case_id", "entity_id"], "left")
    targets = t.select("case_id", F.array(F.coalesce("service_id", "entity_id")).alias("targets"))
    seen = _system_evidence(spark, sf).join(targets.select("case_id"), "case_id", "left_semi")
    return evaluate.retrieval_pr(seen, rollup, targets)


@query(f"""WITH ix AS ({INDEX}), g AS (SELECT case_id, target FROM fx_truth)
SELECT case_id, CASE case_id WHEN 'r0' THEN target WHEN 'r1' THEN 'te:' || target ELSE (SELECT arg_min(ix.entity_id, pos) FROM ix WHERE ix.case_id = g.case_id AND key = (SELECT lower(s_name) FROM supplier WHERE 'supplier:' || s_suppkey = target)) END AS target_id FROM g""")
def gt_targets(spark, sf):
    """Given ids, ids of target entities, or resolved names, by case."""
    t = view(spark, sf, "SELECT case_id, target, s_name FROM fx_truth JOIN supplier ON 'supplier:' || s_suppkey = target")
    index = resolve.name_index(view(spark, sf, "fx_entities"))
    entity = F.struct(F.concat(F.lit("te:"), "target").alias("entity_id"), F.lit("n").alias("entity_name"))
    truth = t.select("case_id", F.when(F.col("case_id") == "r0", F.array("target")).alias("target_entity_ids"), F.when(F.col("case_id") == "r1", F.array(entity)).alias("target_entities"))
    found = resolve.resolve_entities(t.select("case_id", F.col("s_name").alias("name")), index).select("case_id", F.lit(0).alias("pos"), "entity_id")
    return evaluate.target_ids(truth, found).select("case_id", F.col("targets")[0].alias("target_id"))


@query(f"WITH {DIST} SELECT * FROM el")
def entity_localization(spark, sf):
    return _localization(spark, sf)


@query(f"WITH {FAULT} SELECT * FROM fm")
def fault_match(spark, sf):
    return _fault(spark, sf)


@query(f"WITH {CHAIN} SELECT case_id, system, round(chain_overlap, 6) AS chain_overlap FROM co")
def chain_overlap(spark, sf):
    return _chain(spark, sf).withColumn("chain_overlap", F.round("chain_overlap", 6))


@query(f"WITH {HITS} SELECT case_id, system, round(checkpoint_rate, 6) AS checkpoint_rate FROM ch")
def checkpoint_hits(spark, sf):
    truth = view(spark, sf, "fx_truth").select("case_id")
    return _hits(spark, sf).join(truth, "case_id", "left_semi").withColumn("checkpoint_rate", F.round("checkpoint_rate", 6))


@query(f"WITH {DIST}, {FAULT}, {CHAIN}, {HITS}, {FINAL} SELECT case_id, system, reasoning_process, final_score FROM fin")
def final_score(spark, sf):
    return _final(spark, sf).select("case_id", "system", "reasoning_process", "final_score")


@query(f"WITH {SYS_EV}, {PR} SELECT * FROM pr")
def retrieval_pr(spark, sf):
    return _pr(spark, sf)


EXPLAIN = "ex AS (SELECT case_id, system, round_even((least(2 / 3.0::DOUBLE, 1) + least(CASE WHEN sys = 0 THEN 1 ELSE 0 END / 2.0::DOUBLE, 1) + least(CASE WHEN sys = 0 THEN 3 ELSE 0 END / 8.0::DOUBLE, 1)) / 3, 4) AS explainability FROM fx_pred)"


def _explain(spark, sf):
    p = view(spark, sf, "fx_pred").where("sys = 0")
    agree = p.select("case_id", "system", F.lit("metrics_agent").alias("agent"), F.col("predicted").alias("entity_id"), F.array("step1", "step2").alias("supporting_evidence"))
    other = p.select("case_id", "system", F.lit("logs_agent").alias("agent"), F.lit(None).cast("string").alias("entity_id"), F.array("step1").alias("supporting_evidence"))
    return evaluate.explainability(_results(spark, sf), agree.unionByName(other))


@query(f"WITH {EXPLAIN} SELECT * FROM ex")
def explainability(spark, sf):
    return _explain(spark, sf)


REPORT = f"{DIST}, {FAULT}, {CHAIN}, {HITS}, {FINAL}, {PR.replace(ROLLUP.split(', roll AS')[0], ROLLUP.split(', roll AS')[0].replace('pairs AS', 'pairs2 AS', 1))}, {EXPLAIN}"


def _report(spark, sf):
    sf = _outcomes(spark, sf)
    stats = summarize.usage(view(spark, sf, "fx_log"))
    return evaluate.case_report(_final(spark, sf), _pr(spark, sf), _explain(spark, sf), stats)


COLUMNS = "entity_localization, fault_identification, reasoning_process, final_score"
US = "us AS (SELECT case_id, system, count(*) AS total_calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM fx_log GROUP BY case_id, system)"


@query(f"""WITH {REPORT}, {US} SELECT fin.case_id, fin.system, {COLUMNS}, coalesce(retrieval_precision, 0) AS retrieval_precision, coalesce(retrieval_recall, 0) AS retrieval_recall, explainability, total_calls, total_tokens
FROM fin LEFT JOIN pr ON pr.case_id = fin.case_id AND pr.system = fin.system LEFT JOIN ex ON ex.case_id = fin.case_id AND ex.system = fin.system LEFT JOIN us ON us.case_id = fin.case_id AND us.system = fin.system""")
def case_report(spark, sf):
    out = _report(spark, sf)
    return out.drop("chain_overlap", "checkpoint_rate")


GRID = f"""{DIST}, {FAULT}, {CHAIN}, {HITS}, {FINAL}, grid AS (SELECT c.case_id, y.system, CASE WHEN failed THEN 'failed' END AS error, CASE WHEN NOT failed THEN entity_localization END AS entity_localization, CASE WHEN NOT failed THEN fault_identification END AS fault_identification,
CASE WHEN NOT failed THEN reasoning_process END AS reasoning_process, CASE WHEN NOT failed THEN final_score END AS final_score
FROM (SELECT case_id FROM fx_truth) c CROSS JOIN (SELECT *, sys = 2 AS f FROM fx_systems) y LEFT JOIN fin ON fin.case_id = c.case_id AND fin.system = y.system, LATERAL (SELECT f AND c.case_id = 'r0' AS failed) q)"""


def _grid(spark, sf):
    sf = _outcomes(spark, sf)
    report = _final(spark, sf).where("not (system = 'direct_llm' and case_id = 'r0')").select("case_id", "system", *COLUMNS.split(", "))
    errors = view(spark, sf, "fx_truth").where("case_id = 'r0'").select("case_id", F.lit("direct_llm").alias("system"), F.lit("failed").alias("error"))
    return evaluate.system_grid(view(spark, sf, "fx_truth"), view(spark, sf, "fx_systems"), report, errors)


@query(f"WITH {GRID} SELECT * FROM grid")
def system_grid(spark, sf):
    return _grid(spark, sf)


@query(f"WITH {GRID} SELECT system, {', '.join(f'round(avg({c}), 9) AS {c}' for c in COLUMNS.split(', '))} FROM grid GROUP BY system ORDER BY system")
def leaderboard(spark, sf):
    out = evaluate.leaderboard(_grid(spark, sf))
    return out.select("system", *[F.round(c, 9).alias(c) for c in COLUMNS.split(", ")])
