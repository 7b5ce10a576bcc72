"""Queries of the systems compared: what evidence each sees, and the flagship query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, graph, hybrid, retrieve, summarize
from ..session import fresh_path, stage
from ..sources import cases
from .evidence import E_, IDENT, QUERIES_SQL, SUMMARY, hits_sql
from .graphs import ROLLUP, ppr_sql
from .registry import query
from .views import base, view, write_views

#: Rounds of the ranking in these queries, so that SQL can unroll them.
ROUNDS = 20
OBS = "case_id, modality, mod_ord, row_ord, entity_id, ts, text, source_file"

HYBRID = f"""{ppr_sql(ROUNDS)},
gs AS MATERIALIZED (SELECT case_id, entity_id, rank, score / max(score) OVER (PARTITION BY case_id) AS graph_score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 12) DESC, entity_id) AS rank FROM k{ROUNDS}) t WHERE rank <= 15),
kept AS MATERIALIZED (SELECT o.* FROM fx_rows o LEFT JOIN ins i ON i.case_id = o.case_id AND i.entity_id = o.entity_id WHERE o.entity_id IS NULL OR i.entity_id IS NOT NULL),
{QUERIES_SQL}, {hits_sql('kept', 5)},
fused AS (SELECT o.*, query_ord, h.rank, vector_score, coalesce(g.graph_score, 0) AS graph_score, 0.5::DOUBLE * coalesce(g.graph_score, 0) + 0.5::DOUBLE * vector_score AS hybrid_score
FROM hit h JOIN kept o ON o.case_id = h.case_id AND o.mod_ord = h.mod_ord AND o.row_ord = h.row_ord LEFT JOIN gs g ON g.case_id = o.case_id AND g.entity_id = o.entity_id),
first AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {IDENT} ORDER BY query_ord, hybrid_score DESC, rank) AS n FROM fused) t WHERE n = 1),
{ROLLUP.replace('pairs AS MATERIALIZED', 'pairs2 AS MATERIALIZED', 1)},
mem AS (SELECT r.case_id, coalesce(service_id, r.entity_id) AS service_id, r.entity_id AS member_id, coalesce(e.ord, 4611686018427387904) AS member_ord FROM roll r LEFT JOIN fx_entities e ON e.case_id = r.case_id AND e.entity_id = r.entity_id),
wide AS (SELECT g.case_id, g.entity_id AS service_id, graph_score, coalesce(member_id, g.entity_id) AS entity_id, coalesce(member_ord, 0) AS member_ord FROM gs g LEFT JOIN mem ON mem.case_id = g.case_id AND mem.service_id = g.entity_id WHERE rank <= 10),
direct AS MATERIALIZED (SELECT * FROM (SELECT o.*, graph_score, row_number() OVER (PARTITION BY o.case_id, service_id ORDER BY member_ord, o.entity_id, mod_ord, row_ord, text) AS rank
FROM wide w JOIN kept o ON o.case_id = w.case_id AND o.entity_id = w.entity_id WHERE o.entity_id <> '') d WHERE rank <= 6),
both_ AS (SELECT {OBS}, graph_score, vector_score, hybrid_score, rank, query_ord, 0 AS list_ord FROM first UNION ALL SELECT {OBS}, graph_score, 0, 0.5::DOUBLE * graph_score, rank, 0, 1 FROM direct),
ev AS MATERIALIZED (SELECT {OBS}, graph_score, vector_score, hybrid_score, row_number() OVER (PARTITION BY case_id ORDER BY round(hybrid_score, 9) DESC, list_ord, query_ord, mod_ord, row_ord) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY {IDENT} ORDER BY hybrid_score DESC, list_ord, rank) AS n FROM both_) t WHERE n = 1)"""
SCORES = "round(graph_score, 6) AS graph_score, round(vector_score, 6) AS vector_score, round(hybrid_score, 6) AS hybrid_score"


def _hybrid(spark, sf):
    """Evidence and counts, and the observations written for them (row_ord is still the table's own key)."""
    edges = view(spark, sf, "fx_edges").select("case_id", "src", "dst")
    obs = hybrid.told_apart(view(spark, sf, "fx_obs"))
    return *hybrid.hybrid_evidence(obs, view(spark, sf, "fx_entities"), edges, view(spark, sf, "fx_alerts"), iterations=ROUNDS), obs


def numbered(evidence, obs):
    """``evidence`` with the row_ord that the view ``fx_rows`` gives its rows.

    Only the runs of keys that hold a row of it are sorted; of those before them the counts are enough.
    """
    part = ["case_id", "mod_ord"]
    run = F.coalesce(F.expr("row_ord div 8192"), F.lit(2**63 - 1)).alias("run")
    runs = stage(evidence.select(*part, run).distinct(), "runs")
    keyed = obs.select(*part, "row_ord", "entity_id", "ts", "text", run)
    before = F.sum("n").over(Window.partitionBy(*part).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    counts = keyed.groupBy(*part, "run").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    n = F.rank().over(Window.partitionBy(*part, "run").orderBy(*hybrid.row_order()))
    rows = keyed.join(runs, [*part, "run"], "left_semi").withColumn("n", n).join(counts, [*part, "run"])
    rows = rows.select(*part, "row_ord", "entity_id", "ts", "text", (F.col("before") + F.col("n")).cast("bigint").alias("number")).distinct().alias("r")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*part, "row_ord", "entity_id", "ts", "text")]
    kept = [F.col("number").alias(c) if c == "row_ord" else F.col(f"e.{c}") for c in evidence.columns]
    return evidence.alias("e").join(rows, same).select(*kept)


def _scored(evidence):
    rounded = [F.round(c, 6).alias(c) for c in ("graph_score", "vector_score", "hybrid_score")]
    return evidence.select("case_id", "modality", "row_ord", "entity_id", "rank", *rounded)


@query(f"{HYBRID} SELECT case_id, modality, row_ord, entity_id, rank, {SCORES} FROM ev")
def hybrid_evidence(spark, sf):
    """From observations, topology and alerts to merged evidence, all cases at once."""
    evidence, _, obs = _hybrid(spark, sf)
    return _scored(numbered(evidence, obs))


@query(f"""{HYBRID}, c(name) AS (SELECT 1) SELECT s.case_id, (SELECT count(*) FROM ins i WHERE i.case_id = s.case_id) AS candidates, (SELECT count(*) FROM fx_obs o WHERE o.case_id = s.case_id) AS observations,
(SELECT count(*) FROM kept k WHERE k.case_id = s.case_id AND modality IN ('logs', 'metrics', 'events')) AS indexed, (SELECT count(*) FROM first f WHERE f.case_id = s.case_id) AS from_vector,
(SELECT count(*) FROM direct d WHERE d.case_id = s.case_id) AS from_direct, (SELECT count(*) FROM ev e WHERE e.case_id = s.case_id) AS evidence FROM fx_alerts s""")
def hybrid_stats(spark, sf):
    return _hybrid(spark, sf)[1]


@query(f"""WITH {QUERIES_SQL}, {hits_sql('fx_rows', 0)} SELECT o.case_id, o.modality, o.row_ord, o.entity_id, row_number() OVER (PARTITION BY o.case_id ORDER BY round(vector_score, 9) DESC, o.mod_ord, o.row_ord) AS rank,
0.0::DOUBLE AS graph_score, round(vector_score, 6) AS vector_score, round(vector_score, 6) AS hybrid_score FROM hit h JOIN fx_rows o ON o.case_id = h.case_id AND o.mod_ord = h.mod_ord AND o.row_ord = h.row_ord""")
def standard_rag_evidence(spark, sf):
    return _scored(hybrid.text_evidence(view(spark, sf, "fx_rows"), view(spark, sf, "fx_alerts")))


@query("""SELECT case_id, modality, row_ord, entity_id, row_number() OVER (PARTITION BY case_id ORDER BY mod_ord, n) AS rank, 0.0::DOUBLE AS graph_score, 0.0::DOUBLE AS vector_score, 0.0::DOUBLE AS hybrid_score
FROM (SELECT *, row_number() OVER (PARTITION BY case_id, modality ORDER BY (coalesce(entity_id, '') = '')::INTEGER, row_ord, entity_id NULLS FIRST, text) AS n FROM fx_obs) t WHERE n <= 40""")
def multi_agent_evidence(spark, sf):
    return _scored(hybrid.sampled_evidence(view(spark, sf, "fx_obs")))


@query(f"""{HYBRID}, b AS (SELECT case_id, {E_} AS entity_id, max(hybrid_score) AS best, count(*) AS items, min(rank) AS first FROM ev GROUP BY case_id, {E_})
SELECT case_id, entity_rank, entity_id, items, round(best, 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY best DESC, first, entity_id) AS entity_rank FROM b) r WHERE entity_rank <= 8""")
def top_entities(spark, sf):
    """Flagship: for each case the eight entities with the best evidence, from raw observations on."""
    buckets = summarize.entity_buckets(_hybrid(spark, sf)[0])
    return buckets.select("case_id", "entity_rank", "entity_id", "items", F.round("best", 6).alias("best"))


@query("""WITH e AS (SELECT case_id, src, dst FROM fx_edges), n AS (SELECT case_id, count(*) AS size FROM (SELECT case_id, entity_id FROM fx_entities UNION SELECT case_id, src FROM e UNION SELECT case_id, dst FROM e) x GROUP BY case_id)
SELECT case_id, size AS candidates FROM n""")
def rank_without_seed(spark, sf):
    """Alerts without an entry, or with a foreign one, count the whole topology of their case."""
    e, x = view(spark, sf, "fx_entities"), stage(view(spark, sf, "fx_edges").select("case_id", "src", "dst"), "edges")
    entry = F.when(F.col("case_id") < "r3", "gone")
    seeds = view(spark, sf, "fx_seed").select("case_id", entry.alias("entity_id"))
    inside, scores = graph.ranked_entities(graph.nodes_of(e, x), x, seeds, iterations=5)
    named = scores.select("case_id").distinct()
    return inside.join(named, "case_id", "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("candidates"))


ASK = summarize.ASK.replace("'", "''")
FINAL_ASK = summarize.FINAL_ASK.replace("'", "''")


def agents_sql(known: bool) -> str:
    """Bodies of the agents' requests, from the summary ``su``: every alert has one for each agent."""
    ids = "(SELECT to_json(list(entity_id ORDER BY rank)) FROM fx_scores c WHERE c.case_id = a.case_id)" if known else "NULL"
    ends = [f"(SELECT to_json(list(DISTINCT {x} ORDER BY {x})) FROM fx_edges e WHERE e.case_id = a.case_id AND {y} = a.entry_entity_id)" if known else "NULL" for x, y in (("src", "dst"), ("dst", "src"))]
    return f"""ag AS (SELECT 'metrics_agent' AS agent, 'metric' AS word UNION ALL SELECT 'logs_agent', 'log' UNION ALL SELECT 'trace_agent', 'span'),
hw AS (SELECT s.*, agent, contains(lower(bullet), word) AS hit FROM su s CROSS JOIN ag), hx AS (SELECT *, bool_or(hit) OVER (PARTITION BY case_id, agent) AS any_hit FROM hw),
ln AS (SELECT case_id, agent, entity_rank, entity_id || E'\\n' || string_agg('  • ' || bullet, E'\\n' ORDER BY n) AS line FROM hx WHERE hit OR NOT any_hit GROUP BY case_id, agent, entity_rank, entity_id),
tx AS (SELECT case_id, agent, string_agg(line, E'\\n' ORDER BY entity_rank) AS body FROM ln GROUP BY case_id, agent),
bo AS (SELECT a.case_id, a.agent, alert_text, 'Evidence:' || E'\\n' || coalesce(body, '') AS body FROM (SELECT case_id, alert_text, agent FROM fx_requests CROSS JOIN ag) a LEFT JOIN tx ON tx.case_id = a.case_id AND tx.agent = a.agent
UNION ALL SELECT a.case_id, 'topology_agent', alert_text, 'Upstream: ' || coalesce({ends[0]}, '[]') || E'\\nDownstream: ' || coalesce({ends[1]}, '[]') || E'\\nCandidates: ' || coalesce({ids}, '[]') FROM fx_requests a)"""


@query(f"""WITH {SUMMARY}, {agents_sql(True)} SELECT case_id, 'proposed_hybrid' AS system, agent, 'Alert: ' || alert_text || E'\\n\\n' || body || E'\\n\\n' || '{ASK}' AS prompt FROM bo""")
def prompt_table(spark, sf):
    """The agents' requests of every alert, of one without evidence, neighbours and candidates too."""
    near = graph.neighbours(view(spark, sf, "fx_edges"), view(spark, sf, "fx_seed"))
    return summarize.prompt_table(summarize.summary(view(spark, sf, "fx_evidence")), view(spark, sf, "fx_requests"), near, view(spark, sf, "fx_scores"))


SAMPLED = """sm AS (SELECT * EXCLUDE (n), 0.0::DOUBLE AS hybrid_score, row_number() OVER (PARTITION BY case_id ORDER BY mod_ord, n) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY case_id, modality ORDER BY (coalesce(entity_id, '') = '')::INTEGER, row_ord, entity_id NULLS FIRST, text) AS n FROM fx_obs) t WHERE n <= 40)"""


@query(f"""WITH {SAMPLED}, {SUMMARY.replace('fx_evidence', 'sm')}, {agents_sql(False)} SELECT case_id, 'multi_agent_only' AS system, agent, 'Alert: ' || alert_text || E'\\n\\n' || body || E'\\n\\n' || '{ASK}' AS prompt FROM bo""")
def multi_agent_prompts(spark, sf):
    """The agents' requests of the system without retrieval: sampled evidence, no topology."""
    sampled = hybrid.sampled_evidence(view(spark, sf, "fx_obs"))
    return summarize.prompt_table(summarize.summary(sampled), view(spark, sf, "fx_requests"), system="multi_agent_only")


FAULTS = "SELECT o_orderpriority AS slug, CASE WHEN o_orderpriority NOT LIKE '3%' THEN 'orders of priority ' || o_orderpriority || ' late by error' END AS definition FROM orders GROUP BY o_orderpriority"
FLAT = "fl AS (SELECT case_id, string_agg(entity_id || ': ' || line, E'\\n' ORDER BY entity_rank) AS text FROM (SELECT case_id, entity_rank, entity_id, string_agg(bullet, '; ' ORDER BY n) AS line FROM su GROUP BY case_id, entity_rank, entity_id) l GROUP BY case_id)"
LINES = "fl AS (SELECT case_id, string_agg(line, E'\\n' ORDER BY entity_rank) AS text FROM (SELECT case_id, entity_rank, entity_id || E'\\n' || string_agg('  • ' || bullet, E'\\n' ORDER BY n) AS line FROM su GROUP BY case_id, entity_rank, entity_id) l GROUP BY case_id)"


def short_sql(text: str) -> str:
    """CTEs up to ``th``: the hints of each request, by the five types nearest to ``fl``, all where there is no text."""
    return rf"""{text},
fv AS (SELECT case_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY case_id)) AS w FROM (SELECT case_id, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT case_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM fl) x WHERE term <> '' GROUP BY case_id, term) y),
fd AS MATERIALIZED ({FAULTS}),
dv AS (SELECT slug, term, n / sqrt(sum(n * n) OVER (PARTITION BY slug)) AS w FROM (SELECT slug, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT slug, unnest(string_split_regex(lower(concat_ws(': ', slug, definition)), '[^a-z]+')) AS term FROM fd) x WHERE term <> '' GROUP BY slug, term) y),
ds AS (SELECT case_id, slug, sum(fv.w * dv.w) AS s FROM fv JOIN dv ON dv.term = fv.term GROUP BY case_id, slug),
sl AS (SELECT * FROM (SELECT fl.case_id, fd.slug, definition, coalesce(s, 0) AS similarity, CAST(row_number() OVER (PARTITION BY fl.case_id ORDER BY round(coalesce(s, 0), 9) DESC, fd.slug) AS INTEGER) AS rank
FROM fl CROSS JOIN fd LEFT JOIN ds ON ds.case_id = fl.case_id AND ds.slug = fd.slug WHERE regexp_matches(text, '\S')) r WHERE rank <= 5),
st AS (SELECT case_id, E'Likely fault types:\n' || string_agg('- ' || slug || format(' (similarity {{:.3f}})', round(similarity, 3)) || coalesce(': ' || definition, ''), E'\n' ORDER BY rank) AS types FROM sl GROUP BY case_id),
al AS (SELECT E'Fault types:\n' || string_agg('- ' || slug || coalesce(': ' || definition, ''), E'\n' ORDER BY slug) AS types FROM fd),
th AS (SELECT a.case_id, a.entry_entity_id, a.alert_text, al.types AS every, coalesce(st.types, al.types) AS types FROM fx_requests a CROSS JOIN al LEFT JOIN st ON st.case_id = a.case_id)"""


def _definitions(spark, sf):
    base(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(FAULTS)


def _shortlist(spark, sf, types):
    flat = stage(summarize.flat_text(summarize.summary(view(spark, sf, "fx_evidence"))).withColumnRenamed("summary_text", "text"), "texts")
    return retrieve.shortlist(flat, types, 5)


@query(f"WITH {SUMMARY}, {short_sql(FLAT)} SELECT case_id, slug, rank, round(similarity, 6) AS similarity FROM sl")
def summary_shortlist(spark, sf):
    """The five fault types nearest to each case's flat summary, also such without a common word."""
    types = stage(_definitions(spark, sf), "definitions")
    return _shortlist(spark, sf, types).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {SUMMARY}, {short_sql(FLAT)},
fi AS (SELECT case_id, '{{"logs_agent":{{"summary":"","supporting_evidence":[],"confidence":0.0}},"metrics_agent":{{"entity_id":"' || predicted || '","summary":"s","supporting_evidence":["' || step1 || '"],"confidence":0.5}}}}' AS said FROM fx_pred WHERE sys = 0)
SELECT a.case_id, 'proposed_hybrid' AS system, 'coordinator' AS agent, 'Alert: ' || alert_text || E'\\n\\nFindings:\\n' || coalesce(said, '{{}}') || E'\\n\\n' || types || E'\\n\\n' || '{FINAL_ASK}' AS prompt
FROM th a LEFT JOIN fi ON fi.case_id = a.case_id""")
def coordinator_prompts(spark, sf):
    sf = write_views(spark, sf, "fx_requests")
    types = stage(_definitions(spark, sf), "definitions")
    p = stage(view(spark, sf, "fx_pred").where("sys = 0"), "predicted")  # a row a case, read for each agent
    none = F.array().cast("array<string>")
    good = p.select("case_id", F.lit("metrics_agent").alias("agent"), F.col("predicted").alias("entity_id"), F.lit("s").alias("summary"), F.array("step1").alias("supporting_evidence"), F.lit(0.5).alias("confidence"))
    other = p.select("case_id", F.lit("logs_agent").alias("agent"), F.lit(None).cast("string").alias("entity_id"), F.lit("").alias("summary"), none.alias("supporting_evidence"), F.lit(0.0).alias("confidence"))
    return summarize.coordinator_prompts(view(spark, sf, "fx_requests"), good.unionByName(other), _shortlist(spark, sf, types), types)


@query(f"""WITH {SUMMARY}, {short_sql(LINES)},
cd AS (SELECT case_id, string_agg(rank || '. ' || entity_id || format(' ({{:.3f}})', round(graph_score, 3)), E'\\n' ORDER BY rank) AS ids FROM fx_scores GROUP BY case_id)
SELECT a.case_id, 'standard_rag' AS system, 'single' AS agent, 'Alert: ' || alert_text || E'\\n\\nEvidence:\\n' || coalesce(fl.text, '') || E'\\n\\n' || types || E'\\n\\n' || '{FINAL_ASK}' AS prompt FROM th a LEFT JOIN fl ON fl.case_id = a.case_id
UNION ALL SELECT a.case_id, 'graphrag_only', 'single', 'Alert: ' || alert_text || E'\\n\\nEntry: ' || coalesce(entry_entity_id, 'none') || E'\\nCandidates:\\n' || coalesce(ids, '') || E'\\n\\n' || every || E'\\n\\n' || '{FINAL_ASK}' FROM th a LEFT JOIN cd ON cd.case_id = a.case_id
UNION ALL SELECT case_id, 'direct_llm', 'single', 'Alert: ' || alert_text || E'\\n\\n' || every || E'\\n\\n' || '{FINAL_ASK}' FROM th""")
def baseline_prompts(spark, sf):
    """One request of every alert for each system of one call; the text's own shortlist goes with it."""
    sf = write_views(spark, sf, "fx_requests")  # a row a case, read for each system
    types = stage(_definitions(spark, sf), "definitions")
    text = stage(summarize.summary_text(summarize.summary(view(spark, sf, "fx_evidence"))), "texts")
    short = retrieve.shortlist(text.withColumnRenamed("summary_text", "text"), types, 5)
    return summarize.baseline_prompts(view(spark, sf, "fx_requests"), text, short, view(spark, sf, "fx_scores"), types)


@query("SELECT case_id, CASE WHEN case_id < 'r2' THEN target ELSE s_name END AS target FROM fx_truth JOIN supplier ON 'supplier:' || s_suppkey = target")
def gt_target_names(spark, sf):
    """Targets whose ids aren't known are compared by name."""
    t = view(spark, sf, "SELECT t.case_id, target, s_name FROM fx_truth t JOIN supplier ON 'supplier:' || s_suppkey = target")
    entity = F.struct(F.lit("").alias("entity_id"), F.col("s_name").alias("entity_name"))
    truth = t.select("case_id", F.when(F.col("case_id") < "r2", F.array("target")).alias("target_entity_ids"), F.array(entity).alias("target_entities"))
    nothing = t.select("case_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("entity_id"))
    return evaluate.target_ids(truth, nothing).select("case_id", F.col("targets")[0].alias("target"))


@query("""SELECT case_id, "key", n FROM (SELECT 'r' || n_regionkey AS case_id, 'entities' AS "key", CAST(count(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey
UNION ALL SELECT 'r' || n_regionkey, 'edges', CAST(count(*) FILTER (WHERE n_nationkey % 2 = 0) AS INTEGER) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'r' || n_regionkey, 'version', NULL FROM nation GROUP BY n_regionkey) x""")
def profile_topology(spark, sf):
    """Top-level keys of topology documents and the lengths of their lists."""
    n = base(spark, sf, "nation")
    item = F.struct(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    lists = n.groupBy("n_regionkey").agg(F.collect_list(item).alias("entities"), F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, item)).alias("edges"))
    raw = lists.select(F.concat(F.lit("r"), "n_regionkey").alias("case_id"), F.to_json(F.struct("entities", "edges", F.lit("1.0").alias("version"))).alias("value"))
    return cases.profile_topology(raw).select("case_id", "key", "n")


@query("SELECT r_regionkey AS ord, to_json({'r_regionkey': r_regionkey, 'r_name': r_name}) AS first_row FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)")
def profile_first_row(spark, sf):
    r = base(spark, sf, "region").select("r_regionkey", "r_name")
    return cases.first_row(r, "r_regionkey").select(F.get_json_object("first_row", "$.r_regionkey").cast("int").alias("ord"), "first_row")


@query("SELECT system, count(*) AS n, count(*) AS n_csv FROM fx_pred GROUP BY system")
def results_roundtrip(spark, sf):
    """Results written as CSV and as Parquet by system are read back, both."""
    path = fresh_path(spark, "results")
    cases.write_results(view(spark, sf, "fx_pred"), path)
    n = lambda df, name: df.groupBy("system").agg(F.count(F.lit(1)).alias(name))
    return n(spark.read.parquet(f"{path}/parquet"), "n").join(n(spark.read.option("header", True).csv(f"{path}/csv"), "n_csv"), "system")
