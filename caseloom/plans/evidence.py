"""Queries of retrieval and summarisation (E, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, hybrid, retrieve, summarize
from ..session import stage
from .graphs import INSIDE, ROLLUP
from .registry import query
from .views import base, view, write_views

IDENT = "case_id, source_file, entity_id, ts, text"
WORDS = "SELECT doc_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) t WHERE term <> '' GROUP BY doc_id, term) c"
E_ = "coalesce(nullif(entity_id, ''), 'unresolved')"
ERR = r"regexp_matches(text, '(?i)(error|exception|fail|timeout|5\d\d)')"


def _inside(spark, sf):
    e, x, s = (view(spark, sf, v) for v in ("fx_entities", "fx_edges", "fx_seed"))
    return graph.candidate_nodes(graph.nodes_of(e, x), x, s)


@query(f"WITH {INSIDE}, f AS (SELECT o.*, CASE WHEN o.entity_id IS NULL THEN row_number() OVER (PARTITION BY o.case_id, modality, o.entity_id IS NULL ORDER BY row_ord, text) END AS n, i.entity_id IS NOT NULL AS inside FROM fx_obs o LEFT JOIN ins i ON i.case_id = o.case_id AND i.entity_id = o.entity_id) SELECT case_id, modality, row_ord, entity_id FROM f WHERE inside OR n <= 300")
def topology_filter(spark, sf):
    out = retrieve.topology_filter(view(spark, sf, "fx_obs"), _inside(spark, sf), unresolved_cap=300)
    return out.select("case_id", "modality", "row_ord", "entity_id")


@query("SELECT doc_id, count(*) AS terms, round(max(weight), 6) AS top_weight, round(sum(weight * weight), 6) AS norm FROM (" + WORDS + ") w GROUP BY doc_id")
def tf_norms(spark, sf):
    w = retrieve.term_weights(base(spark, sf, "documents"), ["doc_id"])
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"))


@query("""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, v.vec_id, sum(CAST(v.x AS DOUBLE) * q.x) / sqrt(sum(CAST(v.x AS DOUBLE) * v.x)) / sqrt(sum(CAST(q.x AS DOUBLE) * q.x)) AS score
FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) v
JOIN (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 20 = 0) q ON q.i = v.i GROUP BY q.vec_id, v.vec_id) s) t WHERE rank <= 20""")
def cosine_topk(spark, sf):
    emb = base(spark, sf, "embeddings")
    q = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieve.cosine_topk(q, emb).withColumn("score", F.round("score", 6))


TOPK = f"""WITH w AS MATERIALIZED ({WORDS}), q AS (SELECT doc_id AS query_id, term, weight FROM w WHERE doc_id % 20 = 0),
d AS MATERIALIZED (SELECT query_id, w.doc_id, sum(q.weight * w.weight) AS s FROM q JOIN w ON w.term = q.term GROUP BY query_id, w.doc_id),
z AS (SELECT a.doc_id AS query_id, b.doc_id, 0 AS s FROM documents a CROSS JOIN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20) b WHERE a.doc_id % 20 = 0 AND NOT EXISTS (SELECT 1 FROM d WHERE d.query_id = a.doc_id AND d.doc_id = b.doc_id))
SELECT query_id, doc_id, round(s, 6) AS vector_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM (SELECT * FROM d UNION ALL SELECT * FROM z) x) r WHERE rank <= 20"""


@query(TOPK)
def text_topk(spark, sf):
    """Every document whose id is divisible by 20 against all; 20 hits each, also without a common word."""
    docs = base(spark, sf, "documents")
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    (first_asked, other_asked), (first, other) = (retrieve.first_texts(df, key) for df, key in ((asked, "query_id"), (docs, "doc_id")))
    q, w = (retrieve.term_weights(df, [key], listed=True) for df, key in ((first_asked, "query_id"), (first, "doc_id")))
    top = retrieve.text_topk(q, w, ["query_id"], ["doc_id"], [], asked=asked, rows=docs, copies=(other_asked, other))
    return top.withColumn("vector_score", F.round("vector_score", 6))


@query("SELECT case_id, modality, count(*) AS n FROM fx_obs WHERE modality IN ('logs', 'metrics', 'events') GROUP BY case_id, modality")
def corpus_select(spark, sf):
    return retrieve.corpus(view(spark, sf, "fx_obs")).groupBy("case_id", "modality").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT case_id, modality, row_ord, entity_id, text FROM (SELECT *, row_number() OVER (PARTITION BY case_id, modality ORDER BY row_ord, entity_id NULLS FIRST, text) AS n FROM fx_obs) t WHERE n <= 1500")
def modality_head(spark, sf):
    return retrieve.head_per_modality(view(spark, sf, "fx_obs"), 1500).select("case_id", "modality", "row_ord", "entity_id", "text")


KEY = "case_id, mod_ord, row_ord"
QUERIES_SQL = r"""kw AS (SELECT case_id, word, min(pos) AS pos FROM (SELECT case_id, trim(w, '.,:;') AS word, pos FROM (SELECT case_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
FROM (SELECT case_id, string_split_regex(trim(alert_text), '\s+') AS ws FROM fx_alerts) a) b WHERE length(w) > 3) c GROUP BY case_id, word),
qs AS MATERIALIZED (SELECT case_id, 0 AS query_ord, alert_text AS text FROM fx_alerts UNION ALL SELECT case_id, n, word FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS n FROM kw) k WHERE n <= 5),
qv AS MATERIALIZED (SELECT case_id, query_ord, term, n / sqrt(sum(n * n) OVER (PARTITION BY case_id, query_ord)) AS w FROM (SELECT case_id, query_ord, term, CAST(count(*) AS DOUBLE) AS n
FROM (SELECT case_id, query_ord, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM qs) x WHERE term <> '' GROUP BY case_id, query_ord, term) y)"""


def hits_sql(source: str, most: int) -> str:
    """CTEs up to ``hit``: the 20 nearest rows of ``source`` for the queries up to ``most``, filled with rows of score 0."""
    return f"""ix AS MATERIALIZED (SELECT * FROM {source} WHERE modality IN ('logs', 'metrics', 'events')),
vec AS MATERIALIZED (SELECT {KEY}, term, n / sqrt(sum(n * n) OVER (PARTITION BY {KEY})) AS weight FROM (SELECT {KEY}, term, CAST(count(*) AS DOUBLE) AS n
FROM (SELECT {KEY}, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM ix) x WHERE term <> '' GROUP BY {KEY}, term) y),
dot AS MATERIALIZED (SELECT v.case_id, query_ord, v.mod_ord, v.row_ord, sum(w * weight) AS vector_score FROM qv q JOIN vec v ON v.case_id = q.case_id AND v.term = q.term WHERE query_ord <= {most} GROUP BY ALL),
zero AS (SELECT f.case_id, query_ord, f.mod_ord, f.row_ord, 0 AS vector_score FROM (SELECT {KEY}, row_number() OVER (PARTITION BY case_id ORDER BY mod_ord, row_ord) AS n FROM ix) f JOIN qs ON qs.case_id = f.case_id AND query_ord <= {most}
WHERE n <= 20 AND NOT EXISTS (SELECT 1 FROM dot d WHERE d.case_id = f.case_id AND d.query_ord = qs.query_ord AND d.mod_ord = f.mod_ord AND d.row_ord = f.row_ord)),
hit AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, query_ord ORDER BY round(vector_score, 9) DESC, mod_ord, row_ord) AS rank FROM (SELECT * FROM dot UNION ALL SELECT * FROM zero) s) r WHERE rank <= 20)"""


HITS = f"{QUERIES_SQL}, {hits_sql('fx_rows', 5)}, hits AS MATERIALIZED (SELECT o.*, query_ord, h.rank, vector_score FROM hit h JOIN fx_rows o ON o.case_id = h.case_id AND o.mod_ord = h.mod_ord AND o.row_ord = h.row_ord)"
FUSED = "SELECT h.*, coalesce(graph_score, 0) AS g, 0.5::DOUBLE * coalesce(graph_score, 0) + 0.5::DOUBLE * vector_score AS hybrid_score FROM hits h LEFT JOIN fx_scores s ON s.case_id = h.case_id AND s.entity_id = h.entity_id"


def _hits(spark, sf):
    """What the alerts' texts and keywords find among all observations of their case."""
    return hybrid.search(stage(view(spark, sf, "fx_rows"), "obs"), hybrid.alert_queries(view(spark, sf, "fx_alerts")))


def _fused(spark, sf):
    return retrieve.fuse(_hits(spark, sf), view(spark, sf, "fx_scores"))


@query(f"WITH {HITS} SELECT case_id, modality, row_ord, query_ord, round(hybrid_score, 6) AS hybrid_score FROM ({FUSED}) f")
def hybrid_fuse(spark, sf):
    return _fused(spark, sf).select("case_id", "modality", "row_ord", "query_ord", F.round("hybrid_score", 6).alias("hybrid_score"))


@query(f"WITH {HITS} SELECT case_id, modality, text, entity_id, ts, query_ord, round(hybrid_score, 6) AS hybrid_score FROM (SELECT *, row_number() OVER (PARTITION BY {IDENT} ORDER BY query_ord, hybrid_score DESC, rank) AS n FROM ({FUSED}) f) t WHERE n = 1")
def multi_query_merge(spark, sf):
    return retrieve.first_query_wins(_fused(spark, sf)).select("case_id", "modality", "text", "entity_id", "ts", "query_ord", F.round("hybrid_score", 6).alias("hybrid_score"))


DIRECT = f"""{ROLLUP}, mem AS (SELECT r.case_id, coalesce(service_id, r.entity_id) AS service_id, r.entity_id AS member_id, coalesce(e.ord, 4611686018427387904) AS member_ord FROM roll r LEFT JOIN fx_entities e ON e.case_id = r.case_id AND e.entity_id = r.entity_id),
wide AS (SELECT g.case_id, g.entity_id AS service_id, graph_score, coalesce(member_id, g.entity_id) AS entity_id, coalesce(member_ord, 0) AS member_ord FROM fx_scores g LEFT JOIN mem ON mem.case_id = g.case_id AND mem.service_id = g.entity_id WHERE rank <= 10),
direct AS (SELECT * FROM (SELECT o.*, service_id, graph_score, 0.5 * graph_score AS hybrid_score, row_number() OVER (PARTITION BY o.case_id, service_id ORDER BY member_ord, o.entity_id, mod_ord, row_ord, text) AS rank
FROM wide w JOIN fx_obs o ON o.case_id = w.case_id AND o.entity_id = w.entity_id WHERE o.entity_id <> '') d WHERE rank <= 6)"""


def _direct(spark, sf):
    sf = write_views(spark, sf, "fx_calls")  # edges and scores are read several times
    e, x = view(spark, sf, "fx_entities"), view(spark, sf, "fx_edges")
    members = graph.membership(e, graph.service_rollup(e, x))
    return retrieve.graph_direct(view(spark, sf, "fx_obs"), view(spark, sf, "fx_scores"), members)


@query(f"WITH {DIRECT} SELECT case_id, service_id, modality, entity_id, row_ord, rank, round(hybrid_score, 6) AS hybrid_score FROM direct")
def direct_evidence(spark, sf):
    return _direct(spark, sf).select("case_id", "service_id", "modality", "entity_id", "row_ord", "rank", F.round("hybrid_score", 6).alias("hybrid_score"))


MERGED = f"""{HITS}, {DIRECT}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {IDENT} ORDER BY query_ord, hybrid_score DESC, rank) AS n FROM ({FUSED}) f) t WHERE n = 1),
both_ AS (SELECT {IDENT}, modality, hybrid_score, rank, 0 AS list_ord FROM first UNION ALL SELECT {IDENT}, modality, hybrid_score, rank, 1 FROM direct),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {IDENT} ORDER BY hybrid_score DESC, list_ord, rank) AS n FROM both_) t WHERE n = 1)"""


def _lists(spark, sf):
    cols = ["case_id", "source_file", "entity_id", "ts", "text", "modality", "hybrid_score", "rank"]
    first = retrieve.first_query_wins(_fused(spark, sf)).select(*cols, F.lit(0).alias("list_ord"))
    return first, _direct(spark, sf).select(*cols, F.lit(1).alias("list_ord"))


@query(f"WITH {MERGED} SELECT case_id, modality, entity_id, ts, text, list_ord, round(hybrid_score, 6) AS hybrid_score FROM merged")
def evidence_merge(spark, sf):
    first, direct = _lists(spark, sf)
    return retrieve.merge(first.unionByName(direct)).select("case_id", "modality", "entity_id", "ts", "text", "list_ord", F.round("hybrid_score", 6).alias("hybrid_score"))


@query("SELECT case_id, modality, row_ord, entity_id, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id, modality ORDER BY (coalesce(entity_id, '') = '')::INTEGER, row_ord, entity_id NULLS FIRST, text) AS rank FROM fx_obs) t WHERE rank <= 40")
def balanced_sample(spark, sf):
    return retrieve.balanced_sample(view(spark, sf, "fx_obs")).select("case_id", "modality", "row_ord", "entity_id", "text", "rank")


@query(f"""WITH {MERGED} SELECT o.case_id, observations, from_vector, from_direct, evidence FROM (SELECT case_id, count(*) AS observations FROM fx_obs GROUP BY case_id) o
LEFT JOIN (SELECT case_id, count(*) AS from_vector FROM first GROUP BY case_id) v ON v.case_id = o.case_id LEFT JOIN (SELECT case_id, count(*) AS from_direct FROM direct GROUP BY case_id) d ON d.case_id = o.case_id
LEFT JOIN (SELECT case_id, count(*) AS evidence FROM merged GROUP BY case_id) m ON m.case_id = o.case_id""")
def retrieval_stats(spark, sf):
    first, direct = (stage(df, "list") for df in _lists(spark, sf))  # both are counted and merged
    n = lambda df, name: df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    out = n(view(spark, sf, "fx_obs"), "observations")
    for df, name in ((first, "from_vector"), (direct, "from_direct"), (retrieve.merge(first.unionByName(direct)), "evidence")):
        out = out.join(n(df, name), "case_id", "left")
    return out


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT label AS fault, i, avg(x) AS x FROM v GROUP BY label, i)
SELECT vec_id, fault, rank FROM (SELECT vec_id, fault, row_number() OVER (PARTITION BY vec_id ORDER BY round(sum(v.x * p.x) / sqrt(sum(v.x * v.x)) / sqrt(sum(p.x * p.x)), 9) DESC, fault) AS rank FROM v JOIN p ON p.i = v.i GROUP BY vec_id, fault) t WHERE rank <= 5""")
def fault_shortlist(spark, sf):
    """The five nearest of the mean vectors of the labels, which stand for fault types."""
    emb = base(spark, sf, "embeddings")
    x = emb.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    proto = x.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    top = retrieve.cosine_topk(q, proto.withColumnRenamed("label", "vec_id"), 5)
    return top.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("fault"), "rank")


@query(f"WITH {HITS} SELECT alpha, beta, h.case_id, count(*) AS n, round(sum(alpha * coalesce(graph_score, 0) + beta * vector_score), 4) AS total FROM hits h LEFT JOIN fx_scores s ON s.case_id = h.case_id AND s.entity_id = h.entity_id CROSS JOIN (SELECT 0.0::DOUBLE AS alpha, 1.0::DOUBLE AS beta UNION ALL SELECT 0.5, 0.5 UNION ALL SELECT 1.0, 0.0) w GROUP BY alpha, beta, h.case_id")
def alpha_sweep(spark, sf):
    weights = spark.createDataFrame([(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)], "alpha double, beta double")
    out = retrieve.alpha_sweep(_hits(spark, sf), view(spark, sf, "fx_scores"), weights)
    return out.groupBy("alpha", "beta", "case_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("hybrid_score"), 4).alias("total"))


BUCKETS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY best DESC, first, entity_id) AS entity_rank FROM (SELECT case_id, {E_} AS entity_id, max(hybrid_score) AS best, count(*) AS items, min(rank) AS first FROM fx_evidence GROUP BY case_id, {E_}) b) r WHERE entity_rank <= 8"
LOGB = f"SELECT case_id, {E_} AS entity_id, 0 AS kind, 1 AS place, 'Error/exception patterns in ' || count(*) FILTER (WHERE {ERR}) || '/' || count(*) || ' retrieved log lines' AS bullet FROM fx_evidence WHERE modality = 'logs' GROUP BY case_id, {E_} HAVING count(*) FILTER (WHERE {ERR}) > 0"
METB = f"SELECT case_id, entity_id, 1 AS kind, n AS place, 'Metric observed: ' || reading AS bullet FROM (SELECT *, row_number() OVER (PARTITION BY case_id, entity_id ORDER BY rank, reading) AS n FROM (SELECT case_id, {E_} AS entity_id, trim(substring(text, strpos(text, ']') + 1)) AS reading, min(rank) AS rank FROM fx_evidence WHERE modality = 'metrics' GROUP BY ALL) a) b WHERE n <= 4"
TRAB = f"SELECT case_id, {E_} AS entity_id, 2 AS kind, 1 AS place, count(*) FILTER (WHERE {ERR}) || ' span(s) with error/timeout status among retrieved traces' AS bullet FROM fx_evidence WHERE modality = 'traces' GROUP BY case_id, {E_} HAVING count(*) FILTER (WHERE {ERR}) > 0"
EVAB = f"SELECT case_id, entity_id, CASE modality WHEN 'events' THEN 3 ELSE 4 END AS kind, n AS place, CASE modality WHEN 'events' THEN replace(text, '[event] ', 'Lifecycle event: ') ELSE replace(text, '[alert:', 'Alert stage [') END AS bullet FROM (SELECT case_id, {E_} AS entity_id, modality, text, row_number() OVER (PARTITION BY case_id, {E_}, modality ORDER BY rank, text) AS n FROM fx_evidence WHERE modality IN ('events', 'alerts')) x WHERE n <= CASE modality WHEN 'events' THEN 3 ELSE 2 END"
SUMMARY = f"""bul AS MATERIALIZED ({LOGB} UNION ALL {METB} UNION ALL {TRAB} UNION ALL {EVAB}), bk AS MATERIALIZED ({BUCKETS}),
nb AS (SELECT b.case_id, b.entity_rank, b.entity_id, coalesce(bullet, 'No strong signal in retrieved evidence for this entity') AS bullet, row_number() OVER (PARTITION BY b.case_id, b.entity_id ORDER BY kind, place) AS n FROM bk b LEFT JOIN bul ON bul.case_id = b.case_id AND bul.entity_id = b.entity_id),
su AS MATERIALIZED (SELECT * FROM nb WHERE n <= 5)"""


def _evidence(spark, sf):
    return view(spark, sf, "fx_evidence")


def _summary(spark, sf):
    return summarize.summary(_evidence(spark, sf))


@query(f"SELECT case_id, entity_id, entity_rank, items, round(best, 6) AS best FROM ({BUCKETS}) b")
def entity_buckets(spark, sf):
    return summarize.entity_buckets(_evidence(spark, sf)).withColumn("best", F.round("best", 6)).select("case_id", "entity_id", "entity_rank", "items", "best")


@query(LOGB)
def log_bullets(spark, sf):
    return summarize.log_bullets(_evidence(spark, sf))


@query(METB)
def metric_bullets(spark, sf):
    return summarize.metric_bullets(_evidence(spark, sf))


@query(TRAB)
def trace_bullets(spark, sf):
    return summarize.trace_bullets(_evidence(spark, sf))


@query(EVAB)
def event_alert_bullets(spark, sf):
    return summarize.event_alert_bullets(_evidence(spark, sf))


@query(f"WITH {SUMMARY} SELECT case_id, entity_rank, entity_id, string_agg(bullet, '|' ORDER BY n) AS bullets FROM su GROUP BY case_id, entity_rank, entity_id")
def evidence_summary(spark, sf):
    return _summary(spark, sf).withColumn("bullets", F.concat_ws("|", "bullets"))


@query(f"WITH {SUMMARY}, li AS (SELECT s.case_id, entity_rank, coalesce(e.name, s.entity_id) || E'\\n' || string_agg('  • ' || bullet, E'\\n' ORDER BY n) AS line FROM su s LEFT JOIN fx_entities e ON e.case_id = s.case_id AND e.entity_id = s.entity_id GROUP BY s.case_id, entity_rank, s.entity_id, e.name) SELECT case_id, string_agg(line, E'\\n' ORDER BY entity_rank) AS summary_text FROM li GROUP BY case_id")
def summary_text(spark, sf):
    return summarize.summary_text(_summary(spark, sf), view(spark, sf, "fx_entities"))


@query(f"WITH {SUMMARY}, m AS (SELECT *, contains(lower(bullet), 'metric') AS hit FROM su), a AS (SELECT *, bool_or(hit) OVER (PARTITION BY case_id) AS any_hit FROM m) SELECT case_id, entity_rank, entity_id, string_agg(bullet, '|' ORDER BY n) AS bullets FROM a WHERE hit OR NOT any_hit GROUP BY case_id, entity_rank, entity_id")
def modality_view(spark, sf):
    return summarize.modality_view(_summary(spark, sf), "metric").withColumn("bullets", F.concat_ws("|", "bullets"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k') END AS k, event_id % 3 = 2 AS parse_error FROM events")
def response_parse(spark, sf):
    out = summarize.parse_response(view(spark, sf, "fx_json"))
    return out.select("event_id", F.get_json_object("parsed", "$.k").alias("k"), "parse_error")


def _responses(spark, sf):
    """Answers of two agents per case; one of the second agent's can't be parsed."""
    p = view(spark, sf, "fx_pred").where("sys = 0")
    good = p.select("case_id", F.lit("metrics_agent").alias("agent"), F.to_json(F.struct(F.col("predicted").alias("entity_id"), F.lit("s").alias("summary"), F.array("step1", "step2").alias("supporting_evidence"), F.lit(0.5).alias("confidence"))).alias("raw"))
    other = p.select("case_id", F.lit("logs_agent").alias("agent"), F.when(F.col("case_id") > "r1", '{"entity_id": null}').otherwise("sorry").alias("raw"))
    return summarize.parse_response(good.unionByName(other))


@query("""WITH c AS (SELECT case_id, predicted FROM fx_pred WHERE sys = 0), a AS (SELECT 'metrics_agent' AS agent UNION ALL SELECT 'logs_agent' UNION ALL SELECT 'trace_agent' UNION ALL SELECT 'topology_agent')
SELECT case_id, agent, CASE WHEN agent = 'metrics_agent' THEN predicted END AS entity_id, CASE WHEN agent = 'metrics_agent' THEN 2 ELSE 0 END AS cited, CASE WHEN agent = 'metrics_agent' THEN 0.5::DOUBLE ELSE 0 END AS confidence
FROM c CROSS JOIN a WHERE NOT (agent = 'logs_agent' AND case_id <= 'r1')""")
def findings(spark, sf):
    out = summarize.findings(view(spark, sf, "fx_seed"), _responses(spark, sf))
    return out.select("case_id", "agent", "entity_id", F.size("supporting_evidence").alias("cited"), "confidence")


@query("SELECT case_id, system, CASE WHEN sys = 0 THEN (SELECT entity_id FROM fx_seed s WHERE s.case_id = p.case_id) WHEN sys = 1 THEN predicted ELSE '' END AS ids, CASE WHEN sys = 1 THEN fault ELSE 'unknown' END AS predicted_fault_type, sys = 0 AS used_entity_fallback FROM fx_pred p")
def result_assembly(spark, sf):
    p = view(spark, sf, "fx_pred")
    cases = p.join(view(spark, sf, "fx_seed").select("case_id", F.col("entity_id").alias("entry_entity_id")), "case_id").select("case_id", "system", "entry_entity_id")
    answers = p.where("sys = 1").select("case_id", "system", F.to_json(F.struct(F.array("predicted").alias("predicted_entity_ids"), F.col("fault").alias("predicted_fault_type"))).alias("parsed"))
    out = summarize.assemble(cases, answers)
    return out.select("case_id", "system", F.concat_ws(",", "predicted_entity_ids").alias("ids"), "predicted_fault_type", "used_entity_fallback")


@query("SELECT case_id, system, count(*) AS total_calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM fx_log GROUP BY case_id, system")
def usage_stats(spark, sf):
    return summarize.usage(view(spark, sf, "fx_log"))
