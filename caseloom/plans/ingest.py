"""Queries of sources, scalar functions, normalisers and name resolution (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize, scalars
from ..operators import graph, resolve
from ..session import fresh_path
from ..sources import cases
from .registry import query
from .views import base, view

INDEX = """SELECT * FROM (
  SELECT case_id, key, CASE WHEN max(named) = 1 THEN arg_max(entity_id, pos) FILTER (WHERE named = 1) ELSE arg_min(entity_id, pos) FILTER (WHERE named = 0) END AS entity_id, min(pos) AS pos FROM (
    SELECT case_id, entity_id, lower(name) AS key, 2 * ord AS pos, 1 AS named FROM fx_entities WHERE name <> ''
    UNION ALL SELECT case_id, entity_id, lower(coalesce(nullif(pod_name, ''), service)), 2 * ord + 1, 0 FROM fx_entities WHERE coalesce(nullif(pod_name, ''), nullif(service, '')) IS NOT NULL) w
  GROUP BY case_id, key)"""
OBS = ("case_id", "modality", "mod_ord", "row_ord", "entity_id", "ts", "text")


def _index(spark, sf):
    return resolve.name_index(view(spark, sf, "fx_entities"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS ord, n_name AS case_id FROM nation ORDER BY n_nationkey LIMIT 10")
def manifest_prefix(spark, sf):
    """A manifest written from the nations is read back; ten cases of it."""
    path = fresh_path(spark, "manifest")
    names = base(spark, sf, "nation").orderBy("n_nationkey").coalesce(1).select(F.concat(F.lit("  "), "n_name"))
    names.write.text(path)
    return cases.read_manifest(spark, path, 10)


@query("SELECT DISTINCT modality, CAST(mod_ord AS INTEGER) AS mod_ord, case_id, count(*) AS n, min(ts) AS first_ts, sum(length(text)) AS chars FROM fx_obs GROUP BY ALL")
def obs_all(spark, sf):
    obs = view(spark, sf, "fx_obs")
    parts = [obs.where(F.col("modality") == m) for m in normalize.MODALITIES]
    return normalize.union_all(*parts).groupBy("modality", "mod_ord", "case_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.sum(F.length("text")).alias("chars")
    )


@query("SELECT case_id, src, dst, relation FROM fx_edges")
def topology_edges(spark, sf):
    """Each case's edges as one JSON topology, parsed again."""
    e = view(spark, sf, "fx_edges").select("case_id", "src", "dst", "relation")
    item = F.struct(F.col("src").alias("source"), F.col("dst").alias("to"), F.col("relation").alias("type"))
    # Blocks of some 1,000 edges, so that a document's size doesn't follow the case's.
    size = e.groupBy("case_id").agg(F.ceil(F.count(F.lit(1)) / 1_000).alias("blocks"))
    e = e.join(size, "case_id")
    docs = e.groupBy("case_id", F.pmod(F.xxhash64("src", "dst"), F.col("blocks")).alias("block")).agg(F.collect_list(item).alias("links"))
    raw = docs.select(F.concat_ws("/", "case_id", "block").alias("case_id"), F.to_json(F.struct("links")).alias("value"))
    _, edges = cases.parse_topology(raw)
    return edges.select(F.substring_index("case_id", "/", 1).alias("case_id"), "src", "dst", "relation")


@query("SELECT case_id, alert_text, entry_entity_id, entity_name FROM fx_alerts")
def alert_context(spark, sf):
    """Tasks as JSON: every second case states its entity in the prompt's tag only."""
    a = view(spark, sf, "fx_alerts")
    odd = F.substring("case_id", 2, 9).cast("int") % 2 == 1
    tag = F.format_string('x <alert_event entity_id="%s" entity_name="%s" /> y', "entry_entity_id", "entity_name")
    entity = F.when(~odd, F.struct(F.col("entry_entity_id").alias("entity_id"), "entity_name"))
    raw = a.select("case_id", F.to_json(F.struct(F.col("alert_text").alias("alert_title"), tag.alias("prompt_text"), entity.alias("alert_entity"))).alias("value"))
    return cases.parse_tasks(raw).select("case_id", "alert_text", "entry_entity_id", "entity_name")


def _truth(spark, sf):
    t = view(spark, sf, "fx_truth").join(view(spark, sf, "fx_seed").select("case_id", "entity_id"), "case_id")
    obs = lambda s: F.struct(F.lit("metrics").alias("source_type"), F.lit(s).alias("signal"), F.struct(F.lit(">").alias("comparator"), F.lit("5").alias("value"), F.lit("ms").alias("unit")).alias("expected"))
    steps = F.array(
        F.struct(F.lit("1").alias("step"), F.lit("cause").alias("step_type"), F.col("target"), F.array(obs("quantity"), obs("status=ERROR")).alias("observability")),
        F.struct(F.lit("2").alias("step"), F.lit("impact").alias("step_type"), F.col("entity_id").alias("target"), F.array(obs("absent_signal")).alias("observability")),
    )
    outcome = F.struct(F.col("slug").alias("expected_fault_id"), F.array("target").alias("target_entity_ids"))
    inner = F.to_json(F.struct(outcome.alias("outcome"), F.struct(steps.alias("steps")).alias("reasoning")))
    raw = t.select(F.col("case_id").alias("task_id"), F.to_json(F.struct(inner.alias("raw_ground_truth"))).alias("value"))
    mapping = t.select(F.to_json(F.struct(F.create_map("case_id", "case_id").alias("task_to_case_id"))).alias("value"))
    return cases.parse_truth(raw, cases.parse_mapping(mapping))


@query("SELECT t.case_id, slug AS fault_type, target AS target_id, 'cause: ' || target || '|impact: ' || s.entity_id AS chain FROM fx_truth t JOIN fx_seed s ON s.case_id = t.case_id")
def gt_flatten(spark, sf):
    from ..operators.evaluate import chain

    return _truth(spark, sf).select("case_id", "fault_type", F.col("target_entity_ids")[0].alias("target_id"), F.concat_ws("|", chain(F.col("steps"))).alias("chain"))


@query("""SELECT t.case_id, step, step_type, CASE WHEN step = '1' THEN target ELSE s.entity_id END AS target, signal, '>' AS comparator, '5' AS value, 'ms' AS unit
FROM fx_truth t JOIN fx_seed s ON s.case_id = t.case_id CROSS JOIN (SELECT '1' AS step, 'cause' AS step_type, 'quantity' AS signal UNION ALL SELECT '1', 'cause', 'status=ERROR' UNION ALL SELECT '2', 'impact', 'absent_signal') x""")
def gt_checkpoints(spark, sf):
    from ..operators.evaluate import checkpoints

    return checkpoints(_truth(spark, sf)).drop("source_type")


@query("SELECT 't' || c_custkey AS task_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '.' || c_custkey ELSE 't' || c_custkey END AS case_id FROM customer")
def case_mapping(spark, sf):
    """Tasks look their real case up; what the mapping lacks keeps the task's id."""
    c = base(spark, sf, "customer")
    pairs = c.where("c_custkey % 3 = 0").select(F.to_json(F.struct(F.create_map(F.concat(F.lit("t"), "c_custkey"), F.concat_ws(".", "c_mktsegment", "c_custkey")).alias("task_to_case_id"))).alias("value"))
    tasks = c.select(F.concat(F.lit("t"), "c_custkey").alias("task_id"), F.lit('{"case_id": ""}').alias("value"))
    return cases.parse_truth(tasks, cases.parse_mapping(pairs)).select("task_id", "case_id")


@query("SELECT entity_type, count(*) AS n FROM fx_entities GROUP BY entity_type")
def profile_entity_types(spark, sf):
    return view(spark, sf, "fx_entities").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query('SELECT \'entity_id\' AS "column", count(*) AS rows, count(*) - count(entity_id) AS nulls FROM fx_obs UNION ALL SELECT \'ts\', count(*), count(*) - count(ts) FROM fx_obs')
def profile_nulls(spark, sf):
    return cases.profile(view(spark, sf, "fx_obs").select("entity_id", "ts")).select("column", "rows", "nulls")


@query("SELECT event_id, CASE WHEN trim(replace(props, '\"k\"', '')) = '' THEN NULL WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN ' ' || props ELSE NULL END AS v FROM events")
def first_valid(spark, sf):
    e = base(spark, sf, "events")
    a = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.lit("  "))
    b = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), "props"))
    return e.select("event_id", scalars.first_valid(a, b).alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_props(spark, sf):
    return view(spark, sf, "fx_json").select("event_id", scalars.json_map(F.col("raw"))["k"].alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE ts END AS parsed FROM events")
def ts_iso(spark, sf):
    e = base(spark, sf, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    m = F.col("event_id") % 4
    raw = F.when(m == 0, F.concat(iso, F.lit("Z"))).when(m == 1, F.concat(iso, F.lit("+00:00"))).when(m == 2, iso).otherwise(F.lit("soon"))
    return e.select("event_id", scalars.iso_timestamp(raw).alias("parsed"))


@query("SELECT event_id, CASE WHEN event_id % 7 < 4 THEN CASE event_id % 7 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) ELSE ts END END AS parsed FROM events")
def ts_epoch_units(spark, sf):
    e = base(spark, sf, "events")
    us, m = F.unix_micros("ts"), F.col("event_id") % 7
    of = lambda unit, n: scalars.epoch_timestamp(n.cast("string"), unit)
    text = F.when(m == 4, "").when(m == 5, "NaN").otherwise("abc")
    parsed = F.when(m == 0, of("s", F.expr("unix_micros(ts) div 1000000"))).when(m == 1, of("ms", F.expr("unix_micros(ts) div 1000"))).when(m == 2, of("us", us)).when(m == 3, of("ns", us * 1000 + 999)).otherwise(scalars.epoch_timestamp(text, "ms"))
    return e.select("event_id", parsed.alias("parsed"))


@query("""SELECT case_id, 'supplier:' || s_suppkey AS entity_id, l_shipdate AS ts, '[metric] ' || s_name || ' quantity=' || CAST(l_quantity AS BIGINT) || '.0' AS text
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN (SELECT n_nationkey, 'r' || n_regionkey AS case_id FROM nation) n ON n_nationkey = s_nationkey""")
def obs_metrics(spark, sf):
    """Even orders state the supplier's id, the others its name alone."""
    raw = view(spark, sf, """SELECT 'r' || n_regionkey AS case_id, l_orderkey * 10 + l_linenumber AS row_ord, CASE WHEN l_orderkey % 2 = 0 THEN 'supplier:' || s_suppkey ELSE '' END AS entity_id,
      s_name AS entity_name, CASE WHEN l_linenumber % 2 = 0 THEN s_name END AS service, 'quantity' AS metric, l_quantity AS value, l_shipdate
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""").withColumn("time", F.unix_micros("l_shipdate"))
    return normalize.metrics(raw, _index(spark, sf)).select("case_id", "entity_id", "ts", "text")


VALUE = "CASE l_linenumber % 6 WHEN 0 THEN CAST(NULL AS DOUBLE) WHEN 1 THEN CAST(l_quantity AS DOUBLE) * 1e7 WHEN 2 THEN CAST(l_quantity AS DOUBLE) / 1e6 WHEN 3 THEN CAST(l_orderkey AS DOUBLE) * 1e12 WHEN 4 THEN CAST(l_quantity AS DOUBLE) * 1e15 ELSE CAST(l_quantity AS DOUBLE) / -4e0 END"


@query(f"""SELECT l_orderkey, l_linenumber, '[metric] ' || s_name || ' reading=' || coalesce(CAST(v AS VARCHAR), 'nan') AS text
FROM (SELECT l_orderkey, l_linenumber, l_suppkey, {VALUE} AS v FROM lineitem) l JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def metric_values(spark, sf):
    """Readings that are missing, tiny or large, as text."""
    raw = view(spark, sf, f"""SELECT 'r' || n_regionkey AS case_id, l_orderkey, l_linenumber, 'supplier:' || s_suppkey AS entity_id, s_name AS entity_name, CAST(NULL AS STRING) AS service, 'reading' AS metric,
      {VALUE} AS value, CAST(NULL AS BIGINT) AS time FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
    keyed = raw.withColumn("row_ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = normalize.metrics(keyed, _index(spark, sf))
    return out.select(F.expr("row_ord div 10").alias("l_orderkey"), F.expr("cast(row_ord % 10 as int)").alias("l_linenumber"), "text")


@query(r"""SELECT case_id, doc_id AS row_ord, 'supplier:' || (doc_id % 10) AS entity_id, '[log:' || regexp_extract(line, '\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|Exception)\b', 1) || '] ' || s_name || ': ' || line AS text
FROM (SELECT 'r' || n_regionkey AS case_id, doc_id, s_name, CASE doc_id % 3 WHEN 0 THEN 'ERROR ' WHEN 1 THEN 'no WARNING: ' ELSE 'INFORMED ' END || text AS line
FROM documents JOIN supplier ON s_suppkey = doc_id % 10 JOIN nation ON n_nationkey = s_nationkey) x""")
def obs_logs(spark, sf):
    raw = view(spark, sf, """SELECT 'r' || n_regionkey AS case_id, doc_id AS row_ord, s_name AS _container_name_, CAST(NULL AS STRING) AS _time_,
      CASE doc_id % 3 WHEN 0 THEN 'ERROR ' WHEN 1 THEN 'no WARNING: ' ELSE 'INFORMED ' END || text AS content FROM documents JOIN supplier ON s_suppkey = doc_id % 10 JOIN nation ON n_nationkey = s_nationkey""")
    return normalize.logs(raw, _index(spark, sf)).select("case_id", "row_ord", "entity_id", "text")


@query("""SELECT 'r' || n_regionkey AS case_id, o_orderkey AS row_ord, 'supplier:' || s_suppkey AS entity_id, o_orderdate AS ts,
'[span] ' || s_name || '.order duration=' || (o_orderkey % 2000) || '.500ms status=' || CASE o_orderstatus WHEN 'P' THEN 'UNSET' WHEN 'O' THEN 'OK' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'ERROR msg=bad' ELSE 'ERROR' END END AS text
FROM orders JOIN supplier ON s_suppkey = o_orderkey % 10 JOIN nation ON n_nationkey = s_nationkey""")
def obs_traces(spark, sf):
    raw = view(spark, sf, """SELECT 'r' || n_regionkey AS case_id, o_orderkey AS row_ord, s_name AS serviceName, 'order' AS spanName, CAST((o_orderkey % 2000) * 1000000 + 500000 AS STRING) AS duration, o_orderdate,
      CASE o_orderstatus WHEN 'P' THEN '0' WHEN 'O' THEN '1' ELSE '2' END AS statusCode, CASE WHEN o_orderkey % 2 = 0 THEN 'bad' END AS statusMessage
      FROM orders JOIN supplier ON s_suppkey = o_orderkey % 10 JOIN nation ON n_nationkey = s_nationkey""").withColumn("startTime", (F.unix_micros("o_orderdate") * 1000).cast("string"))
    return normalize.traces(raw, _index(spark, sf)).select("case_id", "row_ord", "entity_id", "ts", "text")


@query("""SELECT 'r' || n_regionkey AS case_id, event_id AS row_ord, 'supplier:' || s_suppkey AS entity_id, date_trunc('second', ts) AS ts, '[event:Warning] ' || event_type || ' — ' || CASE WHEN event_id % 2 = 0 THEN 'm' || user_id ELSE '' END AS text
FROM events JOIN supplier ON s_suppkey = event_id % 10 JOIN nation ON n_nationkey = s_nationkey""")
def obs_events(spark, sf):
    e = view(spark, sf, "SELECT 'r' || n_regionkey AS case_id, event_id AS row_ord, s_name AS pod_name, 'Warning' AS level, ts, event_type, user_id, event_id FROM events JOIN supplier ON s_suppkey = event_id % 10 JOIN nation ON n_nationkey = s_nationkey")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    even = F.col("event_id") % 2 == 0
    body = F.to_json(F.struct(F.col("event_type").alias("reason"), F.when(even, F.concat(F.lit("m"), "user_id")).alias("message"), F.when(even, at).otherwise(F.lit("")).alias("lastTimestamp"), at.alias("firstTimestamp")))
    return normalize.events(e.withColumn("eventId", body), _index(spark, sf)).select("case_id", "row_ord", "entity_id", "ts", "text")


@query("SELECT 'r' || (user_id % 5) AS case_id, event_id AS row_ord, CASE WHEN event_id % 3 > 0 THEN 'host:' || user_id END AS entity_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END AS ts, '[alert:firing] ' || event_type || ' — k' AS text FROM events WHERE event_type = 'error'")
def obs_alerts(spark, sf):
    e = base(spark, sf, "events").where("event_type = 'error'")
    resource = F.when(F.col("event_id") % 3 > 0, F.to_json(F.struct(F.struct(F.concat(F.lit("host:"), "user_id").alias("entity_id")).alias("entity")))).otherwise("broken {")
    raw = e.select(
        F.concat(F.lit("r"), F.col("user_id") % 5).alias("case_id"), F.col("event_id").alias("row_ord"), resource.alias("resource"), F.lit('{"message": "k"}').alias("annotations"),
        F.when(F.col("event_id") % 2 == 0, F.expr("cast(unix_micros(ts) div 1000 as string)")).alias("timestamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("time"),
        F.lit("firing").alias("status"), F.col("event_type").alias("subject"),
    )
    return normalize.alerts(raw).select("case_id", "row_ord", "entity_id", "ts", "text")


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN 'e' || user_id END AS entity_id, CASE WHEN event_id % 4 = 1 THEN 'n' || event_id END AS entity_name FROM events")
def alert_tag_parse(spark, sf):
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.lit("no tag here")).when(m == 1, F.format_string('a <alert_event entity_id="x" entity_name="n%d" entity_id="e%d"/> <alert_event entity_id="z">', "event_id", "user_id")).otherwise(F.format_string('<alert_event my_entity_id="q" entity_id="e%d">', "user_id"))
    e = base(spark, sf, "events").withColumn("t", text)
    return e.select("event_id", scalars.tag_attribute(F.col("t"), "entity_id").alias("entity_id"), scalars.tag_attribute(F.col("t"), "entity_name").alias("entity_name"))


@query(r"""WITH w AS (SELECT item_id, pos, btrim_(word) AS word FROM (SELECT doc_id AS item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, string_split_regex(trim(text, E' \n\t'), '\s+') AS ws FROM documents)) x WHERE length(word) > 3),
f AS (SELECT item_id, word, min(pos) AS pos FROM w GROUP BY item_id, word), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM f)
SELECT item_id AS doc_id, string_agg(word, '|' ORDER BY n) AS keywords FROM r WHERE n <= 20 GROUP BY item_id""".replace("btrim_(word)", "trim(word, '.,:;')"))
def alert_keywords(spark, sf):
    k = base(spark, sf, "documents").select("doc_id", scalars.alert_keywords(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("k"))
    return k.where(F.size("k") > 0).select("doc_id", F.concat_ws("|", "k").alias("keywords"))


@query(f"""WITH ix AS ({INDEX}), a AS (SELECT case_id, CASE WHEN case_id < 'r3' THEN 'gone' ELSE entry_entity_id END AS entry, entity_name FROM fx_alerts)
SELECT a.case_id, CASE WHEN entry IN (SELECT entity_id FROM fx_entities) THEN entry ELSE coalesce((SELECT arg_min(ix.entity_id, pos) FROM ix WHERE ix.case_id = a.case_id AND contains(key, lower(entity_name))), entry) END AS entry_entity_id FROM a""")
def alert_rebind(spark, sf):
    e = view(spark, sf, "fx_entities")
    a = view(spark, sf, "fx_alerts").withColumn("entry_entity_id", F.when(F.col("case_id") < "r3", "gone").otherwise(F.col("entry_entity_id")))
    return normalize.rebind_alerts(a, e, resolve.name_index(e)).select("case_id", "entry_entity_id")


@query("""SELECT w.case_id, centre_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_windows w JOIN fx_obs o ON o.case_id = w.case_id
AND ts BETWEEN centre - INTERVAL 15 MINUTE AND centre + INTERVAL 15 MINUTE WHERE modality <> 'logs' GROUP BY w.case_id, centre_id""")
def window_slice(spark, sf):
    near = normalize.in_window(view(spark, sf, "fx_obs").where("modality <> 'logs'"), view(spark, sf, "fx_windows"))
    return near.groupBy("case_id", "centre_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT DISTINCT split_part(c_mktsegment || '.' || c_custkey, '.', 1) AS slug FROM customer")
def fault_labels(spark, sf):
    named = base(spark, sf, "customer").select(F.concat_ws(".", "c_mktsegment", "c_custkey").alias("name"))
    return named.select(scalars.fault_slug(F.col("name")).alias("slug")).distinct().orderBy("slug")


@query(r"SELECT case_id, modality, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)(error|exception|fail|timeout|5\d\d)')) AS errors FROM fx_obs GROUP BY case_id, modality")
def error_flag(spark, sf):
    return view(spark, sf, "fx_obs").groupBy("case_id", "modality").agg(F.count(F.lit(1)).alias("n"), F.count_if(scalars.is_error(F.col("text"))).alias("errors"))


@query(INDEX)
def name_index(spark, sf):
    return _index(spark, sf)


@query(f"WITH ix AS ({INDEX}) SELECT n.case_id, name, entity_id FROM fx_names n JOIN ix ON ix.case_id = n.case_id AND key = lower(name)")
def resolve_exact(spark, sf):
    return resolve.exact(view(spark, sf, "fx_names"), _index(spark, sf))


@query(f"""WITH ix AS ({INDEX}), p AS (SELECT case_id, name, split_part(lower(name), '::', 1) AS svc, split_part(lower(name), '::', 2) AS op FROM fx_names WHERE contains(name, '::')),
b AS (SELECT p.case_id, name, arg_min(entity_id, pos) AS entity_id FROM p JOIN ix ON ix.case_id = p.case_id AND contains(key, svc) AND contains(key, op) GROUP BY p.case_id, name)
SELECT p.case_id, p.name, coalesce(b.entity_id, ix.entity_id) AS entity_id FROM p LEFT JOIN b ON b.case_id = p.case_id AND b.name = p.name LEFT JOIN ix ON ix.case_id = p.case_id AND key = svc WHERE coalesce(b.entity_id, ix.entity_id) IS NOT NULL""")
def resolve_composite(spark, sf):
    return resolve.composite(view(spark, sf, "fx_names"), _index(spark, sf))


@query(f"WITH ix AS ({INDEX}) SELECT n.case_id, name, arg_min(entity_id, pos) AS entity_id FROM fx_names n JOIN ix ON ix.case_id = n.case_id AND (contains(key, lower(name)) OR contains(lower(name), key)) GROUP BY n.case_id, name")
def resolve_substring(spark, sf):
    return resolve.substring(view(spark, sf, "fx_names"), _index(spark, sf))


@query("SELECT DISTINCT case_id, entity_id FROM fx_obs WHERE entity_id <> '' AND (case_id, entity_id) NOT IN (SELECT (case_id, entity_id) FROM fx_entities)")
def coverage_anti(spark, sf):
    return resolve.unresolved_ids(view(spark, sf, "fx_obs"), view(spark, sf, "fx_entities"))


@query("""SELECT e.case_id, nodes, observations, resolved, unresolved_ids FROM (SELECT case_id, count(*) AS nodes FROM fx_entities GROUP BY case_id) e
JOIN (SELECT o.case_id, count(*) AS observations, count(*) FILTER (WHERE o.entity_id <> '') AS resolved, count(DISTINCT CASE WHEN n.entity_id IS NULL AND o.entity_id <> '' THEN o.entity_id END) AS unresolved_ids
FROM fx_obs o LEFT JOIN fx_entities n ON n.case_id = o.case_id AND n.entity_id = o.entity_id GROUP BY o.case_id) c ON c.case_id = e.case_id""")
def coverage_stats(spark, sf):
    e = view(spark, sf, "fx_entities")
    return resolve.coverage(view(spark, sf, "fx_obs"), graph.nodes_of(e, view(spark, sf, "fx_edges")))


@query("""SELECT case_id, query_id, vec_id, round(score, 6) AS score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id, query_id ORDER BY round(score, 9) DESC, vec_id) AS n FROM (
SELECT 'r' || (v.vec_id % 5) AS case_id, q.vec_id AS query_id, v.vec_id, sum(CAST(v.x AS DOUBLE) * q.x) / sqrt(sum(CAST(v.x AS DOUBLE) * v.x)) / sqrt(sum(CAST(q.x AS DOUBLE) * q.x)) AS score
FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) v
JOIN (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 20 = 0) q ON q.i = v.i AND v.vec_id % 5 = (q.vec_id // 20) % 5 GROUP BY v.vec_id, q.vec_id) s) t WHERE n <= 20""")
def vector_search_case(spark, sf):
    """Vectors are written by case; every vector whose id is divisible by 20 is searched in a case."""
    from ..operators.search import case_topk

    path = fresh_path(spark, "vectors")
    emb = base(spark, sf, "embeddings").select("vec_id", "embedding")
    cases.write_vectors(emb.withColumn("case_id", F.concat(F.lit("r"), F.col("vec_id") % 5)), path)
    q = emb.where("vec_id % 20 = 0").select(F.concat(F.lit("r"), F.expr("vec_id div 20 % 5")).alias("case_id"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    kind = emb.schema["embedding"].dataType.simpleString()
    asked = cases.read_vectors(spark, path, f"vec_id bigint, embedding {kind}, case_id string", q)
    return case_topk(q, asked).withColumn("score", F.round("score", 6))


METRIC_FILES = "SELECT case_id, l_orderkey * 10 + l_linenumber AS id, s_name, l_quantity AS value, l_shipdate FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN (SELECT n_nationkey, 'r' || n_regionkey AS case_id FROM nation) n ON n_nationkey = s_nationkey"


def _metric_files(spark, sf) -> str:
    """A folder of the metrics of each case, whose files differ in types and columns by case."""
    root = fresh_path(spark, "benchmark")
    rows = view(spark, sf, METRIC_FILES).withColumn("time", F.unix_micros("l_shipdate"))
    for n, case in enumerate(sorted(r.case_id for r in rows.select("case_id").distinct().collect())):
        time = (F.col("time"), F.col("time").cast("string"), F.col("l_shipdate"))[n % 3].alias("time")
        value = (F.col("value").cast("double"), F.col("value").cast("string"))[n % 2].alias("value")
        more = [F.lit("x").alias("unit")] if n == 1 else [F.lit(None).cast("string").alias("service")]
        some = rows.where(F.col("case_id") == case).select(F.col("s_name").alias("entity_name"), F.lit("quantity").alias("metric"), value, time, *more)
        some.coalesce(1).write.parquet(f"{root}/{case}/metrics.parquet")
    return root


@query(f"SELECT case_id, s_name AS entity_name, l_shipdate AS ts, value::DOUBLE AS value, count(*) AS n FROM ({METRIC_FILES}) m GROUP BY ALL")
def telemetry_read(spark, sf):
    """Metrics read back from files that differ in their types by case."""
    raw = cases.read_telemetry(spark, _metric_files(spark, sf), "metrics")
    at = scalars.epoch_timestamp(F.col("time"), "us")
    return raw.groupBy("case_id", "entity_name", at.alias("ts"), "value").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT DISTINCT 'r' || n_regionkey AS case_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey), n AS (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS n FROM c)
SELECT case_id, 'entity_name' AS "column", 'string' AS type FROM n UNION ALL SELECT case_id, 'metric', 'string' FROM n UNION ALL SELECT case_id, 'value', CASE n % 2 WHEN 0 THEN 'double' ELSE 'string' END FROM n
UNION ALL SELECT case_id, 'time', CASE n % 3 WHEN 0 THEN 'bigint' WHEN 1 THEN 'string' ELSE 'timestamp' END FROM n UNION ALL SELECT case_id, CASE WHEN n = 1 THEN 'unit' ELSE 'service' END, 'string' FROM n""")
def telemetry_columns(spark, sf):
    """Columns and types of each case's files, from their footers."""
    files = cases.telemetry_files(spark, _metric_files(spark, sf), "metrics")
    return files.select("case_id", F.explode("columns").alias("c")).select("case_id", F.col("c.name").alias("column"), F.col("c.type").alias("type"))
