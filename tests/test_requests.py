"""Requests of every system: no alert is lost, whatever else a case lacks."""

from caseloom.operators import retrieve, summarize

ALERTS = "case_id string, entry_entity_id string, alert_text string"
DEFS = [("F1-disk", "disk writes are slow"), ("F2-dns", "lookups fail"), ("F3-cpu", None)]


def tables(spark):
    """Case a has all, b no evidence, c no findings, d no candidates, e nothing."""
    alerts = spark.createDataFrame([(c, None if c == "e" else "x", f"alert {c}") for c in "abcde"], ALERTS)
    summaries = spark.createDataFrame([(c, 1, "x", ["Metric observed: disk"]) for c in "acd"], "case_id string, entity_rank int, entity_id string, bullets array<string>")
    near = spark.createDataFrame([("a", "x", ["u"], []), ("b", "x", [], ["v"])], "case_id string, entity_id string, upstream array<string>, downstream array<string>")
    candidates = spark.createDataFrame([(c, "x", 1, 1.0) for c in "abc"] + [("a", "y", 2, 0.25)], "case_id string, entity_id string, rank int, graph_score double")
    found = spark.createDataFrame([(c, "logs_agent", "x", "s", ["e"], 0.5) for c in "abd"], "case_id string, agent string, entity_id string, summary string, supporting_evidence array<string>, confidence double")
    return alerts, summaries, near, candidates, found, spark.createDataFrame(DEFS, "slug string, definition string")


def by_case(df):
    return {(r.case_id, r.system, r.agent): r.prompt for r in df.collect()}


def test_agents_have_a_request_of_every_alert(spark):
    alerts, summaries, near, candidates, _, _ = tables(spark)
    got = by_case(summarize.prompt_table(summaries, alerts, near, candidates))
    assert {k[0] for k in got} == set("abcde") and len(got) == 5 * len(summarize.VIEWS)
    assert got["a", "proposed_hybrid", "metrics_agent"] == f"Alert: alert a\n\nEvidence:\nx\n  • Metric observed: disk\n\n{summarize.ASK}"
    assert got["e", "proposed_hybrid", "metrics_agent"] == f"Alert: alert e\n\nEvidence:\n\n\n{summarize.ASK}"
    topology = {c: got[c, "proposed_hybrid", "topology_agent"].split("\n\n")[1] for c in "abde"}
    assert topology == {
        "a": 'Upstream: ["u"]\nDownstream: []\nCandidates: ["x","y"]', "b": 'Upstream: []\nDownstream: ["v"]\nCandidates: ["x"]',
        "d": "Upstream: []\nDownstream: []\nCandidates: []", "e": "Upstream: []\nDownstream: []\nCandidates: []",
    }


def test_the_system_without_retrieval_has_no_topology(spark):
    alerts, summaries, *_ = tables(spark)
    got = by_case(summarize.prompt_table(summaries, alerts, system="multi_agent_only"))
    assert len(got) == 20 and {k[1] for k in got} == {"multi_agent_only"}
    assert {got[c, "multi_agent_only", "topology_agent"].split("\n\n")[1] for c in "abcde"} == {"Upstream: []\nDownstream: []\nCandidates: []"}


def test_types_are_the_shortlist_or_all_with_definitions(spark):
    alerts, summaries, _, candidates, found, definitions = tables(spark)
    text = summarize.flat_text(summaries).withColumnRenamed("summary_text", "text")
    short = retrieve.shortlist(text, definitions, 2)
    got = by_case(summarize.coordinator_prompts(alerts, found, short, definitions))
    assert {k[0] for k in got} == set("abcde")
    every = "Fault types:\n- F1-disk: disk writes are slow\n- F2-dns: lookups fail\n- F3-cpu"
    assert got["b", "proposed_hybrid", "coordinator"].split("\n\n")[2] == got["e", "proposed_hybrid", "coordinator"].split("\n\n")[2] == every
    lines = got["a", "proposed_hybrid", "coordinator"].split("\n\n")[2].split("\n")
    assert lines[0] == "Likely fault types:" and lines[1].startswith("- F1-disk (similarity 0.") and lines[1].endswith("): disk writes are slow")
    assert lines[2] == "- F2-dns (similarity 0.000): lookups fail" and len(lines) == 3
    assert got["c", "proposed_hybrid", "coordinator"].split("\n\n")[1] == "Findings:\n{}"
    assert '"logs_agent":{"entity_id":"x"' in got["a", "proposed_hybrid", "coordinator"]

    one = by_case(summarize.baseline_prompts(alerts, summarize.summary_text(summaries), short, candidates, definitions))
    assert len(one) == 15 and {k[1] for k in one} == {"standard_rag", "graphrag_only", "direct_llm"}
    assert one["e", "standard_rag", "single"] == f"Alert: alert e\n\nEvidence:\n\n\n{every}\n\n{summarize.FINAL_ASK}"
    assert one["d", "graphrag_only", "single"] == f"Alert: alert d\n\nEntry: x\nCandidates:\n\n\n{every}\n\n{summarize.FINAL_ASK}"
    assert "Candidates:\n1. x (1.000)\n2. y (0.250)\n\n" in one["a", "graphrag_only", "single"] and "Entry: none\n" in one["e", "graphrag_only", "single"]
    assert one["e", "direct_llm", "single"] == f"Alert: alert e\n\n{every}\n\n{summarize.FINAL_ASK}"


def test_a_text_without_a_common_word_has_a_shortlist(spark):
    definitions = spark.createDataFrame([(s, None) for s in ("w", "x", "y", "z")], "slug string, definition string")
    texts = spark.createDataFrame([("a", "alpha y"), ("b", "alpha beta"), ("c", "12 %"), ("d", " \n"), ("e", None)], "case_id string, text string")
    got = {}
    for r in retrieve.shortlist(texts, definitions, 3).orderBy("case_id", "rank").collect():
        got.setdefault(r.case_id, []).append((r.slug, round(r.similarity, 3)))
    assert got == {"a": [("y", 0.707), ("w", 0), ("x", 0)], "b": [("w", 0), ("x", 0), ("y", 0)], "c": [("w", 0), ("x", 0), ("y", 0)]}
    assert {r["count"] for r in retrieve.shortlist(texts, definitions, 9).groupBy("case_id").count().collect()} == {4}
