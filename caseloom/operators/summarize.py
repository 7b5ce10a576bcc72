"""Evidence to bullets, prompts and parsed answers.

``evidence``: case_id, entity_id, modality, mod_ord, text, hybrid_score, rank (its place in
the merged list). Empty and null entities are ``unresolved``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_error, present
from ..session import stage

#: Fixed texts of the summary.
NO_SIGNAL = "No strong signal in retrieved evidence for this entity"
UNRESOLVED = "unresolved"
#: Different names of ranked entities up to which evidence is filtered by name first; beyond it the join alone picks the rows.
MOST_NAMED = 1000
#: What agents and the last step are asked for.
ASK = "Name the entity most likely implicated and why, as JSON with entity_id, summary, supporting_evidence and confidence."
FINAL_ASK = "State the root cause as JSON with predicted_entity_ids, predicted_fault_type, reasoning_chain and confidence."
#: Agents and the word by which a bullet is theirs.
VIEWS = {"metrics_agent": "metric", "logs_agent": "log", "trace_agent": "span", "topology_agent": None}


def entity_buckets(evidence: DataFrame, most: int = 8) -> DataFrame:
    """The ``most`` entities with the best evidence: entity_id, best, items, entity_rank."""
    buckets = (
        evidence.withColumn("entity_id", F.coalesce(present(F.col("entity_id")), F.lit(UNRESOLVED)))
        .groupBy("case_id", "entity_id")
        .agg(F.max("hybrid_score").alias("best"), F.count(F.lit(1)).alias("items"), F.min("rank").alias("first"))
    )
    w = Window.partitionBy("case_id").orderBy(F.desc("best"), "first", "entity_id")
    return buckets.withColumn("entity_rank", F.row_number().over(w)).where(F.col("entity_rank") <= most).drop("first")


def _of(evidence: DataFrame, modality: str) -> DataFrame:
    return evidence.where(F.col("modality") == modality).withColumn("entity_id", F.coalesce(present(F.col("entity_id")), F.lit(UNRESOLVED)))


def _bullet(df: DataFrame, kind: int, place, text) -> DataFrame:
    return df.select("case_id", "entity_id", F.lit(kind).alias("kind"), place.cast("int").alias("place"), text.alias("bullet"))


def log_bullets(evidence: DataFrame) -> DataFrame:
    n = _of(evidence, "logs").groupBy("case_id", "entity_id").agg(F.count_if(is_error(F.col("text"))).alias("e"), F.count(F.lit(1)).alias("t"))
    return _bullet(n.where("e > 0"), 0, F.lit(1), F.format_string("Error/exception patterns in %d/%d retrieved log lines", "e", "t"))


def metric_bullets(evidence: DataFrame, most: int = 4) -> DataFrame:
    """The first different readings: what follows the first bracket."""
    reading = F.trim(F.when(F.instr("text", "]") > 0, F.expr("substring(text, instr(text, ']') + 1)")).otherwise(F.col("text")))
    seen = _of(evidence, "metrics").withColumn("reading", reading).groupBy("case_id", "entity_id", "reading").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("case_id", "entity_id").orderBy("rank", "reading"))
    return _bullet(seen.withColumn("n", place).where(F.col("n") <= most), 1, F.col("n"), F.concat(F.lit("Metric observed: "), "reading"))


def trace_bullets(evidence: DataFrame) -> DataFrame:
    n = _of(evidence, "traces").groupBy("case_id", "entity_id").agg(F.count_if(is_error(F.col("text"))).alias("e"))
    return _bullet(n.where("e > 0"), 2, F.lit(1), F.format_string("%d span(s) with error/timeout status among retrieved traces", "e"))


def event_alert_bullets(evidence: DataFrame) -> DataFrame:
    """The first three events and two alerts of an entity."""
    place = F.row_number().over(Window.partitionBy("case_id", "entity_id").orderBy("rank", "text"))
    events = _of(evidence, "events").withColumn("n", place).where("n <= 3")
    alerts = _of(evidence, "alerts").withColumn("n", place).where("n <= 2")
    return _bullet(events, 3, F.col("n"), F.replace(F.col("text"), F.lit("[event] "), F.lit("Lifecycle event: "))).unionByName(
        _bullet(alerts, 4, F.col("n"), F.replace(F.col("text"), F.lit("[alert:"), F.lit("Alert stage [")))
    )


def summary(evidence: DataFrame, most_entities: int = 8, most_bullets: int = 5) -> DataFrame:
    """case_id, entity_rank, entity_id, bullets (array), in order of the kinds.

    Entities are ranked first, so that only evidence of the best ones is made into bullets.
    """
    ranked = stage(entity_buckets(evidence, most_entities), "buckets")  # ``most_entities`` rows a case; every kind of bullet reads them
    named = evidence.withColumn("entity_id", F.coalesce(present(F.col("entity_id")), F.lit(UNRESOLVED)))
    # As a filter by name Spark pushes it below the joins that make the evidence, so that rows of other entities aren't shuffled there.
    names = [r.entity_id for r in ranked.select("entity_id").distinct().limit(MOST_NAMED + 1).collect()]
    if len(names) <= MOST_NAMED:
        named = named.where(F.col("entity_id").isin(names))
    near = named.join(ranked.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_semi")
    parts = [f(near) for f in (log_bullets, metric_bullets, trace_bullets, event_alert_bullets)]
    bullets = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    # At most 11 bullets an entity: the groups are small whatever the evidence.
    listed = bullets.groupBy("case_id", "entity_id").agg(F.sort_array(F.collect_list(F.struct("kind", "place", "bullet"))).alias("b"))
    lines = F.slice(F.transform("b", lambda x: x["bullet"]), 1, most_bullets)
    return ranked.join(listed, ["case_id", "entity_id"], "left").select(
        "case_id", "entity_rank", "entity_id", F.coalesce(lines, F.array(F.lit(NO_SIGNAL))).alias("bullets")
    )


def _lines(summaries: DataFrame, line) -> DataFrame:
    joined = F.sort_array(F.collect_list(F.struct("entity_rank", line.alias("line"))))
    return summaries.groupBy("case_id").agg(F.concat_ws("\n", F.transform(joined, lambda x: x["line"])).alias("summary_text"))


def summary_text(summaries: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One text per case: each entity (by name if names are given) and its bullets."""
    label = F.col("entity_id")
    if names is not None:
        # Written first, as a few rows then meet the names of all entities, which aren't shuffled.
        summaries = stage(summaries, "summaries")
        asked = names.join(summaries.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_semi")
        summaries = summaries.join(asked.select("case_id", "entity_id", F.col("name").alias("__name")), ["case_id", "entity_id"], "left")
        label = F.coalesce("__name", "entity_id")
    return _lines(summaries, F.concat_ws("\n", label, F.transform("bullets", lambda b: F.concat(F.lit("  • "), b))))


def flat_text(summaries: DataFrame) -> DataFrame:
    """One ``entity: bullet; bullet`` line each."""
    return _lines(summaries, F.concat(F.col("entity_id"), F.lit(": "), F.concat_ws("; ", "bullets")))


def modality_view(summaries: DataFrame, word: str | None) -> DataFrame:
    """Bullets that hold a word; the whole summary for a case without any such bullet."""
    if word is None:
        return summaries
    kept = F.filter("bullets", lambda b: F.contains(F.lower(b), F.lit(word.lower())))
    marked = summaries.withColumn("__kept", kept)
    some = F.max(F.size("__kept") > 0).over(Window.partitionBy("case_id"))
    marked = marked.withColumn("__some", some).where("not __some or size(__kept) > 0")
    return marked.withColumn("bullets", F.when(F.col("__some"), F.col("__kept")).otherwise(F.col("bullets"))).drop("__kept", "__some")


def _alert() -> Column:
    return F.concat(F.lit("Alert: "), F.coalesce("alert_text", F.lit("")), F.lit("\n\n"))


def _in_order(df: DataFrame, order: str, item: Column, name: str) -> DataFrame:
    """case_id and an array of a few items in order."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i"))))
    return df.groupBy("case_id").agg(F.transform(listed, lambda x: x["i"]).alias(name))


def _or_none(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def prompt_table(
    summaries: DataFrame, alerts: DataFrame, neighbours: DataFrame | None = None, candidates: DataFrame | None = None, system: str = "proposed_hybrid"
) -> DataFrame:
    """One request text per alert and specialist agent, for an inference step outside.

    ``candidates``: case_id, entity_id, rank. Each agent sees its own bullets, the topology
    agent the neighbours and the ranked candidates; a system without a topology gives neither.
    A case that lacks evidence, neighbours or candidates has an empty text or lists.
    """
    summaries = stage(summaries, "summaries")  # each agent reads them
    out = None
    for agent, word in VIEWS.items():
        if agent == "topology_agent":
            body = F.concat(
                F.lit("Upstream: "), F.to_json(_or_none("upstream")), F.lit("\nDownstream: "), F.to_json(_or_none("downstream")),
                F.lit("\nCandidates: "), F.to_json(_or_none("ids")), F.lit("\n\n" + ASK),
            )
            none = F.lit(None).cast("array<string>")
            near = alerts.select("case_id", none.alias("upstream"), none.alias("downstream")) if neighbours is None else neighbours.select("case_id", "upstream", "downstream")
            ids = alerts.select("case_id", none.alias("ids")) if candidates is None else _in_order(candidates, "rank", F.col("entity_id"), "ids")
            rows = alerts.join(near, "case_id", "left").join(ids, "case_id", "left")
        else:
            body = F.concat(F.lit("Evidence:\n"), F.coalesce("summary_text", F.lit("")), F.lit("\n\n" + ASK))
            rows = alerts.join(summary_text(modality_view(summaries, word)), "case_id", "left")
        one = rows.select("case_id", F.lit(system).alias("system"), F.lit(agent).alias("agent"), F.concat(_alert(), body).alias("prompt"))
        out = one if out is None else out.unionByName(one)
    return out


def _type(extra: Column | None = None) -> Column:
    """``- slug: definition``; the slug alone where it has no definition."""
    head = F.concat(F.lit("- "), F.col("slug")) if extra is None else F.concat(F.lit("- "), F.col("slug"), extra)
    return F.concat(head, F.coalesce(F.concat(F.lit(": "), present(F.col("definition"))), F.lit("")))


def all_types(definitions: DataFrame) -> DataFrame:
    """One row, ``every``: all fault types (slug, definition; some dozens) with their definitions."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("slug"), _type().alias("line"))))
    return definitions.select(F.concat_ws("\n", F.transform(listed, lambda x: x["line"])).alias("every"))


def type_hints(alerts: DataFrame, shortlist: DataFrame, definitions: DataFrame) -> DataFrame:
    """case_id, types: the shortlist (case_id, slug, rank, similarity) of each alert, all types where it has none."""
    named = shortlist.join(definitions.select("slug", "definition"), "slug", "left")
    line = _type(F.format_string(" (similarity %.3f)", F.round("similarity", 3)))
    lines = named.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("b"))
    short = lines.select("case_id", F.concat(F.lit("Likely fault types:\n"), F.concat_ws("\n", F.transform("b", lambda x: x["line"]))).alias("short"))
    whole = F.concat(F.lit("Fault types:\n"), "every")
    return alerts.select("case_id").distinct().join(short, "case_id", "left").crossJoin(F.broadcast(all_types(definitions))).select(  # one row
        "case_id", F.coalesce("short", whole).alias("types")
    )


def coordinator_prompts(alerts: DataFrame, found: DataFrame, shortlist: DataFrame, definitions: DataFrame, system: str = "proposed_hybrid") -> DataFrame:
    """One request text per alert for the coordinator: the agents' findings (none: ``{}``) and likely fault types."""
    said = F.struct("entity_id", "summary", "supporting_evidence", "confidence")
    by_agent = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("agent"), said.alias("f")))))
    rows = alerts.join(found.groupBy("case_id").agg(F.to_json(by_agent).alias("said")), "case_id", "left").join(type_hints(alerts, shortlist, definitions), "case_id", "left")
    body = F.concat(F.lit("Findings:\n"), F.coalesce("said", F.lit("{}")), F.lit("\n\n"), "types", F.lit("\n\n" + FINAL_ASK))
    return rows.select("case_id", F.lit(system).alias("system"), F.lit("coordinator").alias("agent"), F.concat(_alert(), body).alias("prompt"))


def baseline_prompts(alerts: DataFrame, texts: DataFrame, shortlist: DataFrame, candidates: DataFrame, definitions: DataFrame) -> DataFrame:
    """Request texts of the systems of one call: text evidence, ranked entities, the alert alone.

    Every alert has one of each: without evidence or candidates these are empty. ``shortlist`` is
    that of ``texts``; the last two systems choose from all of ``definitions``.
    """
    every = F.broadcast(all_types(definitions))  # one row
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "entity_id", F.format_string(" (%.3f)", F.round("graph_score", 3)))
    ranked = _in_order(candidates, "rank", line, "ids")
    whole = F.concat(F.lit("Fault types:\n"), "every", F.lit("\n\n" + FINAL_ASK))
    parts = {
        "standard_rag": (
            alerts.join(texts, "case_id", "left").join(type_hints(alerts, shortlist, definitions), "case_id", "left"),
            F.concat(F.lit("Evidence:\n"), F.coalesce("summary_text", F.lit("")), F.lit("\n\n"), "types", F.lit("\n\n" + FINAL_ASK)),
        ),
        "graphrag_only": (
            alerts.join(ranked, "case_id", "left").crossJoin(every),
            F.concat(F.lit("Entry: "), F.coalesce("entry_entity_id", F.lit("none")), F.lit("\nCandidates:\n"), F.concat_ws("\n", _or_none("ids")), F.lit("\n\n"), whole),
        ),
        "direct_llm": (alerts.crossJoin(every), whole),
    }
    out = [rows.select("case_id", F.lit(k).alias("system"), F.lit("single").alias("agent"), F.concat(_alert(), body).alias("prompt")) for k, (rows, body) in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def parse_response(responses: DataFrame) -> DataFrame:
    """Adds parsed (JSON text, null if none) and parse_error to rows with ``raw``.

    The whole text is tried, then what lies from the first ``{`` to the last ``}``.
    """
    start = F.instr("raw", "{")
    end = F.length("raw") - F.instr(F.reverse("raw"), "}") + 1
    inner = F.when((start > 0) & F.contains("raw", F.lit("}")) & (end >= start), F.col("raw").substr(start, end - start + 1))
    good = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    parsed = F.coalesce(good(F.col("raw")), good(inner))
    return responses.withColumn("parsed", parsed).withColumn("parse_error", F.col("parsed").isNull())


def findings(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per case and agent; unparsable answers are left out, missing ones are empty."""
    agents = cases.select("case_id").distinct().withColumn("agent", F.explode(F.array(*[F.lit(a) for a in VIEWS])))
    joined = agents.join(responses, ["case_id", "agent"], "left").where("parse_error is null or not parse_error")
    get = lambda k: F.get_json_object("parsed", f"$.{k}")
    listed = F.from_json(F.coalesce(get("supporting_evidence"), F.lit("[]")), "array<string>")
    return joined.select(
        "case_id", "agent", get("entity_id").alias("entity_id"), F.coalesce(get("summary"), F.lit("")).alias("summary"),
        listed.alias("supporting_evidence"), F.coalesce(get("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
    )


def assemble(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Final rows from the coordinator's answer.

    ``cases``: case_id, system, entry_entity_id. Without predictions the hybrid system
    falls back to the alert's entry; used_entity_fallback says so.
    """
    joined = cases.join(answers, ["case_id", "system"], "left")
    none = F.array().cast("array<string>")
    get = lambda k: F.get_json_object("parsed", f"$.{k}")
    ids = F.coalesce(F.from_json(get("predicted_entity_ids"), "array<string>"), none)
    empty = F.size(ids) == 0
    hybrid = F.col("system") == "proposed_hybrid"
    entry = F.when(present(F.col("entry_entity_id")).isNotNull(), F.array("entry_entity_id")).otherwise(none)
    return joined.select(
        "case_id", "system",
        F.when(empty & hybrid, entry).otherwise(ids).alias("predicted_entity_ids"),
        F.coalesce(get("predicted_fault_type"), F.lit("unknown")).alias("predicted_fault_type"),
        F.coalesce(F.from_json(get("reasoning_chain"), "array<string>"), none).alias("reasoning_chain"),
        F.coalesce(get("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        (empty & hybrid).alias("used_entity_fallback"),
    )


def usage(log: DataFrame) -> DataFrame:
    """Calls and tokens per case and system."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return log.groupBy("case_id", "system").agg(F.count(F.lit(1)).alias("total_calls"), F.sum(tokens).alias("total_tokens"))
