"""The views hold every row of their tables, not a subset of ids."""

import os

import pytest

from caseloom.plans.views import VIEWS, base, view, write_views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_observations_and_evidence_are_whole(spark):
    n = {r[0]: r[1] for r in view(spark, SF, "fx_obs").groupBy("modality").count().collect()}
    assert n["metrics"] == base(spark, SF, "lineitem").count()
    assert n["traces"] == base(spark, SF, "orders").count()
    assert view(spark, SF, "fx_evidence").count() == sum(n.values())
    errors = base(spark, SF, "events").where("event_type = 'error'").count()
    assert view(spark, SF, "fx_windows").count() == errors


def test_calls_and_edges_are_whole(spark):
    customers, suppliers = base(spark, SF, "customer"), base(spark, SF, "supplier")
    region = {r.n_nationkey: r.n_regionkey for r in base(spark, SF, "nation").collect()}
    of_c = {r.c_custkey: region[r.c_nationkey] for r in customers.collect()}
    of_s = {r.s_suppkey: region[r.s_nationkey] for r in suppliers.collect()}
    buyer = {r.o_orderkey: r.o_custkey for r in base(spark, SF, "orders").collect()}
    lines = base(spark, SF, "lineitem").select("l_orderkey", "l_suppkey").collect()
    want = {(buyer[o], s) for o, s in lines if of_c[buyer[o]] == of_s[s]}
    assert view(spark, SF, "fx_calls").count() == len(want)
    n = {r[0]: r[1] for r in view(spark, SF, "fx_edges").groupBy("relation").count().collect()}
    assert n == {"calls": len(want), "instance_of": len(of_s), "operation_of": len(of_c)}
    assert "user_id %" not in VIEWS["fx_seed"]


def test_each_system_sees_all_evidence(spark):
    from caseloom.plans.scores import _system_evidence

    n = {r["count"] for r in _system_evidence(spark, SF).groupBy("system").count().collect()}
    assert n == {view(spark, SF, "fx_evidence").count()}


def test_the_head_of_a_modality_is_1500_rows(spark):
    from caseloom.plans.evidence import modality_head

    n = {tuple(r)[:2]: r["count"] for r in view(spark, SF, "fx_obs").groupBy("case_id", "modality").count().collect()}
    got = {tuple(r)[:2]: r["count"] for r in modality_head(spark, SF).groupBy("case_id", "modality").count().collect()}
    assert got == {k: min(v, 1500) for k, v in n.items()}


def test_written_views_are_read_in_place_of_their_sql(spark):
    once = write_views(spark, SF, "fx_calls", "fx_truth")
    assert set(once.written) == {"fx_calls", "fx_truth"} and once == SF
    assert write_views(spark, once, "fx_calls").written["fx_calls"] == once.written["fx_calls"]
    for name in ("fx_calls", "fx_truth", "fx_edges", "fx_pred"):
        assert sorted(map(tuple, view(spark, once, name).collect()), key=str) == sorted(map(tuple, view(spark, SF, name).collect()), key=str)


def test_evidence_is_ranked_row_by_row_in_the_order_of_its_sql(spark):
    """The rank of the SQL, a window over all texts of a case, kept filters from the tables and sorted each case in one task."""
    from caseloom.plans.views import with_views

    view(spark, SF, "fx_evidence")  # opens the tables
    want = spark.sql(with_views("SELECT * FROM fx_evidence"))
    key = ("case_id", "modality", "row_ord", "entity_id", "text", "hybrid_score")
    of = lambda df: [tuple(r[c] for c in key) for r in df.orderBy("case_id", "rank", "entity_id", "text").collect()]
    got = view(spark, SF, "fx_evidence")
    assert got.where("rank is null").isEmpty() and of(got) == of(want)
    plan = got.where("modality = 'metrics'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "l_suppkey" in plan and "doc_id" not in plan and "event_id" not in plan


def test_rows_are_numbered_by_runs_of_keys(spark):
    """Numbers agree with the SQL's, whose window put all rows of a case and modality into one task."""
    from caseloom.plans.views import with_views

    got = view(spark, SF, "fx_rows")
    want = spark.sql(with_views("SELECT * FROM fx_rows"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    runs = view(spark, SF, "SELECT DISTINCT case_id, mod_ord, row_ord div 8192 FROM fx_obs").count()
    assert runs > view(spark, SF, "SELECT DISTINCT case_id, mod_ord FROM fx_obs").count()
    assert "row_number() windowspecdefinition(case_id" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "run#" in plan


@pytest.mark.parametrize("name", ["baseline_prompts", "coordinator_prompts"])
def test_prompts_read_the_events_once(spark, name):
    """Each system's requests were found anew in all events and customers."""
    from caseloom.plans import systems

    plan = getattr(systems, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_type" not in plan


@pytest.mark.parametrize("name", ["evidence_summary", "summary_shortlist"])
def test_texts_of_documents_are_not_shuffled_to_their_few_suppliers(spark, monkeypatch, name):
    """Where the table of suppliers was over the size of a broadcast, all texts went by ten keys to as many tasks."""
    from caseloom.operators import summarize

    seen, plain = [], summarize.log_bullets
    monkeypatch.setattr(summarize, "log_bullets", lambda e: (seen.append(e), plain(e))[1])
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        import __spark_entry__

        __spark_entry__.queries()[name](spark, SF)
        plan = seen[0].where("modality = 'logs'")._jdf.queryExecution().executedPlan().toString()
        by_key = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "doc_id" in x]
        assert "BroadcastHashJoin [(doc_id" in plan and not by_key
        logs = view(spark, SF, "fx_obs").where("modality = 'logs'")
        assert logs.count() == base(spark, SF, "documents").count() and logs.select("entity_id").distinct().count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_evidence_of_other_entities_is_dropped_before_the_views_join(spark, monkeypatch):
    """Lines, orders and events of every entity were joined, and at size shuffled, before all but those of the ranked ones were dropped."""
    from caseloom.operators import summarize

    seen, plain = [], summarize.log_bullets
    monkeypatch.setattr(summarize, "log_bullets", lambda e: (seen.append(e), plain(e))[1])
    evidence = view(spark, SF, "fx_evidence")
    rows = lambda: sorted(map(str, summarize.summary(evidence).collect()))
    got = rows()
    for modality, key, other in (("metrics", "l_suppkey", "s_suppkey"), ("traces", "o_custkey", "c_custkey"), ("events", "user_id", "c_custkey")):
        plan = seen[0].where(f"modality = '{modality}'")._jdf.queryExecution().optimizedPlan().toString()
        assert any("Filter (" in x and " INSET " in x and f"{key}#" in x and f"{other}#" not in x for x in plan.splitlines()), modality
    monkeypatch.setattr(summarize, "MOST_NAMED", 0)
    assert rows() == got and " INSET " not in seen[1].where("modality = 'traces'")._jdf.queryExecution().analyzed().toString()
