"""The chain of hybrid evidence: what is moved for it, and the order of rows that share a key."""

import os

import pytest
from pyspark.sql import functions as F

from caseloom.operators import graph, hybrid, retrieve

SF = "/root/testdata/sf0.001"
OBS = "case_id string, modality string, mod_ord int, row_ord long, entity_id string, ts timestamp, text string, source_file string"


def some_obs(spark, n=3000):
    """Rows of entities e0 to e49 and without one; three rows share each row_ord."""
    kinds = ["logs", "metrics", "events", "traces"]
    rows = [("c", kinds[i % 4], i % 4, i // 12, None if i % 90 == 0 else f"e{i * 7 % 50}", None, f"{'slow' if i % 3 else 'fast'} call {i % 5} {'xyz'[i % 3] * (i % 4)}", "f") for i in range(n)]
    return spark.createDataFrame(rows, OBS)


def by_row_number(obs):
    from pyspark.sql import Window

    return obs.withColumn("row_ord", F.row_number().over(Window.partitionBy("case_id", "mod_ord").orderBy(*hybrid.row_order())).cast("long"))


def chain(spark, obs, **more):
    entities = spark.createDataFrame([("c", f"e{i}", i, "apm.service" if i % 10 == 0 else "x") for i in range(50)], "case_id string, entity_id string, ord long, entity_type string")
    edges = spark.createDataFrame([("c", f"e{i}", f"e{i // 2}") for i in range(1, 50)], "case_id string, src string, dst string")
    alerts = spark.createDataFrame([("c", "e9", "slow xyz calls, never fast")], "case_id string, entry_entity_id string, alert_text string")
    return hybrid.hybrid_evidence(obs, entities, edges, alerts, iterations=2, **more)


def seen(evidence):
    return sorted((tuple(r[c] for c in ("modality", "entity_id", "text", "rank")) + (round(r.hybrid_score, 9),) for r in evidence.collect()), key=str)


def test_rows_with_one_key_come_in_the_order_of_entity_and_text(spark, monkeypatch):
    """A row_ord that several rows have was taken for one row."""
    monkeypatch.setattr(hybrid, "SPARE", 1, raising=False)  # so that some queries are asked again
    obs = some_obs(spark)
    evidence, counts = chain(spark, obs)
    want, known = chain(spark, by_row_number(obs))
    assert seen(evidence) == seen(want)
    assert [tuple(r) for r in counts.collect()] == [tuple(r) for r in known.collect()]


def test_only_hits_are_written_with_their_text(spark, monkeypatch):
    """All rows of the entities around an alert were shuffled and written once more."""
    written = {}

    def noted(module):
        real = module.stage
        monkeypatch.setattr(module, "stage", lambda df, label, *a: written.setdefault(label, real(df, label, *a)))

    for module in (hybrid, retrieve):
        noted(module)
    obs = some_obs(spark)
    chain(spark, obs)
    with_text = {label: df.count() for label, df in written.items() if "text" in df.columns and "uid" in df.columns or label == "kept"}
    assert with_text.pop("obs") == obs.count()
    assert with_text and max(with_text.values()) < 600


def test_search_inside_finds_what_search_finds_among_the_rows_inside(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "SPARE", 1)
    obs = by_row_number(some_obs(spark, 600))
    queries = spark.createDataFrame([("c", 0, "slow xxx"), ("c", 1, "zz fast"), ("c", 2, "nothing")], "case_id string, query_ord int, text string")
    inside = spark.createDataFrame([("c", "e7"), ("c", "e21"), ("c", "gone")], "case_id string, entity_id string")
    key = ("query_ord", "rank", "mod_ord", "row_ord")
    want = hybrid.search(retrieve.topology_filter(obs, inside), queries, 9)
    got = hybrid.search_inside(hybrid.told_apart(obs), inside, queries, 9)
    assert sorted(tuple(r[c] for c in key) for r in got.collect()) == sorted(tuple(r[c] for c in key) for r in want.collect())


def test_links_inside_are_shuffled_once(spark):
    edges = spark.createDataFrame([("c", "a", "b"), ("c", "b", "a"), ("c", "b", "b"), ("c", "b", "d"), ("c", "d", "e"), ("x", "s", "t")], "case_id string, src string, dst string")
    inside = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "d"), ("x", "s")], "case_id string, entity_id string")
    seeds = spark.createDataFrame([("c", "a"), ("x", "s")], "case_id string, entity_id string")
    got = graph.inside_links(graph.written(graph.both_ways(edges)), inside, seeds)
    one = seeds.select("case_id", F.col("entity_id").alias("b"))
    want = graph._links(inside, graph.induced(edges, inside), one)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_rows_are_numbered_as_their_view_numbers_them(spark):
    from caseloom.plans.systems import numbered
    from caseloom.plans.views import view

    obs = hybrid.told_apart(view(spark, SF, "fx_obs"))
    some = obs.where("uid % 17 = 0").drop("uid", "place")
    whole = view(spark, SF, "fx_rows")
    key = ["case_id", "modality", "row_ord", "entity_id", "text"]
    got = {tuple(r) for r in numbered(some, obs).select(*key).collect()}
    assert some.count() and len(got) <= some.count()
    assert got <= {tuple(r) for r in whole.select(*key).collect()}
    at = {(r.case_id, r.row_ord) for r in numbered(some, obs).where("mod_ord = 1").collect()}
    assert len(at) == some.where("mod_ord = 1").count()
