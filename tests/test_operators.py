"""Hand-built cases of the evidence operators; expected values by hand."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import normalize
from caseloom.operators import evaluate, graph, resolve, retrieve, summarize


def edges(spark, *pairs):
    return spark.createDataFrame([("c", a, b, "calls", i) for i, (a, b) in enumerate(pairs)], "case_id string, src string, dst string, relation string, ord long")


def entities(spark, *rows):
    rows = [("c", i, n, t, name, pod, None) for n, (i, t, name, pod) in enumerate(rows)]
    return spark.createDataFrame(rows, "case_id string, entity_id string, ord long, entity_type string, name string, pod_name string, service string")


def seed(spark, *ids):
    return spark.createDataFrame([("c", i) for i in ids], "case_id string, entity_id string")


def test_name_index_order(spark):
    e = entities(spark, ("e1", "x", "one", "x"), ("e2", "x", "X", None), ("e3", "x", "three", "x"))
    got = {r.key: (r.entity_id, r.pos) for r in resolve.name_index(e).collect()}
    assert got == {"one": ("e1", 0), "x": ("e2", 1), "three": ("e3", 4)}


def test_resolution_ways(spark):
    e = entities(spark, ("a", "x", "checkout::/demo.Checkout/PlaceOrder", None), ("b", "x", "checkout", None), ("c", "x", "pay", None))
    names = ["checkout::PlaceOrder", "checkout::", "checkout::nothing", "the pay service", "zzz", " ", "PAY"]
    got = {r.name: r.entity_id for r in resolve.resolve_entities(spark.createDataFrame([("c", n) for n in names], "case_id string, name string"), resolve.name_index(e)).collect()}
    assert got == {"checkout::PlaceOrder": "a", "checkout::": "a", "checkout::nothing": "b", "the pay service": "c", "zzz": None, " ": None, "PAY": "c"}


def test_search_is_bounded_and_undirected(spark):
    x = edges(spark, ("a", "b"), ("b", "a"), ("c", "b"), ("c", "d"), ("d", "e"))
    nodes = graph.nodes_of(entities(spark, ("a", "x", None, None)), x)
    inside = graph.candidate_nodes(nodes, x, seed(spark, "a"))
    assert {r.entity_id: r.hop for r in inside.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert graph.undirected(x).count() == 8
    assert {(r.src, r.dst) for r in graph.induced(x, inside).collect()} == {("a", "b"), ("b", "a"), ("c", "b"), ("c", "d")}
    assert graph.candidate_nodes(nodes, x, seed(spark, "foreign")).count() == 0


def test_pagerank_mass(spark):
    x = edges(spark, ("a", "b"), ("b", "c"))
    nodes = graph.nodes_of(entities(spark, ("a", "x", None, None)), x)
    for fixed in (7, None):
        got = {r.entity_id: r.score for r in graph.personalized_pagerank(nodes, x, seed(spark, "a"), iterations=fixed).collect()}
        assert sum(got.values()) == pytest.approx(1) and got["b"] > got["c"]
    alone = graph.personalized_pagerank(seed(spark, "s"), x.limit(0), seed(spark, "s")).collect()
    assert [(r.entity_id, r.score) for r in alone] == [("s", pytest.approx(1.0))]
    assert sum(r.score for r in graph.global_pagerank(nodes, x).collect()) == pytest.approx(1)


def test_rollup_and_membership(spark):
    e = entities(spark, ("s", "apm.service", "s", None), *[(f"n{i}", "x", None, None) for i in range(1, 5)])
    x = edges(spark, ("n1", "s"), ("n1", "n2"), ("n2", "n3"), ("n3", "n4"))
    up = {r.entity_id: r.service_id for r in graph.service_rollup(e, x).collect()}
    assert up == {"s": "s", "n1": "s", "n2": "s", "n3": "s", "n4": None}
    members = {(r.service_id, r.member_id) for r in graph.membership(e, graph.service_rollup(e, x)).collect()}
    assert ("n4", "n4") in members and ("s", "n3") in members
    near = graph.neighbours(x, seed(spark, "n1")).first()
    assert (near.upstream, near.downstream) == ([], ["n2", "s"])


OBS = "case_id string, modality string, mod_ord int, row_ord long, entity_id string, ts timestamp, text string, source_file string"


def obs(spark, *rows):
    return spark.createDataFrame([("c", "logs", 1, i, e, None, t, "f") for i, (e, t) in enumerate(rows)], OBS)


def test_filter_keeps_null_not_empty(spark):
    o = obs(spark, ("a", "1"), (None, "2"), ("", "3"), ("x", "4"), (None, "5"))
    assert {r.text for r in retrieve.topology_filter(o, seed(spark, "a")).collect()} == {"1", "2", "5"}
    assert {r.text for r in retrieve.topology_filter(o, seed(spark, "a"), 1).collect()} == {"1", "2"}


def test_first_query_wins_but_merging_keeps_the_best(spark):
    rows = [("c", "f", "a", None, "t", 1, 0, 1, 0.3), ("c", "f", "a", None, "t", 2, 1, 1, 0.9)]
    e = spark.createDataFrame(rows, "case_id string, source_file string, entity_id string, ts timestamp, text string, query_ord int, list_ord int, rank int, hybrid_score double")
    assert [r.hybrid_score for r in retrieve.first_query_wins(e).collect()] == [0.3]
    best = retrieve.merge(e)
    assert [r.hybrid_score for r in best.collect()] == [0.9] and [r.hybrid_score for r in retrieve.merge(best).collect()] == [0.9]


def test_observations_are_combined_by_digest(spark):
    schema = "case_id string, source_file string, entity_id string, ts timestamp, text string, query_ord int, list_ord int, rank int, hybrid_score double"
    rows = [("c", "f", e, None, t, 1, 0, 1, 0.5) for e, t in ((None, "a"), ("", "a"), ("a", None), ("a", ""), (None, "a"))]
    e = spark.createDataFrame(rows, schema)
    assert retrieve.merge(e).count() == 4  # null and empty differ
    plan = retrieve.merge(e)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(__same" in plan
    micro = spark.sql("SELECT 'c' AS case_id, 'f' AS source_file, 'a' AS entity_id, timestamp_micros(m) AS ts, 't' AS text, 1 AS query_ord, 0 AS list_ord, 1 AS rank, 0.5D AS hybrid_score FROM VALUES (1L), (2L), (2L) x(m)")
    assert retrieve.first_query_wins(micro).count() == 2


def test_few_unwanted_observations_reach_the_join(spark):
    o = spark.range(20_000).selectExpr("'c' as case_id", "case when id % 50 = 0 then null else concat('e', id) end as entity_id", "id")
    ids = spark.range(300).selectExpr("'c' as case_id", "concat('e', id * 60 + 1) as entity_id")
    kept = retrieve.maybe_wanted(o, ids)
    exact = o.join(ids, ["case_id", "entity_id"], "left_semi")
    assert exact.count() > 200 and exact.join(kept, "id", "left_anti").isEmpty()
    assert kept.count() <= exact.count() + 40 and kept.columns == o.columns
    assert retrieve.maybe_wanted(o, ids.limit(0)).isEmpty()


def test_window_ends_count(spark):
    o = spark.sql("SELECT 'c' AS case_id, m, timestamp'2024-01-01 12:00:00' + make_interval(0,0,0,0,0,m) AS ts FROM VALUES (-16), (-15), (0), (15), (16), (NULL) t(m)")
    c = spark.sql("SELECT 'c' AS case_id, 1 AS centre_id, timestamp'2024-01-01 12:00:00' AS centre")
    assert sorted(r.m for r in normalize.in_window(o, c).collect()) == [-15, 0, 15]


def test_cosine_can_be_negative_and_k_can_exceed(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, query array<double>")
    assert [(r.vec_id, r.score) for r in retrieve.cosine_topk(q, v, 5).orderBy("rank").collect()] == [(1, 1.0), (2, -1.0)]


EVID = "case_id string, entity_id string, modality string, mod_ord int, text string, hybrid_score double, rank int"


def test_summary_bullets(spark):
    rows = [
        ("c", "a", "logs", 1, "[log:] x error", 0.9, 1), ("c", "a", "logs", 1, "fine", 0.8, 2), ("c", "a", "metrics", 0, "[metric] m=1", 0.7, 3), ("c", "a", "metrics", 0, "[metric] m=1", 0.6, 4),
        ("c", "a", "traces", 2, "duration=1500.0ms", 0.5, 5), ("c", "", "events", 3, "[event:W] up", 0.4, 6), ("c", None, "alerts", 4, "[alert:firing] down", 0.3, 7), ("c", "b", "logs", 1, "quiet", 0.2, 8),
    ]
    s = summarize.summary(spark.createDataFrame(rows, EVID))
    got = {r.entity_id: r.bullets for r in s.collect()}
    assert got["a"] == ["Error/exception patterns in 1/2 retrieved log lines", "Metric observed: m=1", "1 span(s) with error/timeout status among retrieved traces"]
    assert got["unresolved"] == ["[event:W] up", "Alert stage [firing] down"] and got["b"] == [summarize.NO_SIGNAL]
    text = summarize.summary_text(s).first().summary_text
    assert text.startswith("a\n  • Error/exception") and summarize.flat_text(s).first().summary_text.startswith("a: Error/")
    assert {r.entity_id for r in summarize.modality_view(s, "span").collect()} == {"a"}
    assert summarize.modality_view(s, "no such word").count() == 3


def test_only_evidence_of_the_best_entities_becomes_bullets(spark, monkeypatch):
    """Bullets of every entity were made and shuffled, and the names of every entity, though a summary has eight."""
    rows = [("c", f"e{i:02}" if i < 30 else None, "metrics", 0, f"[metric] m={i % 7}", float(i), 100 - i) for i in range(31)]
    rows += [("d", "e01", "events", 3, "[event:W] up", 0.1, 1), ("c", "e01", "events", 3, "[event:W] down", 0.1, 101)]
    seen, plain = [], summarize.metric_bullets
    monkeypatch.setattr(summarize, "metric_bullets", lambda e: (seen.append(e), plain(e))[1])
    s = summarize.summary(spark.createDataFrame(rows, EVID))
    got = {(r.case_id, r.entity_rank): (r.entity_id, r.bullets) for r in s.collect()}
    best = ["unresolved", *[f"e{i:02}" for i in range(29, 22, -1)]]
    assert got == {("c", i + 1): (e, [f"Metric observed: m={(30 - i) % 7}"]) for i, e in enumerate(best)} | {("d", 1): ("e01", ["[event:W] up"])}
    assert sorted(r.entity_id for r in seen[0].where("case_id = 'c'").collect()) == sorted(best)
    names = spark.createDataFrame([("c", "e29", "the best"), ("d", "e29", "another"), ("d", "e02", "none")], "case_id string, entity_id string, name string")
    text = summarize.summary_text(s, names)
    assert {r.case_id: r.summary_text.split("\n")[2 if r.case_id == "c" else 0] for r in text.collect()} == {"c": "the best", "d": "e01"}
    assert text._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1


def test_answers_are_parsed(spark):
    raw = ['{"a": 1}', 'say {"a": 2} end', "no json", "} {", None]
    got = [(r.parsed, r.parse_error) for r in summarize.parse_response(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()]
    assert got == [('{"a": 1}', False), ('{"a": 2}', False), (None, True), (None, True), (None, True)]


def test_scores(spark):
    results = spark.createDataFrame([("c", "s", ["p"], ["cause: x y", "z"]), ("c", "none", [], [])], "case_id string, system string, predicted_entity_ids array<string>, reasoning_chain array<string>")
    targets = spark.createDataFrame([("c", ["t"])], "case_id string, targets array<string>")
    for hop, score in ((5, 0.0312), (14, 0.0001), (15, 0.0)):
        lengths = spark.createDataFrame([("c", "p", hop)], "case_id string, entity_id string, hop int")
        got = {r.system: r.entity_localization for r in evaluate.entity_localization(results, targets, lengths).collect()}
        assert got == {"s": score, "none": 0.0}
    same = spark.createDataFrame([("c", ["p"])], "case_id string, targets array<string>")
    assert evaluate.entity_localization(results, same, lengths.limit(0)).where("system = 's'").first().entity_localization == 1.0
    truth = spark.createDataFrame([("c", ["cause: x"])], "case_id string, chain array<string>")
    chain = {r.system: r.chain_overlap for r in evaluate.chain_overlap(results, truth).collect()}
    assert chain == {"s": pytest.approx(1 / 4), "none": 0.0}
    f = lambda p, t: spark.range(1).select(evaluate.fault_match(F.lit(p), F.lit(t)).alias("x")).first().x
    assert f(" F1-slowSQL ", "f1-slowsql") == f("slowsql", "F1-slowSQL") == f("it is slowSQL!", "F1-slowSQL") == f("any", "f1-") == 1.0 and f("other", "F1-slowSQL") == 0.0


def test_error_rows_stay_and_are_left_out_of_means(spark):
    cases, systems = spark.createDataFrame([("a",), ("b",)], "case_id string"), spark.createDataFrame([("s",)], "system string")
    report = spark.createDataFrame([("a", "s", 1.0, 1.0, 1.0, 1.0)], "case_id string, system string, entity_localization double, fault_identification double, reasoning_process double, final_score double")
    errors = spark.createDataFrame([("b", "s", "boom")], "case_id string, system string, error string")
    grid = evaluate.system_grid(cases, systems, report, errors)
    assert {(r.case_id, r.error, r.final_score) for r in grid.collect()} == {("a", None, 1.0), ("b", "boom", None)}
    assert evaluate.leaderboard(grid).first().final_score == 1.0


def test_shortlist_by_text(spark):
    d = spark.createDataFrame([("F1-disk", "disk writes are slow"), ("F2-dns", "lookups fail"), ("F3-cpu", "cpu is busy")], "slug string, definition string")
    t = spark.createDataFrame([("a", "slow disk, slow writes"), ("b", " "), ("c", "cpu and dns lookups fail")], "case_id string, text string")
    got = [(r.case_id, r.slug) for r in retrieve.shortlist(t, d, 2).orderBy("case_id", "rank").collect()]
    assert got == [("a", "F1-disk"), ("a", "F2-dns"), ("c", "F2-dns"), ("c", "F3-cpu")]


def test_ranking_falls_back_to_the_whole_graph(spark):
    x = edges(spark, ("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"))
    nodes = graph.nodes_of(entities(spark, ("a", "x", None, None)), x)
    inside, scores = graph.ranked_entities(nodes, x, seed(spark, "a"), hops=2)
    assert {r.entity_id for r in inside.collect()} == {"a", "b", "c"}
    assert scores.where("rank = 1").first().graph_score == 1.0
    for lost in (None, "foreign"):
        inside, scores = graph.ranked_entities(nodes, x, spark.createDataFrame([("c", lost)], "case_id string, entity_id string"))
        assert {r.entity_id for r in inside.collect()} == {"a", "b", "c", "d", "x", "y"}
        want = graph.top_scores(graph.global_pagerank(nodes, x))
        assert [(r.entity_id, r.score) for r in scores.orderBy("rank").collect()] == [(r.entity_id, pytest.approx(r.score)) for r in want.orderBy("rank").collect()]


def test_pagerank_tries_again_with_a_wider_tolerance(spark):
    x = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(12)])
    nodes = graph.nodes_of(entities(spark, ("n0", "x", None, None)), x)
    got = graph.personalized_pagerank(nodes, x, seed(spark, "n0"), max_iterations=10, tolerance=0.0, retry=(40, 1e-4))
    want = graph.personalized_pagerank(nodes, x, seed(spark, "n0"), max_iterations=40, tolerance=1e-4, retry=None)
    assert {r.entity_id: r.score for r in got.collect()} == pytest.approx({r.entity_id: r.score for r in want.collect()})


def test_ends_meet_in_the_middle(spark, monkeypatch):
    x = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(16)], ("y", "z"))
    rounds, step = [], graph._next
    monkeypatch.setattr(graph, "_next", lambda *a: rounds.append(1) or step(*a))
    lengths = lambda *ids: {r.entity_id: r.hop for r in graph.path_lengths(x, seed(spark, *ids), seed(spark, "n0", "z")).collect()}
    assert lengths("n0", "n3", "n14", "n15", "gone") == {"n0": 0, "n3": 3, "n14": 14} and len(rounds) == 7
    rounds.clear()
    assert lengths("n0", "y", "gone") == {"n0": 0, "y": 1} and len(rounds) == 1
    rounds.clear()
    assert lengths("gone") == {} and not rounds  # without an edge: not waited for
    odd = graph.path_lengths(x, seed(spark, "n3", "n4"), seed(spark, "n0"), hops=3)
    assert {r.entity_id: r.hop for r in odd.collect()} == {"n3": 3}


def test_a_round_shuffles_the_frontier_only(spark):
    pairs = graph.written(graph.undirected(edges(spark, ("a", "b"), ("b", "c"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph._next(pairs, seed(spark, "a"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert {r.entity_id for r in graph._next(pairs, seed(spark, "b")).collect()} == {"a", "c"}


def ring(n, case="c"):
    """A ring with chords and a few nodes that lead nowhere."""
    arcs = [(i, (i + 1) % n) for i in range(n)] + [(i, (i * 7 + 3) % n) for i in range(0, n, 3)]
    return [(case, f"{case}{a:03d}", f"{case}{b:03d}") for a, b in arcs if a != b and a % 11 != 5]


def test_whole_graph_ranking_runs_to_the_tolerance(spark):
    rows = ring(24) + ring(7, "d") + [("e", "e0", "e1")]
    x = spark.createDataFrame(rows, "case_id string, src string, dst string")
    nodes = graph.nodes_of(spark.createDataFrame([("c", "alone")], "case_id string, entity_id string"), x)
    got = {r.entity_id: r.score for r in graph.global_pagerank(nodes, x).collect()}
    want, took = {}, {}
    for case in "cde":
        own = sorted({a for c, *ab in rows if c == case for a in ab} | ({"alone"} if case == "c" else set()))
        out = {a: sorted({t for c, s, t in rows if s == a}) for a in own}
        score = dict.fromkeys(own, 1 / len(own))
        for took[case] in range(1, 101):
            was, score = score, dict.fromkeys(own, 0.0)
            lost = sum(was[a] for a in own if not out[a])
            for a in own:
                for b in out[a]:
                    score[b] += 0.85 * was[a] / len(out[a])
            score = {a: v + (0.85 * lost + 0.15) / len(own) for a, v in score.items()}
            if sum(abs(score[a] - was[a]) for a in own) < len(own) * 1e-6:
                break
        want |= score
    assert len(set(took.values())) > 1 and got == pytest.approx(want, rel=1e-9)


def test_forward_push_is_exact_and_joins_few_nodes(spark):
    rows = ring(24) + [("c", "c000", f"leaf{i}") for i in range(30)] + [("d", "d0", "d1")]
    x = spark.createDataFrame(rows, "case_id string, src string, dst string")
    starts = spark.createDataFrame([("c", "c010"), ("d", "d0"), ("e", "e0")], "case_id string, entity_id string")
    nodes = graph.nodes_of(spark.createDataFrame([("e", "e0")], "case_id string, entity_id string"), x)
    sizes = []
    got = graph.push_pagerank(nodes, x, starts, k=5, tolerance=1e-6, pushed=lambda df: sizes.append(df.where("case_id = 'c'").count()))
    got = {r.entity_id: r.score for r in got.collect()}
    near = {"e0": {"e0"}}  # a node without a neighbour sends its mass to the seed, here itself
    for _, a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for _ in range(200):
        was, want = want, {i: 0.15 * (i in ("c010", "d0", "e0")) for i in near}
        for a, ends in near.items():
            for b in ends:
                want[b] += 0.85 * was[a] / len(ends)
    assert got == pytest.approx(want, abs=1e-4) and got["e0"] == pytest.approx(1.0)
    size = sum(k.startswith(("c", "leaf")) for k in want)
    assert sizes[0] == 1 and sum(sizes) < 0.8 * size * len(sizes)


def test_keys_that_share_their_parts_meet_only_their_own_names(spark):
    """Ten thousand keys of the same pieces: a name meets the keys that it holds or stands in, no others."""
    keys = spark.range(10_000).selectExpr("'c' as case_id", "format_string('node-%05d', id) as small")
    names = spark.range(10_000).where("id % 10 = 0").selectExpr("'c' as case_id", "format_string('the node-%05d.x', id) as large")
    got = resolve.contained(keys, names)
    assert got.count() == 1000 and got.where("contains(large, small)").count() == 1000
    back = resolve.contained(names.withColumnRenamed("large", "small"), keys.withColumnRenamed("small", "large"))
    assert back.count() == 0
    odd = spark.createDataFrame([("c", ""), ("c", "é日"), ("d", "é日")], "case_id string, small string")
    held = resolve.contained(odd, spark.createDataFrame([("c", "xé日é日"), ("c", ""), ("d", "é")], "case_id string, large string"))
    assert [tuple(r) for r in held.collect()] == [("c", "é日", "xé日é日")]


def test_names_stand_in_for_target_ids(spark):
    schema = "case_id string, target_entity_ids array<string>, target_entities array<struct<entity_id:string,entity_name:string>>"
    truth = spark.createDataFrame([("a", None, [("", "pay")]), ("b", [], [("e1", "pay")]), ("c", ["e2"], [("e1", "pay")]), ("d", None, None)], schema)
    found = spark.createDataFrame([("e", 0, "x")], "case_id string, pos int, entity_id string")
    assert {r.case_id: r.targets for r in evaluate.target_ids(truth, found).collect()} == {"a": ["pay"], "b": ["e1"], "c": ["e2"], "d": []}


def test_checkpoints_meet_evidence_without_a_shuffle_of_texts(spark):
    from caseloom.operators import evaluate

    points = spark.createDataFrame([("a", "CPU"), ("a", "disk"), ("a", ""), ("b", None)], "case_id string, signal string")
    evidence = spark.createDataFrame(
        [("a", "s", "high cpu here"), ("a", "t", None), ("b", "s", "x"), ("c", "s", "cpu")], "case_id string, system string, text string"
    )
    out = evaluate.checkpoint_hits(points, evidence)
    assert {tuple(r) for r in out.collect()} == {("a", "s", 1 / 3), ("a", "t", 0.0), ("b", "s", 0.0), ("c", "s", 0.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    signals = [r for r in plan.splitlines() if "Join" in r]
    executed = out._jdf.queryExecution().executedPlan().toString()
    assert len(signals) == 1 and "BroadcastHashJoin" in executed and "SortMergeJoin" not in executed


def test_scores_of_a_large_graph_are_not_sent_to_the_driver(spark, monkeypatch):
    """Written scores are few bytes on disk, so each round broadcast them, however many rows there were."""
    seen = []
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(graph, "stage", lambda df, label, real=graph.stage: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df, label))[1])
    nodes = spark.createDataFrame([("c", x) for x in "abcd"], "case_id string, entity_id string")
    edges = spark.createDataFrame([("c", *x) for x in ("ab", "ac", "cd", "da")], "case_id string, src string, dst string")
    got = {r.entity_id: r.score for r in graph.global_pagerank(nodes, edges, iterations=3).collect()}
    monkeypatch.undo()
    assert got == pytest.approx({r.entity_id: r.score for r in graph.global_pagerank(nodes, edges, iterations=3).collect()})
    rounds = [p for p in seen if "was#" in p]
    assert len(rounds) == 3 and all(p.count("ShuffledHashJoin") >= 2 for p in rounds)
