"""Queries of the graph operators (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import query
from .views import view, write_views

PAIRS = "SELECT case_id, src AS a, dst AS b FROM fx_edges UNION SELECT case_id, dst, src FROM fx_edges"
NODES = "SELECT case_id, entity_id FROM fx_entities UNION SELECT case_id, src FROM fx_edges UNION SELECT case_id, dst FROM fx_edges"


def reach(name: str, start: str, hops: int) -> str:
    """CTEs of a bounded search: ``name`` has case_id, entity_id, origin, ord, hop, once per node."""
    out = [f"pairs AS MATERIALIZED ({PAIRS})", f"{name}0 AS MATERIALIZED ({start})"]
    for h in range(1, hops + 1):
        out.append(
            f"{name}{h} AS MATERIALIZED (SELECT * FROM {name}{h - 1} UNION ALL SELECT case_id, entity_id, o.origin, o.ord, {h} FROM ("
            f"SELECT p.case_id, p.b AS entity_id, min({{'ord': f.ord, 'origin': f.origin}}) AS o FROM {name}{h - 1} f JOIN pairs p ON p.case_id = f.case_id AND p.a = f.entity_id "
            f"WHERE f.hop = {h - 1} GROUP BY p.case_id, p.b) n WHERE NOT EXISTS (SELECT 1 FROM {name}{h - 1} s WHERE s.case_id = n.case_id AND s.entity_id = n.entity_id))"
        )
    return ",\n".join(out)


SEEDS = "SELECT case_id, entity_id, entity_id AS origin, CAST(0 AS BIGINT) AS ord, 0 AS hop FROM fx_seed"
SERVICES = "SELECT case_id, entity_id, entity_id AS origin, ord, 0 AS hop FROM fx_entities WHERE entity_type = 'apm.service'"
INSIDE = f"{reach('r', SEEDS, 3)}, ins AS (SELECT case_id, entity_id, hop FROM r3)"
INDUCED = "ie AS MATERIALIZED (SELECT e.* FROM fx_edges e JOIN ins a ON a.case_id = e.case_id AND a.entity_id = src JOIN ins b ON b.case_id = e.case_id AND b.entity_id = dst)"


def ppr_sql(iterations: int) -> str:
    """Unrolled rounds of PageRank with restarts at the seed, on the induced subgraph."""
    ctes = [
        INSIDE, INDUCED,
        "ip AS MATERIALIZED (SELECT case_id, src AS a, dst AS b FROM ie UNION SELECT case_id, dst, src FROM ie)",
        "dg AS MATERIALIZED (SELECT case_id, a AS entity_id, count(*) AS d FROM ip GROUP BY case_id, a)",
        "k0 AS MATERIALIZED (SELECT i.case_id, i.entity_id, coalesce(d, 0) AS d, CASE WHEN hop = 0 THEN 1.0::DOUBLE ELSE 0 END AS seed, 1.0::DOUBLE / count(*) OVER (PARTITION BY i.case_id) AS score FROM ins i LEFT JOIN dg ON dg.case_id = i.case_id AND dg.entity_id = i.entity_id)",
    ]
    for k in range(1, iterations + 1):
        ctes.append(
            f"k{k} AS MATERIALIZED (SELECT k.case_id, k.entity_id, k.d, k.seed, 0.85::DOUBLE * coalesce(got, 0) + (0.15::DOUBLE + 0.85::DOUBLE * coalesce(lost, 0)) * seed AS score FROM k{k - 1} k "
            f"LEFT JOIN (SELECT p.case_id, p.b, sum(score / d) AS got FROM ip p JOIN k{k - 1} f ON f.case_id = p.case_id AND f.entity_id = p.a GROUP BY p.case_id, p.b) g ON g.case_id = k.case_id AND g.b = k.entity_id "
            f"LEFT JOIN (SELECT case_id, sum(score) AS lost FROM k{k - 1} WHERE d = 0 GROUP BY case_id) l ON l.case_id = k.case_id)"
        )
    return "WITH " + ",\n".join(ctes)


def pagerank_sql(iterations: int) -> str:
    ctes = [
        f"n AS MATERIALIZED (SELECT case_id, entity_id, count(*) OVER (PARTITION BY case_id) AS size FROM ({NODES}) x)",
        "arc AS MATERIALIZED (SELECT DISTINCT case_id, src, dst FROM fx_edges)",
        "dg AS MATERIALIZED (SELECT case_id, src AS entity_id, count(*) AS d FROM arc GROUP BY case_id, src)",
        "k0 AS MATERIALIZED (SELECT n.*, coalesce(d, 0) AS d, 1.0::DOUBLE / size AS score FROM n LEFT JOIN dg ON dg.case_id = n.case_id AND dg.entity_id = n.entity_id)",
    ]
    for k in range(1, iterations + 1):
        ctes.append(
            f"k{k} AS MATERIALIZED (SELECT k.case_id, k.entity_id, k.size, k.d, 0.85::DOUBLE * (coalesce(got, 0) + coalesce(lost, 0) / size) + 0.15::DOUBLE / size AS score FROM k{k - 1} k "
            f"LEFT JOIN (SELECT a.case_id, a.dst, sum(score / d) AS got FROM arc a JOIN k{k - 1} f ON f.case_id = a.case_id AND f.entity_id = a.src GROUP BY a.case_id, a.dst) g ON g.case_id = k.case_id AND g.dst = k.entity_id "
            f"LEFT JOIN (SELECT case_id, sum(score) AS lost FROM k{k - 1} WHERE d = 0 GROUP BY case_id) l ON l.case_id = k.case_id)"
        )
    return "WITH " + ",\n".join(ctes)


def _graph(spark, sf):
    sf = write_views(spark, sf, "fx_calls")
    e, x, s = (view(spark, sf, v) for v in ("fx_entities", "fx_edges", "fx_seed"))
    nodes = graph.nodes_of(e, x)
    inside = graph.candidate_nodes(nodes, x, s)
    return e, x, s, nodes, inside


def _ppr(spark, sf, iterations):
    _, x, s, _, inside = _graph(spark, sf)
    return graph.personalized_pagerank(inside.select("case_id", "entity_id"), graph.induced(x, inside), s, iterations=iterations)


@query(PAIRS)
def undirected_edges(spark, sf):
    return graph.undirected(view(spark, sf, "fx_edges"))


@query(f"WITH {INSIDE} SELECT case_id, entity_id, hop FROM ins")
def bfs_hops(spark, sf):
    return _graph(spark, sf)[4]


@query(f"WITH {INSIDE}, {INDUCED} SELECT case_id, src, dst, relation FROM ie")
def induced_edges(spark, sf):
    _, x, _, _, inside = _graph(spark, sf)
    return graph.induced(x, inside).select("case_id", "src", "dst", "relation")


@query(f"{ppr_sql(10)} SELECT case_id, entity_id, round(score, 9) AS score FROM k10")
def ppr_fixed_iter(spark, sf):
    return _ppr(spark, sf, 10).withColumn("score", F.round("score", 9))


@query(f"{ppr_sql(100)} SELECT case_id, entity_id, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 12) DESC, entity_id) AS n FROM k100) t WHERE n <= 3")
def ppr_topk(spark, sf):
    """By forward push until the third place is certain; the three best of each case."""
    _, x, s, _, inside = _graph(spark, sf)
    top = graph.top_scores(graph.push_pagerank(inside.select("case_id", "entity_id"), graph.induced(x, inside), s, k=3), 3)
    return top.select("case_id", "entity_id", F.round("score", 3).alias("score"))


@query(f"{pagerank_sql(20)} SELECT case_id, entity_id, round(score, 9) AS score FROM k20")
def pagerank_global(spark, sf):
    sf = write_views(spark, sf, "fx_calls")
    e, x = view(spark, sf, "fx_entities"), view(spark, sf, "fx_edges")
    return graph.global_pagerank(graph.nodes_of(e, x), x, iterations=20).withColumn("score", F.round("score", 9))


@query(f"{ppr_sql(10)}, t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 12) DESC, entity_id) AS rank FROM k10) SELECT case_id, entity_id, rank, round(score / max(score) OVER (PARTITION BY case_id), 6) AS graph_score FROM t WHERE rank <= 15")
def graph_scores(spark, sf):
    return graph.top_scores(_ppr(spark, sf, 10)).select("case_id", "entity_id", "rank", F.round("graph_score", 6).alias("graph_score"))


@query("""SELECT s.case_id, s.entity_id, (SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM fx_edges e WHERE e.case_id = s.case_id AND dst = s.entity_id) AS upstream,
(SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM fx_edges e WHERE e.case_id = s.case_id AND src = s.entity_id) AS downstream FROM fx_seed s""")
def neighbors(spark, sf):
    n = graph.neighbours(view(spark, sf, "fx_edges"), view(spark, sf, "fx_seed"))
    return n.select("case_id", "entity_id", *[F.when(F.size(c) > 0, F.concat_ws(",", c)).alias(c) for c in ("upstream", "downstream")])


ROLLUP = f"{reach('v', SERVICES, 3)}, roll AS (SELECT n.case_id, n.entity_id, v3.origin AS service_id FROM ({NODES}) n LEFT JOIN v3 ON v3.case_id = n.case_id AND v3.entity_id = n.entity_id)"


@query(f"WITH {ROLLUP} SELECT * FROM roll")
def service_rollup(spark, sf):
    sf = write_views(spark, sf, "fx_calls")
    return graph.service_rollup(view(spark, sf, "fx_entities"), view(spark, sf, "fx_edges"))


@query(f"WITH {ROLLUP} SELECT r.case_id, coalesce(service_id, r.entity_id) AS service_id, r.entity_id AS member_id, e.ord AS member_ord FROM roll r JOIN fx_entities e ON e.case_id = r.case_id AND e.entity_id = r.entity_id")
def membership(spark, sf):
    sf = write_views(spark, sf, "fx_calls")
    e = view(spark, sf, "fx_entities")
    return graph.membership(e, graph.service_rollup(e, view(spark, sf, "fx_edges")))


TARGETS = "SELECT case_id, target AS entity_id, target AS origin, CAST(0 AS BIGINT) AS ord, 0 AS hop FROM fx_truth"


@query(f"WITH {reach('t', TARGETS, 14)} SELECT DISTINCT p.case_id, predicted AS entity_id, hop FROM fx_pred p JOIN t14 ON t14.case_id = p.case_id AND t14.entity_id = predicted")
def path_length(spark, sf):
    sf = write_views(spark, sf, "fx_calls", "fx_truth", "fx_pred")
    p = view(spark, sf, "fx_pred").select("case_id", F.col("predicted").alias("entity_id"))
    t = view(spark, sf, "fx_truth").select("case_id", F.col("target").alias("entity_id"))
    return graph.path_lengths(view(spark, sf, "fx_edges"), p, t)
