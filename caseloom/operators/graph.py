"""Graph operators over all cases at once: bounded search and PageRank.

``edges``: case_id, src, dst (directed). ``seeds``: case_id, entity_id. Loops run on the
driver, one join and one sum per round, and cut their lineage at written tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, stage_by

#: Rows of scores (ids and a number) up to which a round broadcasts them; beyond that it joins by shuffle.
BROADCAST_ROWS = 200_000


def nodes_of(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities and the ends of edges, which may have no entity."""
    ends = edges.select("case_id", F.explode(F.array("src", "dst")).alias("entity_id"))
    return entities.select("case_id", "entity_id").unionByName(ends).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    one = edges.select("case_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    return one.unionByName(one.select("case_id", F.col("b").alias("a"), F.col("a").alias("b")))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each pair, once."""
    return both_ways(edges).distinct()


def written(pairs: DataFrame) -> DataFrame:
    """Pairs (case_id, a, b), once each, as a table bucketed by (case_id, a): a round of a search shuffles its frontier only."""
    return stage_by(pairs.select("case_id", "a", "b"), "pairs", "case_id", "a", within=lambda df: df.distinct())


def bfs(pairs: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(case_id, entity_id, origin, hop): nodes within ``hops`` of any seed, each once.

    ``pairs`` as ``written`` gives them. ``seeds`` may carry ``rank``; of seeds at equal distance
    the smallest rank, then the smallest id, is a node's origin.
    """
    if "rank" not in seeds.columns:
        seeds = seeds.withColumn("rank", F.lit(0).cast("bigint"))
    start = seeds.select("case_id", "entity_id", F.col("entity_id").alias("origin"), F.col("rank").cast("bigint").alias("rank")).distinct()
    seen = frontier = stage(start.withColumn("hop", F.lit(0)), "bfs")
    for hop in range(1, hops + 1):
        step = (
            _next(pairs, frontier, "origin", "rank")
            .groupBy("case_id", "entity_id")
            .agg(F.min(F.struct("rank", "origin")).alias("o"))
            .join(seen.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_anti")
            .select("case_id", "entity_id", "o.origin", "o.rank", F.lit(hop).alias("hop"))
        )
        frontier = stage(step, "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("case_id", "entity_id", "origin", "hop")


def _next(pairs: DataFrame, frontier: DataFrame, *carried: str) -> DataFrame:
    """Neighbours of the frontier; the pairs are streamed past it, bucket by bucket or past a broadcast."""
    a = frontier.select("case_id", F.col("entity_id").alias("a"), *carried).hint("shuffle_hash")
    return pairs.join(a, ["case_id", "a"]).select("case_id", F.col("b").alias("entity_id"), *carried)


def candidate_nodes(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """Nodes within ``hops`` undirected steps of the case's seed; none for a foreign seed."""
    here = seeds.join(nodes, ["case_id", "entity_id"], "left_semi")
    return bfs(written(both_ways(edges)), here, hops).select("case_id", "entity_id", "hop")


def induced(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Directed edges with both ends inside."""
    for end in ("src", "dst"):
        edges = edges.join(inside.select("case_id", F.col("entity_id").alias(end)), ["case_id", end], "left_semi")
    return edges


def _links(nodes: DataFrame, edges: DataFrame, one: DataFrame) -> DataFrame:
    """(case_id, a, b, degree), both ways; a node without a neighbour is linked to its seed (``one``: case_id, b)."""
    pairs = undirected(edges)
    degree = pairs.groupBy("case_id", "a").agg(F.count(F.lit(1)).alias("degree"))
    alone = nodes.select("case_id", F.col("entity_id").alias("a")).join(degree, ["case_id", "a"], "left_anti").join(one, "case_id")
    linked = pairs.join(degree, ["case_id", "a"]).select("case_id", "a", "b", "degree").unionByName(alone.withColumn("degree", F.lit(1).cast("bigint")))
    return stage_by(linked, "ppr", "case_id", "a")


def inside_links(pairs: DataFrame, inside: DataFrame, seeds: DataFrame) -> DataFrame:
    """The links of ``_links`` among the nodes ``inside``, from ``written`` pairs: these are shuffled once.

    Pairs go both ways, so what is left of them after their first ends have met ``inside`` may be read the other way round.
    """
    ends = inside.select("case_id", F.col("entity_id").alias("a")).distinct()
    half = pairs.join(ends.hint("shuffle_hash"), ["case_id", "a"], "left_semi").select("case_id", F.col("b").alias("a"), F.col("a").alias("b"))
    degree = F.count(F.lit(1)).over(_case("a"))
    links = stage_by(half, "ppr", "case_id", "a", within=lambda df: df.join(ends.hint("shuffle_hash"), ["case_id", "a"], "left_semi").select("case_id", "a", "b", degree.alias("degree")))
    one = seeds.select("case_id", F.col("entity_id").alias("b")).distinct()
    alone = stage(ends.join(links, ["case_id", "a"], "left_anti").join(one, "case_id").select("case_id", "a", "b", F.lit(1).cast("bigint").alias("degree")), "alone")
    return links if alone.isEmpty() else stage_by(links.unionByName(alone), "ppr", "case_id", "a")


def push_pagerank(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, k: int = 15, tolerance: float = 1e-6, most: int = 1000,
    pushed: Callable[[DataFrame], None] | None = None, links: DataFrame | None = None,
) -> DataFrame:
    """(case_id, entity_id, score) of each case's nodes, all restarts at the seed, by forward push.

    Mass starts as residual at the seed. A round takes the nodes that hold a quarter of the mean
    residual or more (so three quarters of it all): 1 - ``alpha`` of theirs is score, the rest goes
    on to their neighbours. Only these nodes meet the links. What residual is left in a case bounds
    the error of each of its scores. A case ends when that is no more than its number of nodes times
    ``tolerance`` and less than the gap after its ``k``-th score (where that is a tie: a tenth
    of it); it is looked at every five rounds, and left out once it has ended. ``pushed`` is given
    the pushing nodes of each round; ``links`` are ``inside_links`` of the nodes, where they are there already.
    """
    one = seeds.select("case_id", F.col("entity_id").alias("b")).distinct()
    links = _links(nodes, edges, one) if links is None else links
    key = ["case_id", "entity_id"]
    at_seed = one.select("case_id", F.col("b").alias("entity_id"), F.lit(1.0).alias("rest"))
    state = stage(nodes.select(*key).distinct().join(at_seed, key, "left").select(*key, F.lit(0.0).alias("score"), F.coalesce("rest", F.lit(0.0)).alias("rest")), "push")
    sizes = stage(state.groupBy("case_id").agg(F.count(F.lit(1)).alias("size")), "push-sizes")
    ended = []
    for n in range(1, most + 1):
        mean = state.where("rest > 0").groupBy("case_id").agg((F.sum("rest") / F.count(F.lit(1)) / 4).alias("least"))
        marked = state.join(mean, "case_id", "left")
        moving = marked.where((F.col("rest") > 0) & (F.col("rest") >= F.col("least")))
        if pushed is not None:
            pushed(moving)
        a = moving.select("case_id", F.col("entity_id").alias("a"), "rest").hint("shuffle_hash")
        sent = links.join(a, ["case_id", "a"]).select("case_id", F.col("b").alias("entity_id"), F.lit(0.0).alias("score"), (alpha * F.col("rest") / F.col("degree")).alias("rest"))
        pushes = (F.col("rest") > 0) & (F.col("rest") >= F.col("least"))
        kept = marked.select(
            *key, F.when(pushes, F.col("score") + (1 - alpha) * F.col("rest")).otherwise(F.col("score")).alias("score"), F.when(pushes, 0.0).otherwise(F.col("rest")).alias("rest")
        )
        state = stage(kept.unionByName(sent).groupBy(*key).agg(F.sum("score").alias("score"), F.sum("rest").alias("rest")), "push")
        if n % 5 == 0 or n == most:
            still = stage(_certain(state, sizes, k, tolerance), "push-ended") if n < most else state.select("case_id").distinct()
            if not still.isEmpty():
                ended.append(state.join(still, "case_id", "left_semi"))
                state = stage(state.join(still, "case_id", "left_anti"), "push")
                if state.isEmpty():
                    break
    for part in ended:
        state = state.unionByName(part)
    return state.select(*key, (F.col("score") + F.col("rest")).alias("score"))


def _certain(state: DataFrame, sizes: DataFrame, k: int, tolerance: float) -> DataFrame:
    """Cases whose residual leaves their scores, and what follows the k-th, certain enough."""
    from pyspark.sql import Window

    total = F.col("score") + F.col("rest")
    rest = state.groupBy("case_id").agg(F.sum("rest").alias("rest"))
    order = Window.partitionBy("case_id").orderBy(F.desc("total"), "entity_id")
    near = state.select("case_id", "entity_id", total.alias("total")).withColumn("n", F.row_number().over(order)).where(F.col("n").between(k, k + 1))
    gap = near.groupBy("case_id").agg(F.when(F.count(F.lit(1)) == 2, F.max("total") - F.min("total")).otherwise(F.lit(2.0)).alias("gap"))
    small = F.col("size") * tolerance
    return rest.join(sizes, "case_id").join(gap, "case_id", "left").where(
        (F.col("rest") <= small) & ((F.col("rest") < F.coalesce("gap", F.lit(2.0))) | (F.col("rest") <= small / 10))
    ).select("case_id")


def personalized_pagerank(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int | None = None,
    max_iterations: int = 200, tolerance: float = 1e-6, retry: tuple[int, float] | None = (1000, 1e-4), links: DataFrame | None = None,
) -> DataFrame:
    """(case_id, entity_id, score) of each case's nodes, all restarts at the seed.

    Edges are walked both ways; a node without a neighbour sends its mass to the seed.
    ``iterations`` fixes the number of rounds; else rounds go on until, looked at every ten
    rounds, no case moves more than its node count times ``tolerance``. Cases that still
    move after ``max_iterations`` start again with the rounds and tolerance of ``retry``. ``links`` as in
    ``push_pagerank``.
    """
    one = seeds.select("case_id", F.col("entity_id").alias("b")).distinct()
    links = _links(nodes, edges, one) if links is None else links
    restart = one.select("case_id", F.col("b").alias("entity_id"), F.lit(1 - alpha).alias("score"))
    size = F.count(F.lit(1)).over(_case())
    rank = stage(nodes.select("case_id", "entity_id", (1 / size).alias("score")), "ppr")
    small = F.broadcast if rank.count() <= BROADCAST_ROWS else lambda df: df
    done, most = 0, iterations if iterations is not None else max_iterations
    while done < most:
        last = rank
        for i in range(min(10, most - done)):
            last = rank
            sent = links.join(small(rank.select("case_id", F.col("entity_id").alias("a"), "score")), ["case_id", "a"]).select(
                "case_id", F.col("b").alias("entity_id"), (alpha * F.col("score") / F.col("degree")).alias("score")
            )
            rank = sent.unionByName(restart).groupBy("case_id", "entity_id").agg(F.sum("score").alias("score"))
            done += 1
            if i % 5 == 4 or done == most:  # each round reads the one before once, so a few can be one plan
                rank = stage(rank, "ppr")
            elif i == 8:
                rank = stage(rank, "ppr")  # the last round is compared with this one
        if iterations is None:
            moved = rank.join(last.withColumnRenamed("score", "was"), ["case_id", "entity_id"]).groupBy("case_id").agg(
                F.sum(F.abs(F.col("score") - F.col("was"))).alias("moved"), F.count(F.lit(1)).alias("size")
            )
            moving = stage(moved.where(F.col("moved") >= F.col("size") * tolerance).select("case_id"), "moving")
            if moving.isEmpty():
                return rank
    if iterations is None and retry is not None:
        only = [df.join(moving, "case_id", "left_semi") for df in (nodes, edges, seeds)]
        again = personalized_pagerank(*only, alpha=alpha, max_iterations=retry[0], tolerance=retry[1], retry=None)
        rank = rank.join(moving, "case_id", "left_anti").unionByName(again)
    return rank


def ranked_entities(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int = 15, hops: int = 3, iterations: int | None = None, pairs: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes around each case's seed (case_id, entity_id), and its ``top_scores``.

    Where the seed is null or isn't a node, all nodes of the case count and are ranked by
    the directed PageRank of the whole graph. ``seeds`` has one row for each case; ``pairs``
    are the undirected edges where they are ``written`` already.
    """
    edges = edges.select("case_id", "src", "dst")
    nodes = stage(nodes.select("case_id", "entity_id").distinct(), "nodes")
    seeds = stage(seeds.select("case_id", "entity_id"), "seeds")
    here = seeds.join(nodes, ["case_id", "entity_id"], "left_semi")
    lost = seeds.select("case_id").join(here, "case_id", "left_anti").distinct()
    pairs = written(both_ways(edges)) if pairs is None else pairs
    inside = stage(bfs(pairs, here, hops).select("case_id", "entity_id"), "inside")
    around, links = induced(edges, inside), inside_links(pairs, inside, here)
    ranked = push_pagerank(inside, around, here, k=k, links=links) if iterations is None else personalized_pagerank(inside, around, here, iterations=iterations, links=links)
    if not lost.isEmpty():
        whole = nodes.join(lost, "case_id", "left_semi")
        ranked = ranked.unionByName(global_pagerank(whole, edges.join(lost, "case_id", "left_semi")).select(*ranked.columns))
        inside = inside.unionByName(whole)
    return inside, stage(top_scores(ranked, k), "scores")


def global_pagerank(
    nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int | None = None, max_iterations: int = 100, tolerance: float = 1e-6
) -> DataFrame:
    """Directed PageRank, restarts and the mass of sinks spread over the case's nodes.

    A case ends with the first round in which its scores move by less than its number of nodes
    times ``tolerance`` in all, or with ``max_iterations``; it is then left out of further
    rounds. ``iterations`` fixes the number of rounds instead.
    """
    arcs = edges.select("case_id", "src", "dst").distinct()
    degree = arcs.groupBy("case_id", F.col("src").alias("entity_id")).agg(F.count(F.lit(1)).alias("degree"))
    size = F.count(F.lit(1)).over(_case())
    base = stage(
        nodes.join(degree, ["case_id", "entity_id"], "left").select(
            "case_id", "entity_id", F.coalesce("degree", F.lit(0)).alias("degree"), size.alias("size")
        ),
        "pagerank",
    )
    links = stage_by(arcs.join(base.select("case_id", F.col("entity_id").alias("src"), "degree"), ["case_id", "src"]), "pagerank", "case_id", "src")
    rank = base.select("case_id", "entity_id", (1 / F.col("size")).alias("score"))
    # Beyond that the written scores, which are few bytes on disk, would still be sent to the driver in each round.
    small = F.broadcast if base.count() <= BROADCAST_ROWS else lambda df: df.hint("shuffle_hash")
    ended = []
    for _ in range(max_iterations if iterations is None else iterations):
        sent = (
            links.join(small(rank.select("case_id", F.col("entity_id").alias("src"), "score")), ["case_id", "src"])
            .groupBy("case_id", F.col("dst").alias("entity_id"))
            .agg(F.sum(F.col("score") / F.col("degree")).alias("got"))
        )
        state = base.join(small(rank.withColumnRenamed("score", "was")), ["case_id", "entity_id"])
        lost = state.where("degree = 0").groupBy("case_id").agg(F.sum("was").alias("lost"))
        new = alpha * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("size")) + (1 - alpha) / F.col("size")
        now = state.join(sent, ["case_id", "entity_id"], "left").join(lost, "case_id", "left")
        rank = stage(now.select("case_id", "entity_id", new.alias("score"), "was"), "pagerank")
        if iterations is None:
            moved = rank.groupBy("case_id").agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("moved"), F.count(F.lit(1)).alias("size"))
            still = stage(moved.where(F.col("moved") < F.col("size") * tolerance).select("case_id"), "still")
            if not still.isEmpty():
                ended.append(rank.join(still, "case_id", "left_semi"))
                rank = stage(rank.join(still, "case_id", "left_anti"), "pagerank")
                if rank.isEmpty():
                    break
        rank = rank.drop("was")
    for part in ended:
        rank = rank.drop("was").unionByName(part.drop("was"))
    return rank


def _case(*more: str):
    from pyspark.sql import Window

    return Window.partitionBy("case_id", *more)


def top_scores(ranked: DataFrame, k: int = 15) -> DataFrame:
    """The k best of each case (score, then id), divided by the case's best.

    Scores that differ by the order of their sums only are ties.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("case_id").orderBy(F.desc(F.round("score", 12)), "entity_id")
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    most = F.coalesce(F.nullif(F.max("score").over(_case()), F.lit(0.0)), F.lit(1.0))
    return top.select("case_id", "entity_id", "rank", "score", (F.col("score") / most).alias("graph_score"))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sorted callers (upstream) and dependencies (downstream) of each seed."""
    s = seeds.select("case_id", "entity_id")
    up = edges.join(s.withColumnRenamed("entity_id", "dst"), ["case_id", "dst"]).groupBy("case_id").agg(F.sort_array(F.collect_set("src")).alias("upstream"))
    down = edges.join(s.withColumnRenamed("entity_id", "src"), ["case_id", "src"]).groupBy("case_id").agg(F.sort_array(F.collect_set("dst")).alias("downstream"))
    none = F.array().cast("array<string>")
    return s.join(up, "case_id", "left").join(down, "case_id", "left").select(
        "case_id", "entity_id", F.coalesce("upstream", none).alias("upstream"), F.coalesce("downstream", none).alias("downstream")
    )


def service_rollup(entities: DataFrame, edges: DataFrame, hops: int = 3, pairs: DataFrame | None = None) -> DataFrame:
    """(case_id, entity_id, service_id): the nearest service within ``hops``, itself if it is one.

    One search from all services; ties by (hop, order of the service, id); null if none.
    ``pairs`` are the undirected edges where they are ``written`` already.
    """
    services = entities.where("entity_type = 'apm.service'").select("case_id", "entity_id", F.col("ord").alias("rank"))
    near = bfs(written(both_ways(edges)) if pairs is None else pairs, services, hops).select("case_id", "entity_id", F.col("origin").alias("service_id"))
    return nodes_of(entities, edges).join(near, ["case_id", "entity_id"], "left")


def membership(entities: DataFrame, rollup: DataFrame) -> DataFrame:
    """(case_id, service_id, member_id, member_ord): nodes under their service, else under themselves."""
    order = entities.select("case_id", "entity_id", F.col("ord").alias("member_ord"))
    last = F.lit(2**62)
    return rollup.join(order, ["case_id", "entity_id"], "left").select(
        "case_id", F.coalesce("service_id", "entity_id").alias("service_id"), F.col("entity_id").alias("member_id"),
        F.coalesce("member_ord", last).alias("member_ord"),
    )


def path_lengths(edges: DataFrame, predicted: DataFrame, targets: DataFrame, hops: int = 14) -> DataFrame:
    """(case_id, entity_id, hop): undirected distance of predicted ids to the nearest target.

    Searches from both ends meet in the middle: after n rounds all distances up to 2n are known,
    so ``hops`` need half as many rounds. It ends when every id with an edge has met a target.
    Beyond 14 hops the score that uses it rounds to zero.
    """
    pairs = written(both_ways(edges))
    key = ["case_id", "entity_id"]
    ends = pairs.select("case_id", F.col("a").alias("entity_id")).distinct()
    asked = stage(predicted.select(*key).distinct(), "asked")
    goal = targets.select(*key).distinct()
    # Ids without an edge reach themselves only, so they aren't waited for.
    waiting = stage(asked.join(ends, key, "left_semi").join(goal.select("case_id").distinct(), "case_id", "left_semi"), "waiting")
    own = asked.select(*key, F.col("entity_id").alias("origin"))
    seen = frontier = stage(own.unionByName(goal.select(*key, F.lit(None).cast("string").alias("origin"))).withColumn("hop", F.lit(0)), "both-ends")
    place = ["case_id", "entity_id", "origin"]
    for hop in range(1, (hops + 1) // 2 + 1):
        if waiting.join(_met(seen, hops), key, "left_anti").isEmpty():
            break
        side = frontier if 2 * hop <= hops else frontier.where("origin is not null")
        fresh = _next(pairs, side, "origin").distinct().alias("n")
        old = F.expr("n.case_id = s.case_id and n.entity_id = s.entity_id and n.origin <=> s.origin")
        frontier = stage(fresh.join(seen.alias("s"), old, "left_anti").select(*place, F.lit(hop).alias("hop")), "both-ends")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return _met(seen, hops)


def _met(seen: DataFrame, hops: int) -> DataFrame:
    """Shortest ways from an origin to a target (rows without an origin) by way of a node that both have reached."""
    here = seen.where("origin is not null").select("case_id", "entity_id", "origin", F.col("hop").alias("h"))
    there = seen.where("origin is null").select("case_id", "entity_id", "hop")
    met = here.join(there, ["case_id", "entity_id"]).groupBy("case_id", F.col("origin").alias("entity_id")).agg(F.min(F.col("h") + F.col("hop")).alias("hop"))
    return met.where(F.col("hop") <= hops)
