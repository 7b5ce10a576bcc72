"""Connected components of a link table, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, label), label the smallest node reachable.

    Each round moves every node to the smallest of its neighbours and itself, and keeps
    the links between different places. A star is done in one round, a chain at least
    halves. Minima are summed before the shuffle, so a hot node is one row per task.
    """
    edges = stage(links.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        moved = stage(both.groupBy("a").agg(F.min("b").alias("b")).selectExpr("a as node", "least(a, b) as label"), "moved")
        to = [moved.selectExpr(f"node as {x}", f"label as {x}_to") for x in "ab"]
        edges = stage(
            reduce(lambda df, t: df.join(t, t.columns[0]), to, edges)
            .where("a_to <> b_to")
            .selectExpr("least(a_to, b_to) as a", "greatest(a_to, b_to) as b")
            .distinct(),
            "links",
        )
        if labels is None:
            labels = moved
        else:
            step = moved.selectExpr("node as label", "label as next")
            labels = stage(
                labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels"
            )
    return labels if labels is not None else edges.selectExpr("a as node", "b as label")
