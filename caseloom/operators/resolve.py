"""Names to topology entities.

``index``: case_id, key, entity_id, pos. Names are resolved once each, by equality, then as
``service::operation``, then by containment; of several fitting keys the earliest wins.
Containment is an equi-join on substrings as long as a key, so names don't meet all keys of a case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import present
from ..session import stage


def name_index(entities: DataFrame) -> DataFrame:
    """Keys by lower-cased names and aliases.

    Writers stand in node order, a node's name before its alias. A name overwrites, an
    alias only fills; the place of a key is that of its first writer.
    """
    writers = entities.select(
        "case_id",
        "entity_id",
        F.explode(
            F.array(
                F.struct(F.lower(F.nullif("name", F.lit(""))).alias("key"), (F.col("ord") * 2).alias("pos"), F.lit(True).alias("named")),
                F.struct(
                    F.lower(present(F.col("pod_name"), F.col("service"))).alias("key"),
                    (F.col("ord") * 2 + 1).alias("pos"),
                    F.lit(False).alias("named"),
                ),
            )
        ).alias("w"),
    ).select("case_id", "entity_id", "w.*")
    by_name = F.max_by("entity_id", F.when(F.col("named"), F.col("pos")))
    by_alias = F.min_by("entity_id", F.when(~F.col("named"), F.col("pos")))
    return (
        writers.where("key is not null")
        .groupBy("case_id", "key")
        .agg(
            F.when(F.max(F.col("named").cast("int")) == 1, by_name).otherwise(by_alias).alias("entity_id"),
            F.min("pos").alias("pos"),
        )
    )


def exact(names: DataFrame, index: DataFrame) -> DataFrame:
    """(case_id, name) -> entity_id where the lower-cased name is a key."""
    lowered = names.where(F.col("name").rlike(r"\S")).withColumn("key", F.lower("name"))
    return lowered.join(index, ["case_id", "key"]).select("case_id", "name", "entity_id")


def _first_key(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("case_id", "name").agg(F.min_by("entity_id", "pos").alias("entity_id"))


def contained(small: DataFrame, large: DataFrame) -> DataFrame:
    """(case_id, small, large) where the non-empty text ``small`` stands in ``large``.

    An equi-join on the hash of substrings: a text of ``large`` has one for each place and each
    length that occurs in ``small`` of its case, however many texts have that length or share
    parts of it.
    """
    keys = small.select("case_id", "small").where("small <> ''").distinct()
    lengths = keys.groupBy("case_id").agg(F.collect_set(F.length("small")).alias("lengths"))  # no more than the longest key has characters
    text, at = F.col("large"), F.sequence
    cut = lambda n: F.transform(at(F.lit(1), F.length(text) - n + 1), lambda i: F.xxhash64(text.substr(i, n)))
    parts = F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length(text)), cut)))
    pieces = large.select("case_id", "large").distinct().join(lengths, "case_id").select("case_id", "large", F.explode(parts).alias("part"))
    found = pieces.join(keys.withColumn("part", F.xxhash64("small")), ["case_id", "part"])
    return found.where("contains(large, small)").select("case_id", "small", "large")


def composite(names: DataFrame, index: DataFrame) -> DataFrame:
    """``service::operation``: the first key with both parts, else the service itself."""
    key = F.lower("name")
    service = F.trim(F.substring_index(key, "::", 1))
    rest = key.substr(F.instr(key, "::") + 2, F.length(key))
    operation = F.regexp_extract(F.regexp_replace(F.trim(rest), "^/+", ""), "([^/]*)$", 1)
    parts = names.where(F.col("name").contains("::")).select("case_id", "name", service.alias("service"), operation.alias("operation"))
    longer = F.when(F.length("service") >= F.length("operation"), F.col("service")).otherwise(F.col("operation"))
    parts = parts.withColumn("small", longer)
    near = contained(parts, index.withColumnRenamed("key", "large")).withColumnRenamed("large", "key")
    fits = parts.join(near, ["case_id", "small"]).where("contains(key, service) and contains(key, operation)").join(index, ["case_id", "key"])
    # Without either part every key fits, so the first of the case does.
    first = index.groupBy("case_id").agg(F.min_by("entity_id", "pos").alias("entity_id"), F.min("pos").alias("pos"))
    empty = parts.where("small = ''").join(first, "case_id")
    both = _first_key(fits.select("case_id", "name", "entity_id", "pos").unionByName(empty.select("case_id", "name", "entity_id", "pos")))
    alone = parts.join(index.withColumnRenamed("key", "service"), ["case_id", "service"]).select(
        "case_id", "name", F.col("entity_id").alias("by_service")
    )
    return (
        both.join(alone, ["case_id", "name"], "full")
        .select("case_id", "name", F.coalesce("entity_id", "by_service").alias("entity_id"))
    )


def substring(names: DataFrame, index: DataFrame) -> DataFrame:
    """The first key that holds the name or is held by it."""
    lowered = names.where(F.col("name").rlike(r"\S")).withColumn("low", F.lower("name"))
    low, key = lowered.select("case_id", F.col("low").alias("small")), index.select("case_id", F.col("key").alias("small"))
    inside = contained(low, key.withColumnRenamed("small", "large")).selectExpr("case_id", "small as low", "large as key")
    around = contained(key, low.withColumnRenamed("small", "large")).selectExpr("case_id", "large as low", "small as key")
    pairs = lowered.join(inside.unionByName(around).distinct(), ["case_id", "low"]).join(index, ["case_id", "key"])
    return _first_key(pairs.select("case_id", "name", "entity_id", "pos"))


def resolve_entities(names: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (case_id, name) -> entity_id by the first way that finds one; else null.

    Index, names and what is left after each way are written, as several ways read them.
    """
    index = stage(index, "name-index")
    todo = stage(names.select("case_id", "name").distinct(), "names")
    key = ["case_id", "name"]
    found = stage(exact(todo, index), "names-exact")
    left = stage(todo.join(found, key, "left_anti"), "names-left")
    by_parts = stage(composite(left, index), "names-composite")
    by_text = substring(left.join(by_parts, key, "left_anti"), index)
    return todo.join(found.unionByName(by_parts).unionByName(by_text), key, "left")


def attach(rows: DataFrame, name_column: str, index: DataFrame) -> DataFrame:
    """``rows`` with entity_id of their name."""
    names = rows.select("case_id", F.col(name_column).alias("name")).where("name is not null")
    found = resolve_entities(names, index).withColumnRenamed("name", name_column)
    return rows.join(found, ["case_id", name_column], "left")


def unresolved_ids(observations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct non-empty observation ids that aren't topology nodes."""
    ids = observations.where("entity_id <> ''").select("case_id", "entity_id").distinct()
    return ids.join(nodes.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_anti")


def coverage(observations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of nodes, observations, resolved ones and unresolved ids per case."""
    seen = observations.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(F.col("entity_id") != "").alias("resolved")
    )
    size = nodes.groupBy("case_id").agg(F.countDistinct("entity_id").alias("nodes"))
    lost = unresolved_ids(observations, nodes).groupBy("case_id").agg(F.count(F.lit(1)).alias("unresolved_ids"))
    counts = size.join(seen, "case_id", "full").join(lost, "case_id", "full")
    return counts.select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "observations", "resolved", "unresolved_ids")])
