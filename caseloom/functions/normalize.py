"""Raw telemetry of five kinds to one observation table.

Each takes raw rows with case_id and row_ord, and the name index; stateless, so that each
runs on a stream's rows too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import attach
from .scalars import epoch_timestamp, first_valid, iso_timestamp, json_map, log_level, number_text, present

#: Modalities in their order; it decides ties later on.
MODALITIES = ("metrics", "logs", "traces", "events", "alerts")


def _shape(df: DataFrame, modality: str, ts: Column, text: Column) -> DataFrame:
    return df.select(
        "case_id",
        F.lit(modality).alias("modality"),
        F.lit(MODALITIES.index(modality)).alias("mod_ord"),
        F.col("row_ord").cast("bigint").alias("row_ord"),
        "entity_id",
        ts.alias("ts"),
        text.alias("text"),
        F.lit(modality).alias("source_file"),
    )


def _or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def metrics(raw: DataFrame, index: DataFrame) -> DataFrame:
    """Given entity id, else by service or entity name; the label prefers the entity name."""
    named = raw.withColumn("__name", first_valid(F.col("service"), F.col("entity_name"))).withColumn(
        "__given", first_valid(F.col("entity_id"))
    )
    found = attach(named.drop("entity_id"), "__name", index).withColumn("entity_id", F.coalesce("__given", "entity_id"))
    label = F.coalesce(first_valid(F.col("entity_name"), F.col("service")), F.lit(""))
    fractional = raw.schema["value"].dataType.simpleString() in ("double", "float")
    value = number_text(F.col("value")) if fractional else F.coalesce(F.col("value").cast("string"), F.lit("None"))
    text = F.concat(F.lit("[metric] "), label, F.lit(" "), F.coalesce(F.col("metric").cast("string"), F.lit("None")), F.lit("="), value)
    return _shape(found, "metrics", epoch_timestamp(F.col("time"), "us"), text)


def logs(raw: DataFrame, index: DataFrame) -> DataFrame:
    content = F.coalesce(first_valid(F.col("content")), F.lit(""))
    text = F.concat(F.lit("[log:"), log_level(content), F.lit("] "), _or_empty(F.col("_container_name_")), F.lit(": "), content)
    return _shape(attach(raw, "_container_name_", index), "logs", iso_timestamp(F.col("_time_")), text)


def traces(raw: DataFrame, index: DataFrame) -> DataFrame:
    """Durations in ms with three decimals; codes 0, 1, 2 by name, others as they are."""
    code = F.col("statusCode")
    status = F.when(code == "0", "UNSET").when(code == "1", "OK").when(code == "2", "ERROR").otherwise(_or_empty(code))
    ms = F.coalesce(F.col("duration").cast("string").try_cast("double"), F.lit(None).cast("double")) / 1e6
    message = F.when((status == "ERROR") & (F.col("statusMessage") != ""), F.concat(F.lit(" msg="), F.col("statusMessage")))
    text = F.concat(
        F.lit("[span] "), _or_empty(F.col("serviceName")), F.lit("."), _or_empty(F.col("spanName")), F.lit(" duration="),
        F.coalesce(F.format_string("%.3f", ms), F.lit("None")), F.lit("ms status="), status, F.coalesce(message, F.lit("")),
    )
    return _shape(attach(raw, "serviceName", index), "traces", epoch_timestamp(F.col("startTime"), "ns"), text)


def events(raw: DataFrame, index: DataFrame) -> DataFrame:
    body = json_map(F.col("eventId"))
    ts = iso_timestamp(present(body["lastTimestamp"], body["firstTimestamp"]))
    text = F.concat(
        F.lit("[event:"), _or_empty(F.col("level")), F.lit("] "), _or_empty(body["reason"]), F.lit(" — "), _or_empty(body["message"])
    )
    return _shape(attach(raw, "pod_name", index), "events", ts, text)


def alerts(raw: DataFrame) -> DataFrame:
    """The entity stands in the row's own JSON; it isn't looked up."""
    found = raw.withColumn("entity_id", F.get_json_object("resource", "$.entity.entity_id"))
    message = F.coalesce(F.get_json_object("annotations", "$.message"), F.lit(""))
    text = F.concat(
        F.lit("[alert:"), _or_empty(F.col("status")), F.lit("] "), _or_empty(F.col("subject")), F.lit(" — "), message
    )
    return _shape(found, "alerts", F.coalesce(epoch_timestamp(F.col("timestamp"), "ms"), iso_timestamp(F.col("time"))), text)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def in_window(observations: DataFrame, centres: DataFrame, minutes: int = 15) -> DataFrame:
    """Observations within ``minutes`` of a centre of their case, both ends included."""
    c = centres.select("case_id", "centre_id", F.col("centre").alias("__c"))
    span = F.expr(f"INTERVAL {minutes} MINUTES")
    # Slots as long as the window make the range join an equi-join: each row fits three slots.
    width = minutes * 60
    slot = lambda x: F.floor(F.unix_micros(x) / (width * 1_000_000))
    left = observations.where("ts is not null").withColumn("__slot", slot(F.col("ts")))
    right = c.where("__c is not null").withColumn("__slot", F.explode(F.sequence(slot(F.col("__c")) - 1, slot(F.col("__c")) + 1)))
    near = left.join(right, ["case_id", "__slot"]).where((F.col("ts") >= F.col("__c") - span) & (F.col("ts") <= F.col("__c") + span))
    return near.drop("__slot", "__c")


def rebind_alerts(alerts_ctx: DataFrame, nodes: DataFrame, index: DataFrame) -> DataFrame:
    """An entry that isn't a node is looked up by its name; without success it stays."""
    known = nodes.select("case_id", F.col("entity_id").alias("entry_entity_id"), F.lit(True).alias("__node")).distinct()
    flagged = alerts_ctx.join(known, ["case_id", "entry_entity_id"], "left")
    names = flagged.where("__node is null").select("case_id", F.col("entity_name").alias("name")).where("name is not null")
    found = resolve_lookup(names, index)
    out = flagged.join(found, ["case_id", "entity_name"], "left")
    entry = F.when(F.col("__node"), F.col("entry_entity_id")).otherwise(F.coalesce("__found", "entry_entity_id"))
    return out.withColumn("entry_entity_id", entry).drop("__node", "__found")


def resolve_lookup(names: DataFrame, index: DataFrame) -> DataFrame:
    from ..operators.resolve import resolve_entities

    return resolve_entities(names, index).withColumnRenamed("name", "entity_name").withColumnRenamed("entity_id", "__found")
