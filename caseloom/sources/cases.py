"""Readers of a benchmark's files, and the sinks of results and vectors.

A benchmark folder holds one folder per case. Readers take all cases at once: case_id comes
from the path, row order from the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import iso_timestamp, json_map, present, tag_attribute

#: Fixed column names of the telemetry files.
TELEMETRY = {
    "metrics": "entity_id string, entity_name string, service string, metric string, value double, time long",
    "logs": "_container_name_ string, _time_ string, content string",
    "traces": "serviceName string, spanName string, startTime string, endTime string, duration string, statusCode string, statusMessage string",
    "events": "eventId string, pod_name string, level string",
    "alerts": "resource string, annotations string, timestamp string, time string, status string, subject string",
}
#: Keys that may hold the edge list, in the order they are looked at.
EDGE_KEYS = ("edges", "relations", "links", "calls", "dependencies")
SRC, DST = ("src", "source", "from", "source_id", "caller"), ("dst", "target", "to", "target_id", "callee")
RELATION = ("relation", "relation_type", "type")
_EXPECTED = "struct<comparator:string,value:string,unit:string>"
_STEP = f"struct<step:string,step_type:string,target:string,fault_id:string,description:string,observability:array<struct<source_type:string,signal:string,expected:{_EXPECTED}>>>"
TRUTH = (
    "outcome struct<expected_fault_id:string,target_entity_ids:array<string>,target_entities:array<struct<entity_id:string,"
    f"entity_name:string,entity_type:string>>,expected_conclusion:string>, reasoning struct<steps:array<{_STEP}>>"
)


def _case_of(path: Column, up: int) -> Column:
    """The name ``up`` steps from the end of a path, without its endings."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -up), r"^([^.]*)", 1)


def read_manifest(spark: SparkSession, path: str, n_cases: int | None = None) -> DataFrame:
    """Case ids in file order, blank lines dropped: ord, case_id."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    out = lines.select("ord", F.regexp_replace("line", r"^\s+|\s+$", "").alias("case_id")).where("case_id <> ''")
    return out if n_cases is None else out.orderBy("ord").limit(n_cases)


def telemetry_files(spark: SparkSession, root: str, modality: str) -> DataFrame:
    """case_id, path, columns (array of name, type): what each file of one kind holds, as its footer says.

    The files are listed by Spark; footers are read in tasks, by ``pyarrow.fs``.
    """
    listed = spark.read.format("binaryFile").load(f"{root}/*/{modality}.parquet").select("path")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                store, inside = fs.FileSystem.from_uri(path)
                with store.open_input_file(inside) as f:
                    found.append(_footer(pq.ParquetFile(f)))
            kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["path", "columns"])

    found = listed.mapInArrow(footers, "path string, columns array<struct<name:string,type:string>>")
    return found.select(_telemetry_case(F.col("path"), modality).alias("case_id"), "path", "columns")


def _footer(file: pq.ParquetFile) -> list[dict[str, str]]:
    """Columns of a file as Spark reads them: INT96, which arrow calls nanoseconds too, are times, not numbers."""
    leaves = [file.schema.column(i) for i in range(len(file.schema))]
    old = {c.path for c in leaves if c.physical_type == "INT96"}
    return [{"name": c.name, "type": "timestamp" if c.name in old else _spark_type(c.type)} for c in file.schema_arrow]


def _spark_type(t: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    if pa.types.is_timestamp(t) and t.unit == "ns":
        return NANOS
    return from_arrow_type(t).simpleString()


#: Times in nanoseconds (64 bits), which Spark reads as numbers.
NANOS = "timestamp in ns"


def _telemetry_case(path: Column, modality: str) -> Column:
    return F.regexp_extract(path, rf"([^/]+)/{modality}\.parquet", 1)


def read_telemetry(spark: SparkSession, root: str, modality: str) -> DataFrame:
    """Raw rows of one kind for all cases, missing columns null: case_id, row_ord, columns.

    Files need not agree on their columns' types: they are grouped by the types that they have,
    each group is read as it is and cast to the common types (what can't be cast is null, times
    become microseconds). There are as many groups as combinations of types, mostly one.
    """
    wanted = [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(TELEMETRY[modality])]
    known = F.filter("columns", lambda c: c["name"].isin([n for n, _ in wanted]))
    groups = telemetry_files(spark, root, modality).groupBy(F.array_sort(known).alias("columns")).agg(F.collect_list("path").alias("paths"))
    out = None
    for group in groups.collect():  # the list of paths is on the driver anyway, to be read
        types = {c["name"]: c["type"] for c in group["columns"]}
        read_as = {n: types.get(n, t).replace(NANOS, "bigint") for n, t in wanted}
        df = spark.read.schema(", ".join(f"`{n}` {t}" for n, t in read_as.items())).parquet(*group["paths"])
        columns = [_common(F.col(f"`{n}`"), types.get(n, t), t).alias(n) for n, t in wanted]
        at = _telemetry_case(F.col("_metadata.file_path"), modality)
        part = df.select(at.alias("case_id"), F.col("_metadata.row_index").alias("row_ord"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def _common(c: Column, given: str, wanted: str) -> Column:
    if given == wanted:
        return c
    if given == NANOS:
        c, given = F.timestamp_micros(F.floor(c / 1000).cast("bigint")), "timestamp"
    if given.startswith("timestamp") and wanted == "bigint":
        return F.unix_micros(c.cast("timestamp"))
    if given in ("double", "float") and wanted == "string":  # whole numbers that a missing value turned into fractions
        return F.coalesce(F.when(c == F.floor(c), F.floor(c).cast("string")), c.cast("string"))
    if given == "string" and wanted == "bigint":
        return F.coalesce(c.try_cast("bigint"), F.floor(c.try_cast("double")))
    return c.try_cast(wanted)


def parse_topology(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges from (case_id, value), value the JSON text of a topology.

    Of a repeated id the last attributes count, at its first place. Edges without an end
    are dropped; of repeated edges the last relation counts.
    """
    parsed = raw.select("case_id", F.try_parse_json("value").alias("v"))
    get = lambda c, k, t="string": F.try_variant_get(c, f"$.{k}", t)
    e = parsed.select("case_id", F.posexplode(get(F.col("v"), "entities", "array<variant>")).alias("ord", "x")).select(
        "case_id", "ord", F.struct(*[get(F.col("x"), k).alias(k) for k in ("id", "type", "name")], get(F.col("x"), "props", "map<string,string>").alias("props")).alias("n")
    ).where("n.id is not null")
    entities = e.groupBy("case_id", F.col("n.id").alias("entity_id")).agg(F.max_by("n", "ord").alias("n"), F.min("ord").cast("bigint").alias("ord"))
    props = F.coalesce(F.col("n.props"), F.create_map().cast("map<string,string>"))
    entities = entities.select(
        "case_id", "entity_id", "ord", F.coalesce("n.type", F.lit("unknown")).alias("entity_type"), "n.name",
        props["pod_name"].alias("pod_name"), props["service"].alias("service"), props.alias("attributes"),
    )
    chosen = F.coalesce(*[get(F.col("v"), k, "array<variant>") for k in EDGE_KEYS])
    x = parsed.select("case_id", F.posexplode(chosen).alias("ord", "e"))
    pick = lambda names: present(*[get(F.col("e"), c) for c in names])
    edges = x.select("case_id", "ord", pick(SRC).alias("src"), pick(DST).alias("dst"), F.coalesce(pick(RELATION), F.lit("related_to")).alias("relation"))
    edges = edges.where("src is not null and dst is not null").groupBy("case_id", "src", "dst").agg(
        F.max_by("relation", "ord").alias("relation"), F.min("ord").cast("bigint").alias("ord")
    )
    return entities, edges


def read_topology(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.text(f"{root}/*/topology.json", wholetext=True)
    return parse_topology(raw.select(_case_of(F.col("_metadata.file_path"), 2).alias("case_id"), "value"))


def parse_tasks(raw: DataFrame) -> DataFrame:
    """Alert contexts from (case_id, value), value the JSON text of a task.

    The tag in the prompt stands in only where the structured id is null.
    """
    raw = raw.select("case_id", "value", F.try_parse_json("value").alias("v"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    prompt = F.coalesce(get("prompt_text"), F.lit(""))
    given = get("alert_entity.entity_id").isNotNull()
    pick = lambda k: F.when(given, get(f"alert_entity.{k}")).otherwise(F.coalesce(tag_attribute(prompt, k), get(f"alert_entity.{k}") if k != "entity_id" else F.lit(None)))
    return raw.select(
        "case_id", F.coalesce(get("alert_title"), F.lit("")).alias("alert_text"), iso_timestamp(get("alert_window.start")).alias("alert_ts"),
        pick("entity_id").alias("entry_entity_id"), pick("entity_name").alias("entity_name"), pick("entity_type").alias("entity_type"), F.col("value").alias("raw"),
    )


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.text(f"{root}/*/task.json", wholetext=True)
    return parse_tasks(raw.select(_case_of(F.col("_metadata.file_path"), 2).alias("case_id"), "value"))


def parse_truth(raw: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Ground truth from (task_id, value): JSON whose raw_ground_truth is JSON text again.

    The real case id is the given one, else the mapping's, else the task's.
    """
    get = lambda k, t="string": F.try_variant_get("v", f"$.{k}", t)
    parsed = raw.select("task_id", F.try_parse_json("value").alias("v"))
    out = parsed.select(
        "task_id", present(get("case_id")).alias("given"), F.from_json(get("raw_ground_truth"), TRUTH).alias("t"),
        get("root_cause_entities", "array<string>").alias("root_cause_entities"),
    )
    mapped = out.withColumn("mapped", F.lit(None).cast("string")) if mapping is None else out.join(mapping.withColumnRenamed("case_id", "mapped"), "task_id", "left")
    return mapped.select(
        "task_id", F.coalesce("given", present(F.col("mapped")), "task_id").alias("case_id"),
        F.coalesce("t.outcome.expected_fault_id", F.lit("unknown")).alias("fault_type"), "root_cause_entities",
        F.col("t.outcome.target_entity_ids").alias("target_entity_ids"), F.col("t.outcome.target_entities").alias("target_entities"),
        F.coalesce("t.outcome.expected_conclusion", F.lit("")).alias("expected_conclusion"), F.col("t.reasoning.steps").alias("steps"),
    )


def parse_mapping(raw: DataFrame) -> DataFrame:
    """(task_id, case_id) pairs from value, the JSON text of the mapping."""
    pairs = F.from_json(F.get_json_object("value", "$.task_to_case_id"), "map<string,string>")
    return raw.select(F.explode(pairs).alias("task_id", "case_id"))


def read_ground_truth(spark: SparkSession, answer_dir: str) -> DataFrame:
    mapping = parse_mapping(spark.read.text(f"{answer_dir}/mapping.json", wholetext=True))
    raw = spark.read.text(f"{answer_dir}/*.gt.json", wholetext=True)
    return parse_truth(raw.select(_case_of(F.col("_metadata.file_path"), 1).alias("task_id"), "value"), mapping)


def write_results(df: DataFrame, path: str) -> None:
    """CSV with a header, and Parquet by system beside it."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").partitionBy("system").parquet(f"{path}/parquet")


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors by case: a search of one case reads that case's files only."""
    df.write.mode("overwrite").partitionBy("case_id").parquet(path)


def read_vectors(spark: SparkSession, path: str, schema: str, cases: DataFrame) -> DataFrame:
    """Vectors of the cases in ``cases`` (case_id): files of other cases aren't opened.

    ``schema`` names the columns, case_id among them. The join prunes partitions at run time.
    """
    return spark.read.schema(schema).parquet(path).join(F.broadcast(cases.select("case_id").distinct()), "case_id", "left_semi")  # ids of cases


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, nulls; one pass over the data."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("__rows").alias("rows"), F.col(f"`{c}`").alias("nulls")) for c, t in df.dtypes])
    return counts.select(F.explode(entries).alias("e")).select("e.*")


def profile_topology(raw: DataFrame) -> DataFrame:
    """Top-level keys of each case's topology: case_id, key, n (length of a list, else null), head.

    ``raw``: case_id, value (a JSON object). ``head`` is the start of the value.
    """
    keyed = raw.select("case_id", F.explode(json_map(F.col("value"))).alias("key", "value"))
    return keyed.select("case_id", "key", F.json_array_length("value").alias("n"), F.substring("value", 1, 1000).alias("head"))


def first_row(df: DataFrame, *order: str) -> DataFrame:
    """The first row in the given order, as JSON."""
    return df.orderBy(*order).limit(1).select(F.to_json(F.struct(*df.columns)).alias("first_row"))
