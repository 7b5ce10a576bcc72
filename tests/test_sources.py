import json

from caseloom.functions import normalize
from caseloom.operators import resolve
from caseloom.sources import cases


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))


def test_a_benchmark_folder_is_read(spark, tmp_path):
    write(tmp_path / "manifest.txt", "t1\n\n  t2 \n")
    topology = {
        "entities": [
            {"id": "e1", "type": "apm.service", "name": "Cart", "props": None}, {"id": "e2", "name": "db", "props": {"pod_name": "DB-0"}},
            {"id": None, "name": "x"}, {"id": "e1", "type": "apm.service", "name": "Cart2"},
        ],
        "links": [{"source": "e1", "to": "e2", "type": "calls"}, {"src": "", "dst": "e1"}, {"caller": "e2", "callee": "e9"}, {"src": "e1", "dst": "e2", "relation": "later"}],
    }
    write(tmp_path / "cases/t1/topology.json", topology)
    write(tmp_path / "cases/t1/task.json", {"alert_title": "Cart slow", "alert_entity": None, "prompt_text": '<alert_event entity_id="e1" entity_name="Cart">', "alert_window": {"start": "2024-01-01T00:00:00Z"}})
    logs = spark.createDataFrame([("cart2", "2024-01-01T00:00:01+00:00", "ERROR bad"), ("nobody", None, "x")], "_container_name_ string, _time_ string, content string")
    logs.coalesce(1).toPandas().to_parquet(tmp_path / "cases/t1/logs.parquet")
    inner = {"outcome": {"expected_fault_id": "F1-x", "target_entities": [{"entity_id": "e2"}]}, "reasoning": {"steps": [{"step": 1, "step_type": "cause", "target": "db", "observability": [{"signal": "err", "expected": {"value": 5}}]}]}}
    write(tmp_path / "answer_key/t1.gt.json", {"raw_ground_truth": json.dumps(inner), "root_cause_entities": ["db"]})
    write(tmp_path / "answer_key/mapping.json", {"task_to_case_id": {"t1": "F1-x.abc"}})

    assert [r.case_id for r in cases.read_manifest(spark, str(tmp_path / "manifest.txt")).orderBy("ord").collect()] == ["t1", "t2"]
    assert cases.read_manifest(spark, str(tmp_path / "manifest.txt"), 1).count() == 1
    entities, edges = cases.read_topology(spark, str(tmp_path / "cases"))
    found = {r.entity_id: r for r in entities.collect()}
    assert found["e1"].name == "Cart2" and found["e1"].ord == 0 and found["e2"].entity_type == "unknown" and found["e2"].pod_name == "DB-0"
    assert {(r.src, r.dst, r.relation) for r in edges.collect()} == {("e1", "e2", "later"), ("e2", "e9", "related_to")}
    task = cases.read_tasks(spark, str(tmp_path / "cases")).first()
    assert (task.case_id, task.entry_entity_id, task.entity_name) == ("t1", "e1", "Cart")
    raw = cases.read_telemetry(spark, str(tmp_path / "cases"), "logs")
    seen = {r.row_ord: r for r in normalize.logs(raw, resolve.name_index(entities)).collect()}
    assert seen[0].entity_id == "e1" and seen[0].text == "[log:ERROR] cart2: ERROR bad" and seen[1].entity_id is None
    truth = cases.read_ground_truth(spark, str(tmp_path / "answer_key")).first()
    assert (truth.task_id, truth.case_id, truth.fault_type, truth.root_cause_entities) == ("t1", "F1-x.abc", "F1-x", ["db"])


def test_results_and_vectors_are_written_by_their_key(spark, tmp_path):
    df = spark.createDataFrame([("a", "s1", 1.0), ("b", "s2", 2.0)], "case_id string, system string, score double")
    cases.write_results(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r/csv")).count() == 2
    cases.write_vectors(df, str(tmp_path / "v"))
    assert "PartitionFilters: [isnotnull(case_id" in spark.read.parquet(str(tmp_path / "v")).where("case_id = 'a'")._jdf.queryExecution().toString()
    nulls = {r.column: (r.rows, r.nulls) for r in cases.profile(df).collect()}
    assert nulls["score"] == (2, 0)


def test_files_that_differ_by_case_are_read_whole(spark, tmp_path):
    """``time`` is a number, a text and a time; a value is a text; columns lack or are new."""
    import datetime

    import pandas as pd

    one = pd.DataFrame({"entity_name": ["n", None], "metric": ["m", "m"], "value": [1.5, None], "time": [1_000_000, 2_000_000]})
    two = pd.DataFrame({"time": ["3000000", "soon", None], "value": ["2.5", "x", None], "metric": ["m", "m", "m"], "unit": ["u", "u", "u"]})
    three = pd.DataFrame({"time": [datetime.datetime(1970, 1, 1, 0, 0, 4)], "value": [7], "metric": ["m"]}).astype({"time": "datetime64[us]"})
    for name, df in (("t1", one), ("t2", two), ("t3", three), ("t4", one), ("t5", three.astype({"time": "datetime64[ns]"}))):
        (tmp_path / name).mkdir()
        df.to_parquet(tmp_path / name / "metrics.parquet")
    got = cases.read_telemetry(spark, str(tmp_path), "metrics")
    assert got.columns == ["case_id", "row_ord", "entity_id", "entity_name", "service", "metric", "value", "time"]
    rows = sorted((r.case_id, r.row_ord, r.entity_name, r.value, r.time) for r in got.collect())
    first = [(0, "n", 1.5, 1_000_000), (1, None, None, 2_000_000)]
    assert [r[1:] for r in rows if r[0] == "t1"] == [r[1:] for r in rows if r[0] == "t4"] == first
    assert [r[1:] for r in rows if r[0] == "t2"] == [(0, None, 2.5, 3_000_000), (1, None, None, None), (2, None, None, None)]
    assert [r[1:] for r in rows if r[0] == "t3"] == [r[1:] for r in rows if r[0] == "t5"] == [(0, None, 7.0, 4_000_000)]
    types = {(r.case_id, c.name): c.type for r in cases.telemetry_files(spark, str(tmp_path), "metrics").collect() for c in r["columns"]}
    assert (types["t1", "time"], types["t2", "time"], types["t2", "unit"]) == ("bigint", "string", "string")
    assert types["t3", "time"].startswith("timestamp") and types["t5", "time"] == cases.NANOS


def test_times_of_96_bits_are_times(spark, tmp_path):
    """Spark's writer may store times as INT96, which arrow shows as nanoseconds."""
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    at = pa.table({"metric": ["m", "m", "m"], "time": pa.array([datetime.datetime(1970, 1, 1, 0, 0, 4, 5), datetime.datetime(1969, 12, 31), None], pa.timestamp("us"))})
    for name, old in (("t1", True), ("t2", False)):
        (tmp_path / name).mkdir()
        pq.write_table(at, tmp_path / name / "metrics.parquet", use_deprecated_int96_timestamps=old)
    types = {(r.case_id, c.name): c.type for r in cases.telemetry_files(spark, str(tmp_path), "metrics").collect() for c in r["columns"]}
    assert types["t1", "time"] == spark.read.parquet(str(tmp_path / "t1/metrics.parquet")).schema["time"].dataType.simpleString() == "timestamp"
    rows = sorted((r.case_id, r.row_ord, r.time) for r in cases.read_telemetry(spark, str(tmp_path), "metrics").collect())
    assert [r[1:] for r in rows if r[0] == "t1"] == [r[1:] for r in rows if r[0] == "t2"] == [(0, 4_000_005), (1, -86_400_000_000), (2, None)]
