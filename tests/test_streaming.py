from caseloom.functions import normalize
from caseloom.operators import resolve
from caseloom.streaming import normalized


def test_a_stream_gives_the_table_s_rows(spark, tmp_path):
    e = spark.createDataFrame([("c", "e1", 0, "Cart", None, None)], "case_id string, entity_id string, ord long, name string, pod_name string, service string")
    index = resolve.name_index(e)
    rows = spark.createDataFrame([("c", 0, "cart", None, "ERROR x"), ("c", 1, "other", None, "y")], "case_id string, row_ord long, _container_name_ string, _time_ string, content string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = normalized.raw_stream(spark, str(tmp_path / "in"), "logs")
    query = normalized.write_observations(stream, lambda df: normalize.logs(df, index), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.text: r.entity_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.text: r.entity_id for r in normalize.logs(rows, index).collect()}
