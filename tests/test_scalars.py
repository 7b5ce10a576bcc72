from datetime import datetime

from pyspark.sql import functions as F

from caseloom.functions import scalars


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


def test_first_valid_skips_blanks_and_keeps_spaces(spark):
    df = spark.createDataFrame([("  ", " a ", "b"), (None, None, None)], "a string, b string, c string")
    got = [r.x for r in df.select(scalars.first_valid(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()]
    assert got == [" a ", None]


def test_json_map(spark):
    assert one(spark, '{"a": 1, "b": {"c": 2}}', scalars.json_map)["a"] == "1"
    assert one(spark, "{broken", scalars.json_map) == {} and one(spark, None, scalars.json_map) == {}


def test_timestamps(spark):
    assert one(spark, "2024-01-02T03:04:05+01:00", scalars.iso_timestamp) == datetime(2024, 1, 2, 2, 4, 5)
    assert one(spark, " ", scalars.iso_timestamp) is None and one(spark, "soon", scalars.iso_timestamp) is None
    second = datetime(2024, 1, 1)
    for unit, text in (("s", "1704067200"), ("ms", "1704067200000"), ("us", "1704067200000000"), ("ns", "1704067200000000999")):
        assert one(spark, text, lambda c, u=unit: scalars.epoch_timestamp(c, u)) == second
    for text in ("", "NaN", "abc", "9" * 25, None):
        assert one(spark, text, lambda c: scalars.epoch_timestamp(c, "s")) is None


def test_log_levels_are_whole_words(spark):
    assert one(spark, "x ERROR y WARN", scalars.log_level) == "ERROR"
    assert one(spark, "INFORMED error", scalars.log_level) == ""


def test_alert_tag(spark):
    text = 'say <alert_event entity_id="a" entity_id="b" entity_name="n"/> <alert_event entity_id="z"/>'
    assert one(spark, text, lambda c: scalars.tag_attribute(c, "entity_id")) == "b"
    assert one(spark, "none", lambda c: scalars.tag_attribute(c, "entity_id")) is None


def test_keywords_lose_their_marks_after_the_length_test(spark):
    assert one(spark, "CPU high: high, ::::", scalars.alert_keywords) == ["high", ""]
    assert len(one(spark, " ".join(f"word{i}" for i in range(30)), scalars.alert_keywords)) == 20


def test_5xx_matches_anywhere(spark):
    assert one(spark, "duration=1500.0ms status=OK", scalars.is_error)
    assert not one(spark, "all fine 499", scalars.is_error)
    assert one(spark, "F014-x.abc.d", scalars.fault_slug) == "F014-x"


def test_numbers_as_text(spark):
    values = [0.0, -0.0, 1.0, 50.0, -2.5, 0.001, 0.00099, 1e-4, 1.25e-4, 1e-5, -3.75e-7, 9999999.0, 1e7, 12345678.5, -1.5e10, 123456789012345.0, 1e15, 1e16, 1.5e16, 2.5e120, 1e-120, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.x for r in df.orderBy("i").select(scalars.number_text(F.col("v")).alias("x")).collect()]
    assert got == ["nan" if v is None else repr(v) for v in values]
