"""Column functions of the normalisation layer; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns that results depend on.
LOG_LEVEL = r"\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|Exception)\b"
ALERT_TAG = r"<alert_event\b([^>]*)/?>"
ATTRIBUTE = r"(\w+)=\"([^\"]*)\""
ERROR = r"(?i)(error|exception|fail|timeout|5\d\d)"
#: Microseconds in one unit, as (multiplier, divisor).
UNITS = {"s": (1_000_000, 1), "ms": (1_000, 1), "us": (1, 1), "ns": (1, 1_000)}
#: Years 1 to 9999, in microseconds of the epoch.
FIRST_MICRO, LAST_MICRO = -62_135_596_800_000_000, 253_402_300_799_999_999


def first_valid(*columns: Column) -> Column:
    """The first value with a visible character, as it is; null if there is none."""
    return F.coalesce(*[F.when(c.rlike(r"\S"), c) for c in columns])


def present(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def json_map(column: Column) -> Column:
    """Top-level keys of a JSON object; the empty map for a null or broken text."""
    return F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))


def iso_timestamp(column: Column) -> Column:
    """UTC timestamp of an ISO text; null for a blank or broken one."""
    return F.try_to_timestamp(F.nullif(F.trim(column), F.lit("")))


def epoch_timestamp(column: Column, unit: str) -> Column:
    """Timestamp of an epoch number or its text, exact to the microsecond (ns truncate)."""
    up, down = UNITS[unit]
    value = column.cast("string").try_cast("decimal(30,6)")
    micros = F.floor(value * up / down) if down > 1 else F.floor(value * up)
    long = micros.try_cast("bigint")
    return F.when(long.between(FIRST_MICRO, LAST_MICRO), F.timestamp_micros(long))


def log_level(content: Column) -> Column:
    """The first level word of a log line, '' if there is none."""
    return F.regexp_extract(content, LOG_LEVEL, 1)


def tag_attribute(text: Column, name: str) -> Column:
    """An attribute of the first alert tag in a text; the last one of that name counts."""
    tag = F.regexp_extract(text, ALERT_TAG, 1)
    pair = F.arrays_zip(
        F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)).alias("v")
    )
    fits = F.filter(pair, lambda p: p["k"] == name)
    return F.when(F.size(fits) > 0, F.try_element_at(fits, F.lit(-1))["v"])


def alert_keywords(text: Column, most: int = 20) -> Column:
    """Words of over three characters without marks at their ends, each once, in order."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 3)
    return F.slice(F.array_distinct(F.transform(words, lambda w: F.btrim(w, F.lit(".,:;")))), 1, most)


def is_error(text: Column) -> Column:
    """Whether a text speaks of an error; 5xx codes match anywhere in a number."""
    return text.rlike(ERROR)


def fault_slug(case_name: Column) -> Column:
    """What stands before the first dot."""
    return F.substring_index(case_name, ".", 1)


def number_text(value: Column) -> Column:
    """A double as text: the shortest digits, positional from 1e-4 on and below 1e16; nan for null.

    Spark's own text (one digit, a dot, digits, E, exponent) is taken apart and set anew.
    """
    text = value.cast("double").cast("string")
    part = lambda k: F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k)
    sign, head, rest = part(1), part(2), F.when(part(3) == "0", "").otherwise(part(3))
    power = part(4).cast("int")
    digits = F.concat(head, rest)
    whole = F.rpad(digits, power + 1, F.lit("0"))
    after = F.substring(digits, power + 2, F.length(digits))
    long = F.concat(sign, F.substring(whole, F.lit(1), power + 1), F.lit("."), F.when(after == "", "0").otherwise(after))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    short = F.concat(
        sign, head, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), F.when(power < 0, "-").otherwise("+"),
        F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"),
    )
    return (
        F.when(value.isNull() | F.isnan(value.cast("double")), "nan")
        .when(text.isin("Infinity", "-Infinity"), F.replace(F.lower(text), F.lit("inity"), F.lit("")))
        .when(~F.contains(text, F.lit("E")), text)
        .when(power.between(0, 15), long)
        .when(power.between(-4, -1), small)
        .otherwise(short)
    )
