"""Importance resampling towards a target: hashed word runs, log-ratio gains, Gumbel scores.

An untrained ``Split`` of the tokenizers library cuts ASCII-lowered text into words with
offsets; windows over the offset pairs are the features. Each feature is a CRC bucket; the
buckets of each document are written once, summed to histograms, and read again for weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: What words are made of (all but ASCII that is no digit or small letter).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SCALE, SEED = 10_000, 1_000, 2024
#: Words that a document must have to be drawn, and the share of those that is drawn, in percent.
LEAST_WORDS, PERCENT = 20, 10
#: Different features whose bucket a Python worker keeps.
KEPT_FEATURES = 500_000


def splitter():
    """Words with character offsets, as (word, (start, end)), by the tokenizers library."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORD), "removed", invert=True).pre_tokenize_str


class Buckets:
    """Feature buckets of texts; those of features seen before are kept."""

    def __init__(self, least: int, most: int, buckets: int):
        self.sizes, self.buckets, self.split = range(least, most + 1), buckets, splitter()
        self.kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
        self.seen: dict[str, int] = {}

    def of(self, text: bytes) -> tuple[int, bytes]:
        """Number of words, and the buckets of all runs of words (UTF-8, repeats counted)."""
        lowered = text.lower().decode("utf-8", "replace")  # bytes.lower changes A-Z only
        found = self.split(lowered)
        if self.sizes == range(1, 2):
            runs = [w for w, _ in found]
        else:
            ends = [at for _, at in found]
            cut = lambda i, n: " ".join([lowered[a:b] for a, b in ends[i : i + n]])
            runs = [cut(i, n) for n in self.sizes for i in range(len(ends) - n + 1)]
        if len(self.seen) > KEPT_FEATURES:
            self.seen.clear()
        for run in set(runs).difference(self.seen):
            self.seen[run] = zlib.crc32(run.encode()) % self.buckets
        return len(found), np.array(list(map(self.seen.__getitem__, runs)), self.kind).tobytes()


def features(rows: DataFrame, id_col: str, text_col: str, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, buckets (their numbers end to end, little-endian) of every whole text; null has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Buckets(least, most, buckets)
        for batch in batches:
            found = [own.of(t) for t in batch.column(1).to_pylist()]
            words, numbers = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(numbers, pa.binary())], names=["id", "n_words", "buckets"])

    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(cut, "id long, n_words long, buckets binary")


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: ``buckets`` numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                n += np.bincount(np.frombuffer(part, _kind(buckets)), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket speaks for the target, in thousandths of a natural log."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    return np.floor(SCALE * np.log((target + 1.0) * (s + k) / ((source + 1.0) * (t + k)))).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains, 0 without features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(b, _kind(buckets)) for b in batch.column(2).to_pylist()]
            n = np.array([len(x) for x in parts], np.int64)
            total = np.array([gain[x].sum() for x in parts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, most: int) -> DataFrame:
    """``rows`` sorted by range, with rank where it is up to ``most``; no task holds more than a range.

    The sorted rows are written; a row's rank is its place in its range and the rows before that.
    """
    at = F.monotonically_increasing_id()
    placed = stage(rows.orderBy(*order).withColumn("__at", at), "ranked")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # one row for each range
    rank = F.col("__before") + place + 1
    return placed.withColumn("__part", part).join(starts, "__part").select(*rows.columns, F.when(rank <= most, rank).cast("long").alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED, target_id: str = "item_id",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn.

    ``docs``: doc_id, text; ``target``: a text column. Documents with ``least_words`` words or
    more take part; of these the ``percent`` with the best scores are drawn. Null and empty texts
    have no features and weight 0; very long texts are cut whole; ties fall to the smaller id
    (rows without an id, scored as by the id '', come last; equal rows take following ranks);
    repeated rows are scored and drawn each; an empty table gives no rows, an empty target
    weights by the documents alone; other columns are ignored, whatever their names.
    """
    found = stage(features(docs, "doc_id", "text", least, most, buckets), "resample-features")
    wanted = features(target, target_id, "text", least, most, buckets)
    gain = gains(histogram(found, buckets), histogram(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stage(weights(found, gain, buckets).withColumn("score", F.col("weight") + noise), "resample-scores")
    fit = scored.where(F.col("n_words") >= least_words).drop("n_words")
    draw = percent * fit.count() // 100
    drawn = ranked(fit, [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"], draw)
    rest = scored.where(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""WITH ct AS MATERIALIZED (SELECT list(x ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(i)) q),
dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM documents), bw AS (SELECT regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM benchmark),
fw AS MATERIALIZED (SELECT word, count(*) FILTER (WHERE src) AS s, count(*) FILTER (WHERE NOT src) AS t FROM (SELECT unnest(ws) AS word, true AS src FROM dw UNION ALL SELECT unnest(ws), false FROM bw) u GROUP BY word),
fb AS MATERIALIZED (SELECT word, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(word)), lambda i: ('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM fw, ct),
hs AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM fb GROUP BY bucket), al AS (SELECT sum(s) AS s, sum(t) AS t FROM hs),
gn AS (SELECT word, floor({SCALE} * ln((hs.t + 1) * (al.s + {BUCKETS}) / ((hs.s + 1) * (al.t + {BUCKETS}))))::BIGINT AS gain FROM fb JOIN hs ON hs.bucket = fb.bucket CROSS JOIN al),
dg AS (SELECT doc_id, sum(gain)::BIGINT AS total, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM dw) x JOIN gn ON gn.word = x.word GROUP BY doc_id),
sc AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE floor(total / n)::BIGINT END AS weight, ('0x' || sha256('{SEED}:' || d.doc_id)[1:8])::BIGINT AS h FROM documents d LEFT JOIN dg ON dg.doc_id = d.doc_id),
ss AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= {LEAST_WORDS} AS fit FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE fit) OVER () AS n FROM ss)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN fit AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM rk"""
