"""Sharding by a two-pass external shuffle.

Pass one scatters the records by a seeded hash into buckets that fit in memory; Spark's
exchange is the external store. Pass two permutes each bucket with Fisher-Yates swaps and
writes it to the shards. Buckets stand one after the other in a global order that is cut
into shards whose row counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, stage, text_of


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1 by Fisher-Yates swaps, the same for equal arguments.

    All swap partners are drawn at once; only the swaps themselves run one by one.
    """
    if n < 2:
        return np.zeros(n, np.int64)
    rng = np.random.default_rng([seed, bucket])
    partner = rng.integers(0, np.arange(n, 1, -1)).tolist()
    order = list(range(n))
    for last, other in zip(range(n - 1, 0, -1), partner, strict=True):
        order[last], order[other] = order[other], order[last]
    return np.asarray(order, np.int64)


def _permuter(seed: int):
    """Streams sorted buckets and adds ``__at``, each record's place in its bucket.

    Only the permutation is held (a list of numbers while it is drawn, some 40 bytes a
    record, then 8); the records stream through.
    """

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seen, order = None, 0, np.zeros(0, np.int64)
        for batch in batches:
            names = batch.schema.names
            of = batch.column(names.index("__bucket")).to_numpy(zero_copy_only=False)
            sizes = batch.column(names.index("__n")).to_numpy(zero_copy_only=False)
            at = np.empty(len(of), np.int64)
            edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
            for lo, hi in zip(edges, [*edges[1:], len(of)], strict=True):
                if of[lo] != bucket:
                    bucket, seen = of[lo], 0
                    order = fisher_yates(int(sizes[lo]), seed, int(bucket))
                at[lo:hi] = order[seen : seen + hi - lo]
                seen += hi - lo
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*names, "__at"])

    return permute


def _scattered(docs: DataFrame, rows: int, seed: int, id_col: str, text_col: str, hot_share: int) -> DataFrame:
    """__id, __text and __key, the seeded hash that scatters a record.

    Records equal in id and text have equal hashes. Where they make up a ``hot_share``-th
    of all rows (at most ``hot_share`` such groups) they are summed to a count, and each
    copy is hashed with its number, so that copies are spread like any other records.
    """
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).withColumn(
        "__key", F.xxhash64(F.lit(seed), "__id", "__text")
    )
    hot = base.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1_000, -(-rows // hot_share)))
    hot = F.broadcast(stage(hot.select("__key"), "shard-hot"))  # hot_share rows at most
    cold = base.join(hot, "__key", "left_anti").select("__id", "__text", "__key")
    if hot.isEmpty():
        return cold
    block = 1 << 16
    copies = (
        base.join(hot, "__key", "left_semi")
        .groupBy("__id", "__text")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__block", F.explode(F.expr(f"sequence(0L, (__n - 1) div {block})")))
        .repartition(max(1, rows // block), "__id", "__block")
        .withColumn("__copy", F.explode(F.expr(f"sequence(__block * {block}, least(__n, (__block + 1) * {block}) - 1)")))
    )
    return cold.unionByName(copies.select("__id", "__text", F.xxhash64(F.lit(seed), "__id", "__text", "__copy").alias("__key")))


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 20_240_601,
    bucket_bytes: int = 32 << 20,
    hot_share: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Shuffle all rows of ``docs`` into ``shards`` shards; read back the written shards.

    Returns doc_id, text, shard (0 to ``shards`` - 1) and slot (gapless from 0 in each
    shard). Row counts of shards differ by one at most. The order depends on the rows and
    ``seed`` alone. Null texts stay null; null and repeated ids, empty and very long texts
    are ordinary records; equal rows are told apart by nothing, so which of them stands
    where doesn't matter; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    total, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col) + 16), F.lit(0))).first()
    buckets = max(shards, -(-int(n_bytes) // bucket_bytes))
    base = _scattered(docs, total, seed, id_col, text_col, hot_share)
    scattered = base.withColumn("__bucket", F.pmod("__key", F.lit(buckets)))
    counts = scattered.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # The bucket table has a row for each `bucket_bytes` of input: its running sum is small work.
    starts = stage(
        counts.selectExpr("__bucket", "__n", "sum(__n) over (order by __bucket) - __n as __start"), "shard-buckets"
    )
    placed = scattered.repartition(buckets, "__bucket").join(starts.hint("shuffle_hash"), "__bucket")
    ordered = placed.sortWithinPartitions("__bucket", "__key", "__id", "__text")
    schema = T.StructType([*ordered.schema.fields, T.StructField("__at", T.LongType())])
    position = F.col("__start") + F.col("__at")
    shard = F.expr(f"(__pos * {shards}L) div {max(total, 1)}L")
    slot = F.col("__pos") - F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    permuted = (
        ordered.mapInArrow(_permuter(seed), schema)
        .withColumn("__pos", position)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", slot.cast("long"))
        .select(F.col("__id").alias("doc_id"), F.col("__text").alias("text"), "shard", "slot")
    )
    path = fresh_path(spark, "shards")
    schema = "doc_id long, text string, slot long, shard int"
    permuted.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op1(docs: DataFrame) -> DataFrame:
    """The digest of every sharded record under the law ``rows``."""
    out = shard_documents(docs)
    return out.select(
        "doc_id",
        (F.octet_length(text_of()) + 16).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
