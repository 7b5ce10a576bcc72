"""Exact dedup through an extendible-hash index on shared files.

A directory maps key ranges (leading bits of a 64-bit hash) to buckets. It starts with one
bucket and doubles; a bucket that holds too many keys is split by its next bit. Each
bucket has an owner task that receives its key range, chains texts of equal hash and tells
them apart by their bytes, and writes its entries to the shared folder. Documents then
look up their hash; only where a chain has several entries are bytes compared again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stage, text_of

#: Bits up to which the directory (2**bits rows of two numbers) is broadcast.
BROADCAST_DEPTH = 16


def directory(keys: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """``cell`` (the leading ``max_depth`` bits) -> ``bucket``, at most 2**max_depth rows.

    ``keys`` has one row for each different ``key``. At depth d a bucket is a prefix of d
    bits; a cell's bucket is the first on its way down that isn't overfull. Buckets of
    different depths differ by their leading one bit.
    """
    cells = (
        keys.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
        .withColumn("bucket", F.expr(f"shiftright(cell, {max_depth} - depth) + shiftleft(1L, depth)"))
    )
    fits = (
        cells.groupBy("bucket", "depth").agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("depth") == max_depth))
    )
    # Prefixes of a cell ascend with their depth, so the smallest fitting bucket is the highest.
    return cells.select("cell", "bucket").join(fits.select("bucket"), "bucket").groupBy("cell").agg(F.min("bucket").alias("bucket"))


def written_directory(probes: DataFrame, capacity: int, depth: int) -> DataFrame:
    """The directory of the keys of ``probes``, in the shared folder."""
    keys = probes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return stage(directory(keys, capacity, depth), "exact-directory")


def routed(rows: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """``rows`` (key) with the bucket that owns their key's range; a key that no bucket covers drops out.

    Up to ``BROADCAST_DEPTH`` bits the directory is broadcast, beyond that it is joined by shuffle.
    """
    near = F.broadcast(cells) if depth <= BROADCAST_DEPTH else cells
    return rows.withColumn("cell", F.shiftrightunsigned("key", 64 - depth)).join(near, "cell").drop("cell")


def build_index(texts: DataFrame, probes: DataFrame, hot: DataFrame, capacity: int, depth: int, cells: DataFrame | None = None) -> DataFrame:
    """The index: bucket, key, norm, keep_id, group_size, chain (place among texts of that hash), chain_size.

    ``texts`` has id, key and norm, ``probes`` id and key. ``hot`` (a few keys) are summed
    before they are sent to their owner. An owner writes its buckets one after the other, so
    that a reader of one bucket skips the row groups of others.
    """
    cells = written_directory(probes, capacity, depth) if cells is None else cells
    marked = texts.join(F.broadcast(hot), "key", "left")
    warm = marked.where("hot").groupBy("key", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    cold = marked.where("hot is null").select("key", "norm", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    owned = (
        routed(cold.unionByName(warm), cells, depth)
        .repartition("bucket")
        .groupBy("bucket", "key", "norm")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    chained = owned.selectExpr(
        "*",
        "row_number() over (partition by bucket, key order by norm) as chain",
        "count(1) over (partition by bucket, key) as chain_size",
    )
    return stage(chained.sortWithinPartitions("bucket", "key"), "exact-index")


def lookup(index: DataFrame, cells: DataFrame, probes: DataFrame, hot: DataFrame, depth: int) -> DataFrame:
    """``probes`` (id, key, more) with keep_id and group_size, where the chain of their key has one text.

    The directory leads a probe to its bucket; bucket and key to its entry. Entries of ``hot``
    keys (a few) are broadcast, and the probes that have them aren't sent at all.
    """
    single = index.where("chain_size = 1").select("bucket", "key", "keep_id", "group_size")
    marked = probes.join(F.broadcast(hot), "key", "left")
    cold = routed(marked.where("hot is null").drop("hot"), cells, depth)
    found = cold.join(single.join(F.broadcast(hot.select("key")), "key", "left_anti"), ["bucket", "key"]).drop("bucket")
    frequent = single.drop("bucket").join(F.broadcast(hot.select("key")), "key")
    return found.unionByName(marked.where("hot").drop("hot").join(F.broadcast(frequent), "key"))


def normalised(text_col: str = "text") -> Column:
    """The text with each run of white space as one space; null as the empty text."""
    return F.regexp_replace(text_of(text_col), SPACES, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2_000,
    depth: int | None = None,
    hot_share: int = 512,
) -> DataFrame:
    """Groups of documents whose texts are equal but for runs of white space.

    One row for each input row: doc_id, keep_id, group_size, kept, text_sha256 (of the
    normalised text). Null texts are empty ones. Null ids sort after all others; a group
    of null ids only keeps them all. Rows that repeat an id and its text have one verdict,
    so ties are told apart by nothing. Very long texts are keys like all others. Other
    columns are ignored, whatever their names; an empty table gives no rows.

    ``depth`` bounds the directory's doublings; by default it follows the number of rows,
    so that buckets hold ``capacity`` different texts at most. Texts that make up a
    ``hot_share``-th of the rows or more (``hot_share`` keys at most) are broadcast.
    """
    plain = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    texts = plain.withColumn("key", F.xxhash64("norm"))
    probes = stage(texts.select("id", "key", F.sha2("norm", 256).alias("text_sha256")), "exact-probes")
    rows = probes.count()
    if depth is None:
        depth = max(1, math.ceil(math.log2(max(1, rows / capacity))) + 3)
    hot = probes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, -(-rows // hot_share)))
    hot = stage(hot.select("key", F.lit(True).alias("hot")), "exact-hot")
    cells = written_directory(probes, capacity, depth)
    index = build_index(texts, probes, hot, capacity, depth, cells)
    entry = ["keep_id", "group_size"]
    found = lookup(index, cells, probes, hot, depth).drop("key")
    if not index.where("chain_size > 1").isEmpty():  # texts that share a 64-bit hash
        chains = index.where("chain_size > 1").select("key", "norm", *entry)
        again = texts.join(chains, ["key", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
        found = found.unionByName(again.drop("key", "norm"))
    return found.select(
        F.col("id").alias("doc_id"), *entry, F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
