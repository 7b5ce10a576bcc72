"""Near-duplicates by b-bit MinHash.

Each text's set of word shingles has ``BANDS * ROWS`` minima. Hashes of bands of whole
minima give the candidates; of each minimum only ``BITS`` low bits are kept, packed into
64-bit words. Counting equal bits, corrected for chance collisions, estimates a candidate
pair's similarity; pairs that are not surely below the threshold are confirmed on their
full sets. Texts of equal sets are one node from the start.

Groups of many near copies aren't paired off: members of a bucket are held against its
smallest member first. Only where a bucket then still lies in several components are the
members that strayed held against the others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components
from .shingles import mix, shingle_sets

#: A pair of similarity 0.8 shares no band with a chance of (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
BITS = 2
HASHES = BANDS * ROWS
LANES = 64 // BITS
WORDS = HASHES // LANES
#: Standard errors that an estimate may lie below the threshold.
MARGIN = 5.0
#: Members of a bucket, and strays, that one group holds against each other, and shingles of either.
CHUNK, CHUNK_SHINGLES = 2048, 1 << 21
#: Bits of the map of rows whose sets are built (16 MB), in pages as Spark's bitmaps have them.
MARK_BITS, _PAGE = 1 << 27, 1 << 15

_RNG = np.random.default_rng(0x5EED)
_MUL = (_RNG.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _RNG.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)[:, None]
_ROW_MUL = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)
_SHIFT = (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))[None, :]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (_MUL * x[None, at : at + 1024] + _ADD).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One hash per band of whole minima."""
    return mix((least.astype(np.uint64).reshape(BANDS, ROWS) * _ROW_MUL).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def pack_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of the (mixed) minima, ``LANES`` of them in each 64-bit word."""
    low = mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    return (low.reshape(WORDS, LANES) << _SHIFT).sum(axis=1, dtype=np.uint64)


def least_equal(similarity: float) -> int:
    """Equal lanes from which on a pair isn't surely below ``similarity``."""
    chance = 2.0**-BITS
    p = similarity + (1 - similarity) * chance
    return math.floor(HASHES * p - MARGIN * math.sqrt(HASHES * p * (1 - p)))


def estimate(equal: int) -> float:
    """Similarity from the count of equal lanes, corrected for chance collisions."""
    chance = 2.0**-BITS
    return max(0.0, (equal / HASHES - chance) / (1 - chance))


#: Equal lanes of two packed signatures s (array) and t, in SQL: lanes without a set bit.
_DIFFER = " + ".join(
    f"bit_count(((s[{i}] ^ t[{i}]) | shiftrightunsigned(s[{i}] ^ t[{i}], 1)) & {0x5555555555555555}L)" for i in range(WORDS)
)
EQUAL_SQL = f"({HASHES} - ({_DIFFER}))"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` (doc_id, text, row) with n_shingles, digest of the set, band keys, packed bits for text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, keys, sig = [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                least = minima(s) if len(s) else None
                keys.append(band_keys(least).view(np.int64) if len(s) else np.zeros(0, np.int64))
                sig.append(pack_bits(least).view(np.int64) if len(s) else np.zeros(0, np.int64))
            longs = pa.list_(pa.int64())
            cols = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, longs), pa.array(sig, longs)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_shingles", "digest", "bands", "sig"])

    return docs.mapInArrow(sign, "doc_id long, row binary, n_shingles long, digest binary, bands array<long>, sig array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``texts`` (node, text) -> node and its set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for hi in range(1, batch.num_rows + 1):  # a few hundred sets at once
                if hi - lo == 256 or hi == batch.num_rows:
                    part = batch.slice(lo, hi - lo)
                    sets = [s.view(np.int64) for s in shingle_sets(part.column(1), words)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])
                    lo = hi

    return texts.mapInArrow(build, "node long, shingles array<long>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements of each set some other set of the list has too."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    return np.bincount(owner, weights=count[back] > 1, minlength=len(sets)).astype(np.int64)


def _strays(members: DataFrame, least: int, percent: int) -> DataFrame:
    """Likely links across components within a bucket, other than with its pivot.

    ``members``: key, part, chunk, node, label, stray, home, sig, low (halves of the
    shingles' hashes). A bucket's strays are cut into parts and its members into chunks;
    each part meets each chunk in one group, so no group holds more than about CHUNK of
    either, nor more than about CHUNK_SHINGLES shingles (one longer set apart). ``home`` marks a chunk's own members, ``stray`` the strays of the part. A pair
    must pass, in this order: the estimate; the bound that neither set shares more with
    the group than the threshold needs; the overlap of the halved hashes, which is never
    below the true one. So only pairs that are links
    but for a clash of hashes leave the task, one for each stray and component.
    """

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.stack(pdf["sig"].to_numpy()).astype(np.int64).view(np.uint64)
        node, label, home = pdf["node"].to_numpy(), pdf["label"].to_numpy(), pdf["home"].to_numpy()
        sets = [np.unique(x) for x in pdf["low"]]
        size, shared = np.array([len(x) for x in pdf["low"]]), shared_counts(sets)
        # A halved set may hold fewer values; what it lacks could be shared as well.
        shared += size - np.array([len(x) for x in sets])
        others, pairs = np.flatnonzero(home), []
        odd = np.uint64(0x5555555555555555)
        for i in np.flatnonzero(pdf["stray"].to_numpy()):
            x = sig[others] ^ sig[i]
            equal = HASHES - np.bitwise_count((x | (x >> np.uint64(1))) & odd).sum(axis=1)
            both = size[others] + size[i]
            # common * 100 >= percent * (both - common)
            enough = (100 + percent) * np.minimum(shared[others], shared[i]) >= percent * both
            done: set[int] = set()
            for j in others[(equal >= least) & enough & (label[others] != label[i])].tolist():
                if label[j] in done:
                    continue
                spare = size[i] + size[j] - len(sets[i]) - len(sets[j])
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) + spare
                if (100 + percent) * common >= percent * (size[i] + size[j]):
                    pairs.append((min(node[i], node[j]), max(node[i], node[j])))
                    if (100 + percent) * (common - spare - 2) >= percent * (size[i] + size[j]):
                        done.add(label[j])  # a link even if two of the halved hashes clash
        return pd.DataFrame(pairs, columns=["a", "b"], dtype=np.int64)

    return members.groupBy("key", "part", "chunk").applyInPandas(hold, "a long, b long").distinct()


def _marked(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` without most of those whose key isn't in ``wanted``, before they are shuffled.

    Hashes of the wanted keys set bits in a broadcast map of MARK_BITS bits, whatever the
    number of keys. Where very many are wanted it lets more rows through, never fewer.
    """
    bit = F.pmod(F.xxhash64(*key), F.lit(MARK_BITS))
    page, at = F.floor(bit / _PAGE).cast("int"), F.pmod(bit, F.lit(_PAGE))
    marks = wanted.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(at).alias("marks"))
    set_ = F.expr("shiftright(cast(conv(hex(substring(marks, cast(bit_at div 8 as int) + 1, 1)), 16, 10) as int), cast(bit_at % 8 as int)) & 1 = 1")
    placed = rows.withColumn("page", page).withColumn("bit_at", at).join(F.broadcast(marks), "page")
    return placed.where(set_).select(*rows.columns)


def near_dedup(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False
) -> DataFrame:
    """Components of documents whose shingle sets have a similarity of ``percent`` or more.

    One row for each input row: doc_id, n_shingles, component_id (smallest id reachable),
    kept (doc_id is that id) and, if asked for, row (SHA-256 of the text) and group (a
    number of the component, null for rows that aren't linked). Null and empty texts have no
    shingles and stand alone; texts of fewer words are one shingle; very long texts are sets
    like all others. Each row is a document of its own, also where rows repeat an id. A row
    without an id is linked to nothing: component_id null, kept true. Other columns are
    ignored, whatever their names; an empty table gives no rows.

    Nodes are different sets, so equal texts are one node. Tables that are joined on keys
    which many rows may hold are written first: adaptive execution can split such joins.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Tells a text from others of its id; all of it where the caller asks for rows.
    row = F.unhex(F.sha2(text, 256)) if with_rows else F.unhex(F.hex(F.xxhash64(text)))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), row.alias("row"))
    least = least_equal(percent / 100)
    signed = stage(signatures(plain, words), "near-signatures")
    numbered = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "row")).alias("at"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("sig").alias("sig"),
        )
        .withColumn("node", F.monotonically_increasing_id())  # fixed once written
    )
    nodes = stage(numbered, "near-nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(banded.join(stage(pivots, "near-pivots"), "key"), "near-members")

    sigs = nodes.select("node", "sig")

    def likely(pairs: DataFrame) -> DataFrame:
        s, t = sigs.selectExpr("node as a", "sig as s"), sigs.selectExpr("node as b", "sig as t")
        return pairs.join(t, "b").join(s, "a").where(f"{EQUAL_SQL} >= {least}").select("a", "b")

    # Full sets of the nodes that share a bucket, built once, from one row of each.
    wanted = stage(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "at.*"), "near-wanted")
    texts = _marked(plain, wanted, ["doc_id", "row"]).join(wanted, ["doc_id", "row"]).select("node", "text")
    sets = stage(_sets(texts, words).dropDuplicates(["node"]), "near-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets reach the threshold; the set of a (often the same) is joined last."""
        a, b = sets.selectExpr("node as a", "shingles as s"), sets.selectExpr("node as b", "shingles as t")
        both = pairs.join(b, "b").join(a, "a").selectExpr("a", "b", "size(s) + size(t) as n", "size(array_intersect(s, t)) as common")
        return stage(both.where(f"100 * common >= {percent} * (n - common)").select("a", "b"), "near-links")

    stars = members.where("node <> pivot").selectExpr("pivot as a", "node as b").distinct()
    links = confirmed(stage(likely(stars), "near-likely"))
    labels = components(links)
    placed = stage(
        members.where("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-placed"
    )
    split = stage(placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "near-split")
    main = labels.selectExpr("node as pivot", "label as main")
    flagged = stage(
        placed.where("node <> pivot")
        .join(split, "key")
        .join(main, "pivot", "left")
        .withColumn("stray", F.col("label") != F.coalesce("main", "pivot"))
        .join(nodes.select("node", "n"), "node")
        .select("key", "node", "label", "n", "stray"),
        "near-apart",
    )
    # Parts and chunks are bounded by members and by the shingles of their sets.
    in_parts = lambda n, shingles: F.greatest(F.ceil(n / CHUNK), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")
    strays = (
        flagged.groupBy("key")
        .agg(F.count_if("stray").alias("strays"), F.sum(F.when(F.col("stray"), F.col("n"))).alias("of_strays"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("of_all"))
        .where("strays > 0")
        .select("key", in_parts(F.col("size"), F.col("of_all")).alias("chunks"), in_parts(F.col("strays"), F.col("of_strays")).alias("parts"))
    )
    apart = (
        flagged.join(stage(strays, "near-strays"), "key")
        .withColumn("chunk_of", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("part_of", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int"))
        .withColumn(
            "cell",
            # Every part of the own chunk; for a stray also every other chunk of its part.
            F.explode(
                F.expr(
                    "concat(transform(sequence(0, parts - 1), p -> struct(p as part, chunk_of as chunk, true as home, stray and p = part_of as stray)), "
                    "if(stray, transform(filter(sequence(0, chunks - 1), c -> c <> chunk_of), c -> struct(part_of as part, c as chunk, false as home, true as stray)), array()))"
                )
            ),
        )
        .select("key", "node", "label", "cell.*")
        .join(sigs, "node")
        .join(sets.selectExpr("node", "transform(shingles, x -> cast(shiftright(x, 32) as int)) as low"), "node")
        .select("key", "part", "chunk", "node", "label", "stray", "home", "sig", "low")
    )
    found = stage(_strays(apart, least, percent), "near-found")
    if not found.isEmpty():
        labels = components(links.unionByName(confirmed(found)))
    of = nodes.selectExpr("node", "digest", "at.doc_id as least_id").join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    of = stage(of.select("digest", "group", "least_id"), "near-groups")
    ids = of.groupBy("group").agg(F.min("least_id").alias("component_id"))
    of = stage(of.select("digest", "group").join(stage(ids, "near-ids"), "group"), "near-components")
    by_set = signed.select("doc_id", "row", "n_shingles", "digest").join(of, "digest", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("doc_id"))
    verdict = [component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")]
    rows = ["row", F.when(linked, F.col("group")).alias("group")] if with_rows else []
    return by_set.select("doc_id", "n_shingles", *verdict, *rows)


def oracle_sql(words: int, percent: int) -> str:
    """The components by brute force over shared shingles, for small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shingle = " || ' ' || ".join(f"ws[i + {j}]" for j in range(words))
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {words} THEN list_transform(range(1, len(ws) - {words - 2}), lambda i: {shingle})
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sn AS MATERIALIZED (SELECT s.*, n.n FROM s JOIN n ON n.doc_id = s.doc_id
), l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sn a JOIN sn b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c LEFT JOIN n ON n.doc_id = c.doc_id
"""
