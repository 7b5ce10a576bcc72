"""The corpus pipeline: five of the training-data operators, one after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from caseloom.llm.common import stage, table


def _rows(docs: DataFrame, digest: Column) -> DataFrame:
    """Rows as structs (so that no name can clash) with keys: id, none (it has no id), of (a digest)."""
    id_ = F.col("doc_id").cast("long")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(id_, F.lit(0).cast("long")).alias("id"), F.isnull(id_).alias("none"), digest.alias("of"),
    )


def _keep(docs: DataFrame, digest: Column, verdicts: DataFrame, name: str) -> DataFrame:
    """Rows whose id and digest are in ``verdicts`` (doc_id, of, n): one row of each.

    ``n`` counts the rows of the table with that id and digest. Where it is over 1, the row
    of the smallest text stays, of equal texts any one.
    """
    key = ["id", "none", "of"]
    kept = stage(
        verdicts.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.isnull("doc_id").alias("none"), "of", "n"), name
    )
    rows = _rows(docs, digest)
    out = rows.join(kept.where("n = 1"), key, "left_semi").select("row")
    if not kept.where("n > 1").isEmpty():
        again = rows.join(kept.where("n > 1"), key, "left_semi")
        out = out.unionByName(again.groupBy(*key).agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row"))
    return out.select("row.*")


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one where a column has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Null and empty texts are scored as texts without a known term; rows that repeat an id
    or have none are scored each; an empty table gives no rows; other columns pass through.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, evidence = _unused(docs, "toxicity_score"), _unused(docs, "toxicity_evidence")
    scored = toxicity.score(docs, model, score_col=score, evidence_col=evidence)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score, evidence)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with texts equal but for white space, the one with the smallest id.

    Null texts are empty ones. A row without an id stays only where no equal text has one.
    Of rows that repeat id and text one stays; rows that share an id only are judged each.
    """
    found = exact_dedup.exact_dedup(docs)
    found = found.where("kept").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex("text_sha256").alias("of"))
    kept = found.groupBy("doc_id", "of").agg(F.count(F.lit(1)).alias("n"))
    return _keep(docs, F.unhex(F.sha2(exact_dedup.normalised(), 256)), kept, "pipeline-exact-kept")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8).

    It is that of the smallest id, of these that of the smallest digest of its text. Texts
    without words and rows without an id aren't linked and stay, each.
    """
    found = near_dedup.near_dedup(docs, with_rows=True).select("doc_id", F.col("row").alias("of"), "group")
    found = found.groupBy("group", "doc_id", "of").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct("doc_id", "of", "n")).alias("one")
    grouped = found.where("group is not null").groupBy("group").agg(best).select("one.doc_id", "one.of", "one.n")
    alone = found.where("group is null").select("doc_id", "of", F.lit(1).cast("long").alias("n"))
    return _keep(docs, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), grouped.unionByName(alone), "pipeline-near-kept")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that a document of smaller id has too.

    Rows that share an id, or have none, get their own text back, by its digest. A null
    text comes back as the empty one; n_chars, where there, follows the text.
    """
    key = ["id", "none", "of"]
    cut = suffix_dedup.suffix_dedup(docs, with_text=True)
    # Plain keys without nulls, so that the join finds the texts where the grouping left them.
    cut = cut.select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.isnull("doc_id").alias("none"), F.unhex("input_sha256").alias("of"), "text"
    )
    cut = cut.groupBy(*key).agg(F.max("text").alias("left"))
    rows = _rows(docs, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    rows = rows.withColumn("row", F.col("row").dropFields("text")) if len(docs.columns) > 1 else rows
    joined = rows.join(cut, key, "left")
    n_chars = F.length("left").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    of = lambda c: F.col("left") if c == "text" else n_chars if c == "n_chars" else F.col("row")[c]
    return joined.select(*[of(c).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in windows of at most 2048; null and empty texts are the end id alone."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.op10(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("suffix dedup", suffix_stage),
    ("packing", packing_stage),
]

#: SQL can express none of: nearest examples, min-wise hashing, tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
