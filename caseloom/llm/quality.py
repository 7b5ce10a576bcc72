"""Quality rules: a decision list learned by sequential covering.

Each rule is a conjunction of thresholds on text statistics. It grows by the condition
with the greatest information gain on one part of the labelled rows and is pruned on the
other; rows it covers are set aside, and the next rule is learned on the rest. The list is
emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of

#: Bound of the labelled rows that are learned from.
LABELLED_ROWS = 20_000

#: Statistics that rules may bound: name -> expression over the counted columns.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over every whole text, by built-in functions and without a shuffle.

    A 3-word window is known by the hash of its words. Windows sorted by (hash, place)
    stand beside their equals; the places of those found twice or more, in order, cover
    three words each, less what the next one covers.
    """
    only = lambda c, keep: F.length(c) - F.length(F.translate(c, keep, ""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = F.col("__text")
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("__text")).select(
        "doc_id",
        "__text",
        F.expr(r"filter(split(__text, '[\\x20\\x09-\\x0D]+', -1), x -> x <> '')").alias("__words"),
        F.expr(r"filter(split(__text, '\n', -1), x -> btrim(x, ' \t\n\u000B\u000C\r') <> '')").alias("__lines"),
    )
    counted = cut.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        only(t, r"#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        only(t, upper).cast("long").alias("n_upper"),
        only(t, upper + upper.lower()).cast("long").alias("n_letters"),
        only(t, "0123456789").cast("long").alias("n_digits"),
        only(t, "!?").cast("long").alias("n_marks"),
        F.expr(
            "if(size(__words) < 3, cast(array() as array<bigint>), "
            "transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"
        ).alias("__windows"),
    )
    again = "size(array_distinct(__windows)) < size(__windows)"
    ranked = counted.withColumn(
        "__sorted",
        F.expr(f"if({again}, sort_array(transform(__windows, (h, i) -> struct(h as h, i as i))), cast(array() as array<struct<h: bigint, i: int>>))"),
    ).drop("__windows")
    places = ranked.withColumn(
        "__places",
        F.expr(
            "sort_array(filter(transform(__sorted, (s, j) -> if("
            "(j > 0 and __sorted[greatest(j - 1, 0)].h = s.h) or "
            "(j < size(__sorted) - 1 and __sorted[least(j + 1, size(__sorted) - 1)].h = s.h), s.i, -1)), p -> p >= 0))"
        ),
    ).drop("__sorted")
    covered = (
        "aggregate(zip_with(__places, slice(__places, 2, greatest(size(__places) - 1, 0)), "
        "(a, b) -> cast(least(3, b - a) as bigint)), 0L, (n, x) -> n + x)"
    )
    return places.withColumn("n_repeat_words", F.expr(covered)).drop("__places")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    bound: float

    @property
    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.bound!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    @property
    def sql(self) -> str:
        return " AND ".join(c.sql for c in self.conditions)


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], pos: int, neg: int) -> tuple[float, Condition] | None:
    """The condition with the greatest gain: p * (log2 precision after - before)."""
    bins = [
        F.struct(F.lit(f).alias("feature"), sum((F.col(f) >= F.lit(x)).cast("int") for x in xs).alias("bin"))
        for f, xs in cuts.items()
        if xs
    ]
    table = (
        rows.select("bad", F.explode(F.array(*bins)).alias("b"))
        .groupBy("b.feature", "b.bin")
        .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        .collect()  # features x thresholds rows
    )
    best = None
    for f, xs in cuts.items():
        p_of, n_of = [0] * (len(xs) + 1), [0] * (len(xs) + 1)
        for r in table:
            if r.feature == f:
                p_of[r.bin], n_of[r.bin] = r.p, r.n
        for k, x in enumerate(xs):  # bin > k: value >= x
            for at_least in (True, False):
                side = slice(k + 1, None) if at_least else slice(0, k + 1)
                p, n = sum(p_of[side]), sum(n_of[side])
                if p and p + n < pos + neg:
                    gain = p * (math.log2(p / (p + n)) - math.log2(pos / (pos + neg)))
                    bound = x if at_least else math.nextafter(x, -math.inf)
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, Condition(f, at_least, bound))
    return best


def _count(rows: DataFrame, where: list[str]) -> list[tuple[int, int]]:
    """(bad, good) rows under each condition, in one pass."""
    sums = [
        F.struct(F.coalesce(F.sum(F.expr(f"if({w}, bad, 0)")), F.lit(0)), F.coalesce(F.sum(F.expr(f"if({w}, 1 - bad, 0)")), F.lit(0)))
        for w in where
    ]
    return [(r[0], r[1]) for r in rows.agg(*sums).first()]


def learn(labelled: DataFrame, max_rules: int = 6, max_conditions: int = 3, thresholds: int = 24, precision: float = 0.95) -> list[Rule]:
    """Rules for bad rows, in order. ``labelled`` has the features, ``bad`` (0/1) and ``part``.

    Part 0 prunes, the others grow. Learning ends when a rule holds fewer than
    ``precision`` bad rows on the pruning part, so that clean documents are left alone.
    No rows or one kind of label only: no rules.
    """
    names = list(FEATURES)
    probs = [(i + 1) / (thresholds + 1) for i in range(thresholds)]
    (found,) = [labelled.where("bad = 1").agg(*[F.percentile(f, F.lit(probs)).alias(f) for f in names]).first()]
    cuts = {f: sorted(set(found[f] or [])) for f in names}
    rules: list[Rule] = []
    left = labelled
    while len(rules) < max_rules:
        grow, prune = left.where("part <> 0"), left.where("part = 0")
        (pos, neg), = _count(grow, ["true"])
        if not pos or not neg:
            break
        conditions: list[Condition] = []
        rows, p, n = grow, pos, neg
        while n and len(conditions) < max_conditions:
            best = _best_condition(rows, cuts, p, n)
            if best is None or best[0] <= 0:
                break
            conditions.append(best[1])
            rows = rows.where(best[1].sql)
            (p, n), = _count(rows, ["true"])
        if not conditions:
            break
        prefixes = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
        worth = _count(prune, [r.sql for r in prefixes])
        score = [(p - n) / (p + n) if p + n else -1.0 for p, n in worth]
        best_at = max(range(len(score)), key=lambda k: (score[k], -k))
        p, n = worth[best_at]
        if not p or p / (p + n) < precision:
            break
        rules.append(prefixes[best_at])
        left = left.where(f"NOT ({prefixes[best_at].sql})")
    return rules


def decision_list(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, null where none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(F.expr(rule.sql), F.lit(k)).otherwise(out)
    return out


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Statistics, the base verdict, and the verdict of a list learned from ``labels``.

    Returns doc_id, the counts, base_failed, kept and rule (the number of the rule that
    dropped the document). Labels 0 are bad; ids with contradicting or null labels are not
    learned from. At most ``LABELLED_ROWS`` rows in the order of a hash are learned from
    (rows that repeat an id are rows of their own), none with crc32(id) mod 4 = 2. Null and
    empty texts have no words; very long ones are counted whole; an empty table gives no
    rows. Null and repeated ids are judged each; other columns are ignored, whatever their
    names.
    """
    stats = stage(statistics(docs, id_col, text_col), "quality-statistics")
    features = [F.expr(sql).alias(name) for name, sql in FEATURES.items()]
    judged = stats.select("*", *features).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
        .where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
    )
    sample = (
        judged.where("not base_failed")
        .join(known, "doc_id")
        .select(*FEATURES, (F.col("label") == 0).cast("int").alias("bad"), F.xxhash64("doc_id").alias("h"))
        .orderBy("h", *FEATURES)
        .limit(LABELLED_ROWS)
        .select("*", F.pmod("h", F.lit(3)).alias("part"))
    )
    rules = learn(stage(sample.coalesce(1), "quality-sample"))
    ruled = judged.withColumn("rule", decision_list(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return ruled.select(*stats.columns, "base_failed", "kept", "rule")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    first = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return quality_rules(docs, labels).select(*first)
