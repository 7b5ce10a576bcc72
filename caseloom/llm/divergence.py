"""How the terms of each source differ from its language's and from other sources'.

A translation table lowers letters and blanks separators in one pass over a text's bytes;
``split`` and a Counter for each document give frequencies and document counts. Tasks sum
these before the shuffle. All arithmetic is on whole numbers. A term that a group lacks has
one smoothed value for the group, so tables hold occurring terms only and sums over all kept
terms are taken from these, with the lacking ones counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Documents of a language that must hold a term, ranks of the part ``term``, and the scale of p.
LEAST_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Different terms that a task sums before it hands them on.
HELD_TERMS = 400_000
#: Bytes of terms: letters, lowered, and all beyond ASCII; others are blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term stands in a text (UTF-8)."""
    return Counter(text.translate(TABLE).split())


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def group_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), summed by task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, dict]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_) in held.items():
                k = len(n)
                cols = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs_[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs_ = held.setdefault((lang, source), (Counter(), {}))
                before = len(n)
                for term, times in term_counts(text).items():
                    n[term] += times
                    docs_[term] = docs_.get(term, 0) + 1
                size += len(n) - before
                if size >= HELD_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()

    plain = docs.select(_or_empty("lang").alias("lang"), _or_empty("source").alias("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = plain.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return found.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "docs")


def kept_terms(counted: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, n (of the language), by_source (array of source, n): one row for each kept term.

    One shuffle: rows of a term meet once, its sources are as many as the language has.
    """
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        by_source.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by_source"))
        .where(F.col("docs") >= least_docs)
        .select("lang", "term", "n", "by_source")
    )


def _p(n: str, size: str) -> str:
    """A group's share of a term with ``n`` of its occurrences; ``size`` is N + V, null where there are no terms."""
    whole = f"({n} + 1) * {SCALE} div {size}"  # in long numbers as far as they reach
    return f"1 + case when {n} < 9000000000 then {whole} else (cast({n} + 1 as decimal(20,0)) * {SCALE}) div {size} end"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def like_counts(terms: DataFrame) -> DataFrame:
    """lang, source, n, terms: how many terms stand ``n`` times in a group."""
    each = terms.select("lang", F.explode("by_source").alias("s"))
    return each.groupBy("lang", "s.source", "s.n").agg(F.count(F.lit(1)).alias("terms"))


def group_sizes(docs: DataFrame, terms: DataFrame, alike: DataFrame) -> DataFrame:
    """lang, source, v (kept terms of the language), size (N + V), p0 (share of a term that the group lacks), whole (size of the language)."""
    every = docs.select(_or_empty("lang").alias("lang"), _or_empty("source").alias("source")).distinct()
    occurring = alike.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("n"))
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n_lang"))
    sized = every.join(occurring, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["n", "v", "n_lang"])
    sized = sized.select("lang", "source", "v", F.expr("nullif(n + v, 0) as size"), F.expr("nullif(n_lang + v, 0) as whole"))
    return sized.withColumn("p0", F.expr(_p("0", "size")))


def source_pairs(terms: DataFrame, alike: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: f summed over all kept terms.

    Were all terms lacking in both, the sum would be V * f(p0, q0). Terms of one of the two
    correct that by their count, so by how many terms of a group have the same count; terms of
    both correct it once more, and these are the only ones that are paired, once for both ways.
    """
    g = groups.select("lang", "source", "v", F.col("size").alias("gs"), F.col("p0").alias("g0"))
    h = groups.select("lang", F.col("source").alias("item"), F.col("size").alias("hs"), F.col("p0").alias("h0"))
    key = ["lang", "source", "item"]
    base = g.join(h, "lang").where("source <> item").select(*key, F.expr(f"coalesce(v * ({_f('g0', 'h0')}), 0) as value"))
    mine = alike.join(g, ["lang", "source"]).withColumn("p", F.expr(_p("n", "gs"))).join(h, "lang").where("source <> item")
    mine = mine.groupBy(*key).agg(F.expr(f"sum(terms * ({_f('p', 'h0')} - {_f('g0', 'h0')})) as value"))
    other = alike.withColumnRenamed("source", "item").join(h, ["lang", "item"]).withColumn("q", F.expr(_p("n", "hs"))).join(g, "lang").where("source <> item")
    other = other.groupBy(*key).agg(F.expr(f"sum(terms * ({_f('g0', 'q')} - {_f('g0', 'h0')})) as value"))
    both = terms.where("size(by_source) > 1").select("lang", "by_source", F.explode("by_source").alias("a"))
    both = both.select("lang", "a.source", F.col("a.n").alias("n"), F.filter("by_source", lambda x: x["source"] > F.col("a.source")).alias("after"))
    both = both.join(g, ["lang", "source"]).withColumn("p", F.expr(_p("n", "gs"))).select("lang", "source", "p", "g0", F.explode("after").alias("b"))
    both = both.select("lang", "source", "p", "g0", F.col("b.source").alias("item"), F.col("b.n").alias("n")).join(h, ["lang", "item"]).withColumn("q", F.expr(_p("n", "hs")))
    there, back = (f"{_f(x, y)} - {_f(x, y0)} - {_f(x0, y)} + {_f(x0, y0)}" for x, x0, y, y0 in (("p", "g0", "q", "h0"), ("q", "h0", "p", "g0")))
    both = both.groupBy(*key).agg(F.expr(f"sum({there}) as there"), F.expr(f"sum({back}) as back"))
    ways = F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))))
    both = both.select("lang", ways.alias("w")).select("lang", "w.source", "w.item", "w.value")
    return base.unionByName(mine).unionByName(other).unionByName(both).groupBy(*key).agg(F.sum("value").alias("value"))


def source_terms(terms: DataFrame, groups: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """lang, source, item (a term that the group uses more than its language), value, rank up to ``most``."""
    each = terms.select("lang", F.col("term").alias("item"), F.col("n").alias("all"), F.explode("by_source").alias("s"))
    each = each.select("lang", "s.source", "item", "all", "s.n").join(groups, ["lang", "source"])
    more = each.select("lang", "source", "item", F.expr(_p("n", "size")).alias("p"), F.expr(_p("all", "whole")).alias("q")).where("p > q")
    return _ranked(more.select("lang", "source", "item", F.expr(_f("p", "q")).alias("value"))).where(F.col("rank") <= most)


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: see ``source_pairs`` and ``source_terms``.

    Null text, language and source are empty ones; an empty text counts for its group without
    terms; a language without kept terms has pairs of value 0. Very long texts are counted
    whole; repeated rows and rows without an id are documents each (ids aren't read); ties
    fall to the item first in UTF-8; an empty table gives no rows; other columns are ignored,
    whatever their names. A hot source is summed in tasks first; its ranks are cut in tasks too.
    """
    terms = stage(kept_terms(group_terms(docs), least_docs), "divergence-terms")
    alike = stage(like_counts(terms), "divergence-counts")
    groups = stage(group_sizes(docs, terms, alike), "divergence-groups")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = _ranked(source_pairs(terms, alike, groups)).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(source_terms(terms, groups, top_terms).withColumn("part", F.lit("term")).select(*columns))


_P = "1 + ({n} + 1)::HUGEINT * 1000000000 // {size}"
ORACLE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, source, w.term),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n='coalesce(c.n, 0)', size='(s.size + v.v)')} AS p, {_P.format(n='k.n', size='(v.n + v.v)')} AS q
FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
al AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN pr ON pr.lang = g.lang AND pr.source = g.source AND pr.item = h.source
UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM al) r WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
