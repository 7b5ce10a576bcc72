"""URL verdicts: host and path rules first, else a logistic regression.

The regression sees hashed character n-grams of host and path. It is trained on a small
labelled URL table, by default that of ``labelled_urls``: hosts made of words that junk
sites carry in their names are to be blocked, hosts of plain words or of no meaning are to
be allowed. Both occur alike in every top-level domain, subdomain and path.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

#: Bound of the labelled table, half of it for each verdict.
LABELLED_ROWS = 6_000

#: Words of hosts to be blocked and to be allowed, and what goes with either.
JUNK_WORDS = (
    "casino poker slots jackpot lottery bets betting roulette bingo winner win prize pills viagra cialis meds cheap replica "
    "payday loans credit-fast crypto-profit forex xxx porn sex adult escort cams dating-now warez crack keygen torrent nulled "
    "free-money clickbait earn-cash followers diet-miracle"
).split()
PLAIN_WORDS = (
    "news library university school museum weather garden recipe travel history science music forum wiki docs city hospital "
    "sport football book kitchen photo journal archive theatre bakery nature river mountain school-board research open-data "
    "parliament station harbour village family health energy print radio letters software company shop studio teacher"
).split()
SUBDOMAINS = ("", "www.", "m.", "blog.", "shop.", "www2.")
SITES = ("", "example.", "site.", "pages.")
DOMAINS = ("com", "net", "org", "de", "fr", "info")
PATHS = ("", "/", "/en/1234", "/fr/77.html", "/de/3", "/es/940/", "/index.html", "/2021/05/a-page")

#: (verdict, host, path prefix); fixed by the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule, verdict = F.when(fits, at + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def ngrams(mark: str, text: Column, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of one part, marked with its name."""
    grams = [
        F.transform(
            F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>")),
            lambda i, n=n: F.concat(F.lit(mark), text.substr(i, F.lit(n))),
        )
        for n in sizes
    ]
    return F.concat(*grams)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table: url, verdict and a running number n; some 4,000 rows by rule.

    A host is one word or two of one kind (a meaningless name has three syllables), alone,
    numbered or joined by a hyphen. Subdomain, site, domain and path follow from hashes of
    the row, so they say nothing about the label.
    """
    words = lambda xs: F.array(*[F.lit(x) for x in xs])
    pick = lambda xs, salt: F.element_at(words(xs), (F.pmod(F.xxhash64("n", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    mark = lambda a, b: F.when(F.col("n") % 4 == 0, a).when(F.col("n") % 4 == 1, F.concat(a, F.lit("-"), b)).when(F.col("n") % 4 == 2, F.concat(a, b)).otherwise(F.concat(a, F.col("n") % 90))
    syllables = [c + v for c in "bdfghklmnprstvw" for v in "aeiou"] + "th er on in at le re he st nd".split()
    kinds = [
        ("block", 1_200, mark(pick(JUNK_WORDS, 1), pick(JUNK_WORDS, 2))),
        ("allow", 1_200, mark(pick(PLAIN_WORDS, 3), pick(PLAIN_WORDS, 4))),
        ("allow", 1_600, F.concat(*[pick(syllables, k) for k in (5, 6, 7)])),
    ]
    out = None
    for k, (verdict, n, name) in enumerate(kinds):
        host = F.concat(pick(SUBDOMAINS, 8), name, F.lit("."), pick(SITES, 9), pick(DOMAINS, 10))
        rows = spark.range(10_000 * k, 10_000 * k + n, 1, 1).withColumnRenamed("id", "n")
        rows = rows.select(F.concat(F.lit("https://"), host, pick(PATHS, 11)).alias("url"), F.lit(verdict).alias("verdict"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def url_filter(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules=RULES,
    sizes: tuple[int, ...] = (3, 4),
    dims: int = 1 << 14,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Every row's host, path, rule, verdict and probability of a block.

    ``labelled`` has url and verdict (allow or block), by default the rows of
    ``labelled_urls``; at most ``LABELLED_ROWS`` / 2 of each verdict are learned from. Without
    labels of both kinds, the one kind there is (else allow) is the verdict where no rule
    fits. A null URL, and one without ``://``, has an empty host and path and is judged by
    these; so is an empty one; very long URLs are judged whole. Of rules that fit, the
    longest wins; different rules of one length can't fit the same URL. Null ids pass
    through; repeated rows are judged each; an empty table gives no rows; other columns
    are ignored, whatever their names. Pages aren't shuffled.
    """
    host, path = parts_of(F.col("url"))
    split = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
        .select("page_id", host.alias("host"), path.alias("path"))
    )
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    if labelled is None:
        labelled = labelled_urls(pages.sparkSession)
    known = labelled.select(host.alias("host"), path.alias("path"), "verdict").distinct()
    order = F.xxhash64("host", "path")
    first = lambda v: known.where(F.col("verdict") == v).orderBy(order, "host", "path").limit(LABELLED_ROWS // 2)
    small = stage(first("allow").unionByName(first("block")), "url-labelled")
    counts = {r[0]: r[1] for r in small.groupBy("verdict").count().collect()}  # two rows at most
    if len(counts) < 2:
        only = next(iter(counts), "allow")
        scored = judged.withColumn("block_score", F.lit(1.0 if only == "block" else 0.0))
        return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit(only)).alias("verdict"), "block_score")
    hashed = HashingTF(numFeatures=dims, inputCol="grams", outputCol="features", binary=True)
    features = lambda df: hashed.transform(
        df.withColumn("grams", F.concat(ngrams("h", F.col("host"), sizes), ngrams("p", F.col("path"), sizes)))
    )
    train = features(small.coalesce(1)).select("features", (F.col("verdict") == "block").cast("double").alias("label"))
    model = LogisticRegression(maxIter=40, regParam=1e-4, standardization=False).fit(train.cache())
    train.unpersist()
    scored = model.transform(features(judged))
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.element_at(vector_to_array("probability"), 2).alias("block_score"),
    )
