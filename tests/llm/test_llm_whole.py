"""Operators against plain versions of themselves end to end, and odd tables."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from caseloom.llm import bpe, exact_dedup, near_dedup, packing, quality, sharding, suffix_dedup, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
there = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def url_by_force(url):
    at = url.find("://") if url is not None else -1
    rest = "" if at < 0 else url[at + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


@there
def test_every_page_is_judged_as_by_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    assert got.keys() == urls.keys()
    junk = ("casino", "bets", "pills")
    for i, url in urls.items():
        host, path, rule, verdict = url_by_force(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if any(w in host for w in junk) else "allow"))


def test_url_model_on_rows_that_it_did_not_see(spark):
    """The default table is balanced over domains, and four fifths of it predict the rest."""
    rows = url_filter.labelled_urls(spark).withColumnRenamed("n", "page_id")
    kinds = Counter((r.url.split("/")[2].rsplit(".", 1)[1], r.verdict) for r in rows.collect())
    assert len(rows.collect()) <= url_filter.LABELLED_ROWS and len(kinds) == 2 * len(url_filter.DOMAINS)
    ends = {d: kinds[d, "block"] / (kinds[d, "block"] + kinds[d, "allow"]) for d in url_filter.DOMAINS}
    assert max(ends.values()) - min(ends.values()) < 0.1
    train, test = rows.where("page_id % 5 > 0"), rows.where("page_id % 5 = 0")
    got = {r.page_id: r for r in url_filter.url_filter(test, train, rules=()).collect()}
    want = {r.page_id: r.verdict for r in test.collect()}
    assert sum(got[i].verdict == v for i, v in want.items()) >= 0.93 * len(want)


def test_url_model_on_words_that_it_did_not_see(spark):
    """Of hosts made of left-out words few are blocked, and most of those that are should be (README has the recall)."""
    held = {*url_filter.JUNK_WORDS[::4], *url_filter.PLAIN_WORDS[::4]}
    own = {*url_filter.JUNK_WORDS, *url_filter.PLAIN_WORDS} - held
    rows = [(r.n, r.url, r.verdict) for r in url_filter.labelled_urls(spark).collect()]
    has = lambda r, words: any(w in r[1].split("/")[2] for w in words)
    table = lambda some: spark.createDataFrame(some, "page_id long, url string, verdict string")
    new = [r for r in rows if has(r, held) and not has(r, own)]
    got = {r.page_id: r.verdict for r in url_filter.url_filter(table(new), table([r for r in rows if not has(r, held)]), rules=()).collect()}
    right, wrong = (sum(v == kind and got[i] == "block" for i, _, v in new) for kind in ("block", "allow"))
    assert right > 0 and right / (right + wrong) >= 0.6
    assert wrong <= 0.05 * sum(v == "allow" for _, _, v in new)


def test_archives_are_read_by_as_many_tasks_as_their_bytes_need(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"http://x/{i}", rng.bytes(3000).hex()) for i in range(200)]
    index, folder = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    total = index.agg({"length": "sum"}).first()[0]
    read = warc.read_records(index, folder, span=100_000)
    assert read.rdd.getNumPartitions() == -(-total // 100_000) > 5
    assert {r.page_id: bytes(r.payload).decode() for r in read.collect()} == {i: h for i, _, h in rows}


def test_a_reader_holds_few_unpacked_payloads(spark):
    """Well-packed payloads leave the task range by range, and within a range by their bytes."""
    rows = [(i, f"http://x/{i}", f"{i:06d}" * 10_000) for i in range(40)]
    index, folder = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    batches = index.select("page_id", "file", "offset", "length").toArrow().sort_by([("file", "ascending"), ("offset", "ascending")]).combine_chunks().to_batches()
    for most, hold, largest in ((4 << 20, 250_000, 5), (4 << 20, 16 << 20, 40), (1500, 16 << 20, 12)):
        read = list(warc.range_reader(folder, 64 << 10, most, hold)(iter(batches)))
        assert max(b.num_rows for b in read) <= largest and len(read) >= 40 // largest
        assert [x for b in read for x in b.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read_records(index, folder).collect()} == {i: h for i, _, h in rows}


def toxicity_by_force(rows, labels):
    """Scores with plain dictionaries: terms, document frequencies, cosines, votes, calibration."""
    text = {i: t or "" for i, t in rows}
    known = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    n = [sum(y == k for y in known.values()) for k in (0, 1)]
    seen = [Counter(), Counter()]
    for i, y in known.items():
        seen[y].update(toxicity.term_counts(text[i]).keys())

    def apart(t):
        a, b = seen[1][t], seen[0][t]
        if a + b < toxicity.LEAST_SUPPORT or a + b == sum(n):
            return False
        return sum(n) * (a * (n[0] - b) - b * (n[1] - a)) ** 2 / ((a + b) * (sum(n) - a - b) * n[0] * n[1]) >= toxicity.LEAST_CHI2

    terms = {t for t in seen[0].keys() | seen[1].keys() if apart(t)}
    counts = {i: {t: c for t, c in toxicity.term_counts(x).items() if t in terms} for i, x in text.items()}
    df = Counter(t for c in counts.values() for t in c)

    def vector(c):
        v = {t: (1 + math.log(k)) * math.log1p(len(text) / df[t]) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(c) for i, c in counts.items()}
    examples = sorted((i for i in known if vectors[i]))
    prior = n[1] / sum(n)

    def vote(v, without=None):
        near = [(round(min(1.0, sum(x * vectors[j].get(t, 0) for t, x in v.items())), 12), j) for j in examples if j != without]
        near = sorted((x for x in near if x[0] > 0), key=lambda x: -x[0])
        near = [x for x in near if x[0] >= near[min(len(near), toxicity.NEIGHBOURS) - 1][0]]
        return (0.2 * prior + sum(s * s * known[j] for s, j in near)) / (0.2 + sum(s * s for s, _ in near)), near

    bare = [known[i] for i in known if not vectors[i]]
    none = (sum(bare) + prior) / (len(bare) + 1)
    x, y = toxicity.isotonic(np.array([vote(vectors[i], i)[0] for i in examples]), np.array([float(known[i]) for i in examples]), np.ones(len(examples)))
    knots = np.r_[0.0, x, 1.0], np.r_[min(none, y[0]), y, max(y[-1], 0.99)]
    out = {}
    for i, v in vectors.items():
        raw, near = vote(v)
        out[i] = float(np.interp(raw, *knots)) if near else none
    return out


def test_toxicity_scores_as_by_force(spark):
    """Some texts come twice, so neighbours are equally near: all of them vote."""
    r = np.random.default_rng(12)
    bad, good = [f"vile{k}" for k in range(6)], [f"kind{k}" for k in range(6)]
    rows, labels = [], {}
    for i in range(300):
        toxic = i % 3 == 0
        words = [f"w{x}" for x in r.integers(0, 50, 20)]
        for w in r.choice(bad if toxic else good, 4):
            words += [w] * int(r.integers(1, 9))
        if i % 11:
            words += [str(r.choice(good if toxic else bad))] * int(r.integers(1, 3))
        rows.append((i, " ".join(words) if i % 7 or i < 20 else rows[i - 14][1]))
        labels[i] = int(toxic)
    rows += [(900, ""), (901, None), (902, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    want = toxicity_by_force(rows, labels)
    got = {r.doc_id: r.score for r in toxicity.op3(docs, table).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_one_kind_of_label_tells_nothing(spark):
    docs = spark.createDataFrame([(i, f"vile words {i}") for i in range(40)], "doc_id long, text string")
    for y in (0, 1):
        labels = spark.createDataFrame([(i, 1, y) for i in range(40)], "doc_id long, quality int, toxic int")
        assert toxicity.op3(docs, labels).where("predicted = 1").count() == 0


def test_many_rows_of_one_labelled_id(spark, monkeypatch):
    """Examples are bounded by rows, not by ids alone."""
    monkeypatch.setattr(toxicity, "EXAMPLES", 50)
    rows = [(1, f"vile thing {i}") for i in range(300)] + [(i, f"kind thing {i}") for i in range(3, 200)]
    labels = [(1, 1, 1)] + [(i, 1, 0) for i in range(3, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.index.size <= 100


CLASH = "doc_id long, text string, page_id long, url string, html string, __id string, __text string, __key string, __n string, __words string, key string, norm string, id string, hot string, node string, digest string, bands string, row string, pack string, part string, body string, toxicity_score string, label string, kept string, n_words string, host string, path string, ids string, payload_digest string, shard string, slot string, sequence_id string"


def test_clashing_names_do_no_harm(spark):
    """Extra columns with the operators' own names, in every operator."""
    names = [c.split()[0] for c in CLASH.split(", ")]
    value = lambda i, c: {"doc_id": i, "page_id": i, "text": f"some words of text {i % 7}", "url": f"http://a.org/{i}", "html": f"<p>{i}</p>"}.get(c, "x")
    docs = spark.createDataFrame([tuple(value(i, c) for c in names) for i in range(20)], CLASH)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    for got in (
        sharding.op1(docs),
        url_filter.url_filter(docs),
        toxicity.op3(docs, labels),
        toxicity.score(docs, toxicity.fit(docs, labels)),
        near_dedup.near_dedup(docs),
        near_dedup.near_dedup(docs, with_rows=True),
        warc.op5(docs),
        suffix_dedup.suffix_dedup(docs),
        quality.op7(docs, labels),
        exact_dedup.exact_dedup(docs),
        bpe.bpe_digests(docs, RANKS, public_tokenizers.PATTERN),
    ):
        assert got.count() == 20
    assert packing.op10(docs, RANKS, public_tokenizers.PATTERN).select("doc_id").distinct().count() == 20
    assert toxicity.score(docs, toxicity.fit(docs, labels)).columns.count("toxicity_score") == 1


def test_many_equal_records_are_spread(spark):
    """A third of all rows are one record: its copies go to all buckets."""
    rows = [(7, "same")] * 2_000 + [(i, f"own {i}") for i in range(4_000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, hot_share=8, bucket_bytes=20_000).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert {r.shard for r in got} == {0, 1, 2, 3}
    copies = Counter(r.shard for r in got if r.text == "same")
    assert max(copies.values()) < 700
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(1_500))


def learned_by_force(rows, max_rules=6, max_conditions=3, thresholds=24, precision=0.95):
    """Sequential covering over plain lists: rules as lists of (feature, at least, bound)."""
    names = list(quality.FEATURES)
    bad = [r for r in rows if r["bad"]]
    probs = [(i + 1) / (thresholds + 1) for i in range(thresholds)]
    cuts = {f: sorted(set(np.quantile([r[f] for r in bad], probs).tolist())) if bad else [] for f in names}
    holds = lambda r, cs: all(r[f] >= x if up else r[f] <= x for f, up, x in cs)
    count = lambda some: (sum(r["bad"] for r in some), sum(1 - r["bad"] for r in some))
    rules, left = [], rows
    while len(rules) < max_rules:
        grow, prune = [r for r in left if r["part"]], [r for r in left if not r["part"]]
        p, n = count(grow)
        if not p or not n:
            break
        conditions, some = [], grow
        while n and len(conditions) < max_conditions:
            best = None
            for f in names:
                for x in cuts[f]:
                    for up in (True, False):
                        bound = x if up else math.nextafter(x, -math.inf)
                        a, b = count([r for r in some if holds(r, [(f, up, bound)])])
                        if a and a + b < p + n:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))
                            if best is None or gain > best[0] + 1e-12:
                                best = gain, (f, up, bound)
            if best is None or best[0] <= 0:
                break
            conditions.append(best[1])
            some = [r for r in some if holds(r, conditions)]
            p, n = count(some)
        if not conditions:
            break
        worth = [count([r for r in prune if holds(r, conditions[: k + 1])]) for k in range(len(conditions))]
        score = [(a - b) / (a + b) if a + b else -1.0 for a, b in worth]
        at = score.index(max(score))
        a, b = worth[at]
        if not a or a / (a + b) < precision:
            break
        rules.append(conditions[: at + 1])
        left = [r for r in left if not holds(r, rules[-1])]
    return rules


def test_rules_are_those_of_plain_covering(spark):
    """Two planted kinds of bad rows, one that takes two conditions, and noise that pruning cuts."""
    r = np.random.default_rng(21)
    names = list(quality.FEATURES)
    rows = []
    for i in range(900):
        row = {f: round(float(x), 3) for f, x in zip(names, r.random(len(names)), strict=True)}
        bad = row[names[0]] > 0.85 or (row[names[1]] > 0.6 and row[names[2]] < 0.35)
        rows.append(row | {"bad": int(bad), "part": i % 3})
    schema = ", ".join(f"{f} double" for f in names) + ", bad int, part int"
    df = spark.createDataFrame([tuple(x[c] for c in [*names, "bad", "part"]) for x in rows], schema)
    got = [[(c.feature, c.at_least, c.bound) for c in rule.conditions] for rule in quality.learn(df.coalesce(1))]
    want = learned_by_force(rows)
    assert [[c[:2] for c in rule] for rule in got] == [[c[:2] for c in rule] for rule in want]
    assert [c[2] for rule in got for c in rule] == pytest.approx([c[2] for rule in want for c in rule], abs=1e-9)
    assert len(want) >= 2 and max(map(len, want)) >= 2


@there
def test_packed_ids_are_those_of_the_vocabulary_file(spark):
    """The encoder of the packing gives the ids of ``tokenizers`` for every document and odd strings."""
    tokenizers = pytest.importorskip("tokenizers")
    slow = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n\n \t", "é日本 \x1c\x85​", "a" * 5000, "it's we'll I'D", "  two  spaces ", "<|endoftext|> in <|endoftext|>", "́́", "🙂🙃 x", "12345 67.8,9"]
    special = {"<|endoftext|>": 50256}
    fast = packing.encoder(RANKS, public_tokenizers.PATTERN, tuple(special.items()))
    for t in texts:
        ids = fast.encode(t, allowed_special="all") if any(m in t for m in special) else fast.encode_ordinary(t)
        assert ids == slow.encode(t, add_special_tokens=False).ids


def test_marks_let_all_wanted_rows_through(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as row", "'t' as text")
    wanted = rows.where("doc_id % 7 = 0").select("doc_id", "row")
    for bits, most in ((1 << 27, 10), (1 << 15, 100), (64, 3000)):
        monkeypatch.setattr(near_dedup, "MARK_BITS", bits)
        got = {r.doc_id for r in near_dedup._marked(rows, wanted, ["doc_id", "row"]).collect()}
        want = set(range(0, 3000, 7))
        assert want <= got and len(got - want) <= most
