"""Small documents with every odd case, each operator against a plain version of itself."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F

from caseloom.llm import bpe, exact_dedup, near_dedup, packing, quality, sharding, suffix_array, suffix_dedup, toxicity, url_filter, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(400)}" for _ in range(n)]


def odd_texts():
    base = words(1, 120)
    near = base.copy()
    near[60] = "changed"
    passage = " ".join(words(7, 60))
    return [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base)),
        (4, "\t".join(base)),
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, "one"),
        (9, "one two"),
        (10, "ONE two"),
        (11, "intro " + " ".join(words(2, 30)) + " " + passage),
        (12, passage + " " + " ".join(words(3, 40))),
        (13, "héllo wörld 日本語 \x1c\x85 " + "é" * 70),
        (14, "é" * 70 + " other"),
        (15, "a" * 300),
        (16, "same line\nsame line\n\nother\nsame line\n# $ % & | < > *"),
        (17, " ".join(words(9, 3000))),
        (18, " ".join(words(9, 3000)[:2900])),
        (None, " ".join(base)),
        (None, "no id here"),
        (8, "one"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in odd_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fisher_yates_is_a_permutation_and_repeats():
    for n in (0, 1, 2, 50):
        assert sorted(sharding.fisher_yates(n, 3, 1).tolist()) == list(range(n))
    assert (sharding.fisher_yates(50, 3, 1) == sharding.fisher_yates(50, 3, 1)).all()
    assert (sharding.fisher_yates(50, 3, 1) != sharding.fisher_yates(50, 3, 2)).any()


def test_shards_hold_every_row_once_and_nearly_as_many(docs, none):
    got = sharding.shard_documents(docs, shards=4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(odd_texts())
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    again = sharding.shard_documents(docs.repartition(5), shards=4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharding.op1(none).count() == 0
    digest = {(r.doc_id, r.size, r.text_crc32) for r in sharding.op1(docs).collect()}
    assert digest == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_texts()}


def test_urls(spark):
    rows = [
        (1, "http://WWW.Example.com/en/a?x#y"), (2, "https://example.com"), (3, "http://a.net/fr/x"), (4, None), (5, "no scheme"), (6, ""),
        (7, "http://notexample.com/en/"), (8, "x://b.org/q"), (9, "http://m.example.com/en/1"), (10, "http://net/es/#f"), (1, "http://c.org/?u=http://d/"),
    ]
    df = spark.createDataFrame([(i, u, "h", "clash") for i, u in rows], "page_id long, url string, host string, verdict string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.url_filter(df).collect()}
    assert got[(1, "www.example.com", "/en/a")] == ("www.example.com/en/", "allow")
    assert got[(2, "example.com", "")][0] is None
    assert got[(3, "a.net", "/fr/x")] == ("net/fr/", "block")
    assert got[(4, "", "")][0] is None and (5, "", "") in got and (6, "", "") in got
    assert got[(7, "notexample.com", "/en/")] == ("com/", "allow")
    assert got[(9, "m.example.com", "/en/1")] == ("example.com/en/", "block")
    assert got[(10, "net", "/es/")] == ("net/es/", "block")
    assert (1, "c.org", "/") in got and len(got) == len(rows)
    assert url_filter.url_filter(df.limit(0)).count() == 0
    only = url_filter.url_filter(df.where("page_id = 8"))
    assert only.first().verdict == "allow"


def test_url_model_learns_its_labels(spark):
    good = [(f"http://site{i}.org/news/{i}", "allow") for i in range(60)]
    bad = [(f"http://casino{i}.org/win/{i}", "block") for i in range(60)]
    labelled = spark.createDataFrame(good + bad, "url string, verdict string")
    test = spark.createDataFrame([(1, "http://casino99.org/win/7"), (2, "http://site99.org/news/7")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(test, labelled).collect()}
    assert got == {1: "block", 2: "allow"}


def toxic_docs(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        w = words(i, 40)
        if i % 4 == 0:
            w[i % 40], w[(i * 7) % 40] = "scumbag", "vilestuff"
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (None, "scumbag vilestuff", "en", "s", 0)]
    labels += [(0, 1, 1), (5, 1, None), (None, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_scores(spark, none):
    docs, labels = toxic_docs(spark)
    got = toxicity.op3(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(402) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(r.predicted == int(r.doc_id % 4 == 0 and r.doc_id < 400) for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and (r.score >= 0.3) == (r.predicted == 1) for r in got)
    assert next(r for r in got if r.doc_id is None).predicted == 1
    assert toxicity.op3(none, labels).count() == 0
    assert toxicity.op3(docs, labels.limit(0)).where("score <> 0").count() == 0
    kept = toxicity.score(docs, toxicity.fit(docs, labels))
    assert kept.columns[:5] == docs.columns


def test_a_rare_toxic_word_is_a_term_among_many_examples(spark):
    """In 32 of 2,000 toxic examples only: chi-squared 32, however many examples there are."""
    known = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 4 != 2][:4000]
    rare = set(range(1, 64, 2))
    text = lambda i: f"w{i % 97} rarevile" if i in rare else f"w{i % 97} scumbag" if i % 2 else f"w{i % 97} fine"
    rows = [(d, text(i), "en", "s", 0) for i, d in enumerate(known)] + [(10**6, "rarevile", "en", "s", 0)]
    labels = [(d, 1, i % 2) for i, d in enumerate(known)]
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "rarevile" in model.terms
    scored = toxicity.score(spark.createDataFrame(rows[-1:], SCHEMA), model).first()
    assert scored.toxicity_evidence and scored.toxicity_score >= toxicity.THRESHOLD


def test_block_max_index_is_exact():
    r = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        t = np.unique(r.integers(0, 60, 6))
        w = r.random(len(t))
        vectors.append((t, w / np.sqrt(w @ w)))
    index = toxicity.BlockMaxIndex(vectors, 60)
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(40):
        t, w = vectors[q]
        sims = np.round(np.minimum(dense @ dense[q], 1), 12)
        sims[q] = -1
        want = sorted(((-s, i) for i, s in enumerate(sims) if s > 0))[:10]
        near, which = index.nearest(t, w, 10, without=q)
        assert which.tolist() == [i for _, i in want]
        assert near.tolist() == pytest.approx([-s for s, _ in want])
    tied = toxicity.BlockMaxIndex([vectors[i % 7] for i in range(500)], 60)
    near, which = tied.nearest(*vectors[3], 10)
    assert which.tolist() == list(range(3, 500, 7)) and near == pytest.approx(1)  # all that are as near as the tenth


def components_by_force(rows, k, percent):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies(spark, docs, none, k):
    got = near_dedup.near_dedup(docs, words=k).collect()
    assert len(got) == len(odd_texts())
    want = components_by_force(odd_texts(), k, 80)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_dedup(none).count() == 0


@pytest.mark.parametrize("chunk", [40, 6])
def test_a_large_group_of_near_copies_with_strays(spark, monkeypatch, chunk):
    """Copies edited so much that many link with some only, and some with none."""
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    base, rows = words(5, 150), []
    for i in range(150):
        r = random.Random(i)
        w = base.copy()
        for _ in range(r.choice([1, 2, 4, 8, 12, 16])):
            w[r.randrange(150)] = f"x{i}_{r.randrange(5)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(words(100 + i, 80))) for i in range(30)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_force(rows, 2, 80)


def test_bit_estimate_is_corrected_for_chance():
    r = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.8, 1.0):
        got = []
        for _ in range(30):
            both = r.integers(0, 1 << 63, int(2000 * share)).astype(np.uint64)
            own = [np.unique(np.concatenate([both, r.integers(0, 1 << 63, 1000 - len(both) // 2).astype(np.uint64)])) for _ in range(2)]
            true = len(both) / len(np.unique(np.concatenate(own)))
            a, b = (near_dedup.pack_bits(near_dedup.minima(x)) for x in own)
            x = a ^ b
            equal = near_dedup.HASHES - int(np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
            got.append(near_dedup.estimate(equal) - true)
        assert abs(np.mean(got)) < 0.03


def test_warc_round_trip(spark):
    long, other = "x" * 150 + "\r\n\r\n é", "y" * 100
    rows = [(3, "http://a/", long), (1, "u", "short"), (2, "u", "short"), (5, "u\r\nInjected: 1", long), (4, None, long), (6, "u", None), (7, "u", ""), (None, "u", other), (8, "u", other)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(2)
    got = {r.page_id: r for r in warc.op5(pages).collect()}
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        3: ("response", None), 4: ("revisit", 3), 5: ("revisit", 3), 1: ("response", None), 2: ("response", None),
        6: ("response", None), 7: ("response", None), 8: ("response", None), None: ("revisit", 8),
    }
    index, folder = warc.archive(pages)
    some = warc.read_records(index.where("page_id in (3, 7, 1)"), folder).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in some} == {3: long, 7: "", 1: "short"}
    assert warc.op5(pages.limit(0)).count() == 0


def removed_by_force(rows):
    rows = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, 1 << 63), i)
    out = []
    for i, b in rows:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i if i < 1 << 62 else None, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeated_strings_go(docs, none, monkeypatch):
    got = suffix_dedup.suffix_dedup(docs, with_text=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == removed_by_force(odd_texts())
    assert suffix_dedup.suffix_dedup(none).count() == 0
    whole = {r.doc_id: r.text for r in got if r.doc_id is not None}
    assert whole[1] == dict(odd_texts())[1] and whole[3] == "" and whole[5] == ""


def batch_of(pack):
    zipped = suffix_dedup._zip(pack.text.tobytes())
    cols = [pa.array([0]), *(pa.array([x], pa.binary()) for x in (pack.ids.astype("<i8").tobytes(), pack.sizes.astype("<i8").tobytes(), zipped))]
    return pa.RecordBatch.from_arrays(cols, names=["pack", "ids", "sizes", "body"])


def hot_texts():
    """One passage under 50 bytes in a new context per document, and a few contexts that come again."""
    gram = "this passage of 48 bytes stands in every text !"
    own = [f"{' '.join(words(i, 12))} {gram} {' '.join(words(900 + i, 12))}" for i in range(120)]
    return [(i, t) for i, t in enumerate(own + own[:3] + [own[5][20:] + "z", own[7][:90]])]


def test_repeated_strings_go_where_anchors_are_hot(spark):
    rows = odd_texts() + [(1000 + i, t) for i, t in hot_texts()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot, wide in ((0, 64), (4, 1), (50, 1), (8192, 2)):
        got = suffix_dedup.suffix_dedup(df, hot_segments=hot, wide_packs=wide).collect()
        assert Counter(tuple(r)[:5] for r in got) == removed_by_force(rows)


def test_a_hot_anchor_is_spread_over_tasks():
    """One anchor in many contexts: its segments don't all share a task and a suffix array."""
    data = [t.encode() for _, t in hot_texts()[:120]]
    pack = suffix_dedup.Pack(np.arange(120), np.array([len(t) for t in data]), np.frombuffer(b"".join(data), np.uint8))
    key, n = np.unique(np.concatenate([x.key for x in pack.slices(64)]), return_counts=True)
    assert n.max() >= 100
    table = next(suffix_dedup._send_anchors(64)(iter([batch_of(pack)])))
    known = []
    for part in set(table.column("part").to_pylist()):
        own = pa.Table.from_batches([table]).filter(pc.equal(table.column("part"), part))
        for row in suffix_dedup._known_elsewhere(16, 64)(own).to_pylist():
            keys = suffix_dedup._five(row["keys"]) | np.uint64(part << 40)
            known += list(zip(keys.tolist(), row["flags"], strict=True))
    known.sort()
    keys, flags = np.array([k for k, _ in known], np.uint64), np.array([f for _, f in known], np.uint8)
    assert key[n.argmax()] in keys
    got = pack.segments(keys, flags, 64)
    most = Counter(got.key[got.first].tolist()).most_common(1)[0][1]
    assert most <= 16
    assert max(Counter((got.key[got.first] >> np.uint64(40)).tolist()).values()) < len(got.first) / 8


def test_slices_find_the_anchors_of_the_whole(monkeypatch):
    """Slices of a text meet without a seam, whatever their size."""
    text = " ".join(words(5, 900)).encode() + "é日本".encode() * 40
    sizes = np.array([700, 0, 49, 50, 51, len(text) - 850])
    pack = suffix_dedup.Pack(np.arange(6), sizes, np.frombuffer(text, np.uint8))
    whole = list(pack.slices(7))
    assert len(whole) == 1
    want = list(zip(whole[0].at.tolist(), whole[0].key.tolist(), *(x.tolist() for x in whole[0].ranges(np.arange(len(whole[0].at)))), strict=True))
    for size in (1, 13, 64, 1000):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        got = [
            x for s in pack.slices(7)
            for x in zip(s.at.tolist(), s.key.tolist(), *(y.tolist() for y in s.ranges(np.arange(len(s.at)))), strict=True)
        ]
        assert got == want
        hit = np.random.default_rng(1).random(500) < 0.01
        near = [any(hit[max(0, i - 49) : i + 1]) for i in range(500)]
        assert suffix_dedup.covered(hit).tolist() == near


def test_a_text_longer_than_a_pack(spark):
    """4.5 MB, more than two packs hold; its second half comes again, and so does a short part."""
    half = " ".join(words(31, 500_000))[:2_250_000]
    rows = [(1, half), (2, " ".join(words(77, 30)) + " " + half + " " + half[:2000]), (3, half[1_000_000:1_000_300])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df, with_text=True).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 300
    head = rows[1][1][: -len(half) - 2001]
    assert got[2].n_bytes == len(rows[1][1]) and head.startswith(got[2].text[:100])
    assert len(head) - 60 <= got[2].n_bytes - got[2].n_removed <= len(head) + 120


def test_adjacent_common_prefixes():
    r = np.random.default_rng(8)
    text = np.concatenate([r.integers(97, 99, 300).astype(np.uint8), np.full(80, 255, np.uint8)])
    at = np.array(sorted(range(300), key=lambda p: text[p:].tobytes()))
    got = suffix_array.common_prefixes(text, at, 50).tolist()
    for k in range(1, 300):
        a, b = text[at[k - 1] :].tobytes(), text[at[k] :].tobytes()
        same = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), 50)
        assert got[k] == min(same, 50)
    assert got[0] == 0


def test_two_stage_sort_orders_suffixes():
    r = np.random.default_rng(2)
    for alphabet in (2, 4, 200):
        text = np.concatenate([r.integers(0, alphabet, 400).astype(np.uint8), np.full(80, 255, np.uint8)])
        wanted = np.zeros(len(text), bool)
        wanted[:400] = True
        at = suffix_array.two_stage_sort(text, wanted, 50)
        heads = [text[p : p + 50].tobytes() for p in at.tolist()]
        assert sorted(at.tolist()) == list(range(400)) and heads == sorted(heads)
        small = suffix_array.suffix_types(text)
        assert all(small[i] == (text[i:].tobytes() < text[i + 1 :].tobytes()) for i in range(399))


def stats_by_force(t):
    w = WORD.findall(t)
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_rules(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.op7(docs, labels).collect()
    want = Counter((i, *stats_by_force(t or "")) for i, t in odd_texts())
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.op7(none, labels).count() == 0 and quality.op7(docs, labels.limit(0)).count() == len(odd_texts())


def test_rules_find_the_bad_rows(spark):
    rows, labels = [], []
    for i in range(600):
        w = words(i, 80)
        bad = i % 3 == 0
        rows.append((i, " ".join(x + "###" if bad else x for x in w)))
        labels.append((i, int(not bad)))
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == (r.doc_id % 3 != 0) for r in got)


def test_exact_copies(spark, docs, none, monkeypatch):
    want = {}
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t in odd_texts():
        want.setdefault(norm(t), []).append(i)
    for options in ({}, {"capacity": 1, "depth": 3, "hot_share": 4}, {"capacity": 1}):
        got = exact_dedup.exact_dedup(docs, **options).collect()
        assert len(got) == len(odd_texts())
        by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
        for r in got:
            ids = by[r.text_sha256]
            keep = min((i for i in ids if i is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_chained_texts_of_one_hash_are_told_apart(spark):
    texts = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 7, "a"), (4, 9, "c")], "id long, key long, norm string")
    hot = spark.createDataFrame([(7, True)], "key long, hot boolean")
    for some in (hot, hot.limit(0)):
        index = {r.norm: (r.keep_id, r.group_size, r.chain_size) for r in exact_dedup.build_index(texts, texts, some, 1, 4).collect()}
        assert index == {"a": (1, 2, 2), "b": (2, 1, 2), "c": (4, 1, 1)}


def test_near_copies_of_an_id_with_several_texts(spark):
    """Each row is linked by its own text, also where its id has another one."""
    t = words(50, 100)
    near = t.copy()
    near[50] = "edited"
    rows = [(7, " ".join(words(51, 60))), (7, " ".join(t)), (9, " ".join(near)), (4, " ".join(words(52, 60))), (9, " ".join(words(52, 60)))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(4, 56, 4, True), (7, 56, 7, True), (7, 96, 7, True), (9, 56, 4, False), (9, 96, 7, False)]


def own_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_match_the_library(docs, none):
    enc = own_encoding()
    got = Counter(tuple(r) for r in bpe.bpe_digests(docs, RANKS, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t in odd_texts():
        ids = enc.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    encoded = bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.bpe_decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == Counter((i, t or "") for i, t in odd_texts())
    assert bpe.bpe_digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_replayed_merges_match_on_random_bytes():
    enc, ranks, r = own_encoding(), bpe.load_ranks(RANKS), random.Random(4)
    found = ["".join(r.choice("aabcdeh tionsr .'é日\u0301") for _ in range(r.randrange(1, 40))) for _ in range(1500)] + ["a" * 97, "the" * 50, " " * 33]
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    assert list(codec.encode(found)) == [enc.encode_ordinary(t) for t in found]
    assert bpe.replay([b"", b"the"], bpe.Merges(ranks)) == [[], [ranks[b"the"]]]
    long = "".join(r.choice("ab") for _ in range(3000)) + "a" * 50_000
    assert list(codec.encode([long])) == [enc.encode_ordinary(long)]


def test_probes_go_by_the_directory_and_buckets_are_read_alone(spark):
    texts = spark.range(400).selectExpr("id", "concat('text ', id div 2) as norm").withColumn("key", F.xxhash64("norm"))
    none = spark.createDataFrame([], "key long, hot boolean")
    cells = exact_dedup.written_directory(texts.select("id", "key"), 20, 5)
    index = exact_dedup.build_index(texts, texts, none, 20, 5, cells)
    sizes = {r.bucket: r.n for r in index.groupBy("bucket").agg(F.countDistinct("key").alias("n")).collect()}
    assert len(sizes) > 8 and max(sizes.values()) <= 20
    probes = texts.select("id", "key").where("id < 10").unionByName(spark.createDataFrame([(999, 1)], "id long, key long"))
    found = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.lookup(index, cells, probes, none, 5).collect()}
    assert found == {i: (i - i % 2, 2) for i in range(10)}
    plan = exact_dedup.lookup(index, cells, probes, none, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan.split("Join Inner")[1]
    one = index.where(F.col("bucket") == min(sizes))
    assert "EqualTo(bucket," in one._jdf.queryExecution().executedPlan().toString() and one.count() == sizes[min(sizes)]


def test_packing_is_whole_and_full(docs, none):
    enc = own_encoding()
    got = packing.pack_documents(docs, RANKS, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, window=128, step_windows=4).collect()
    want = Counter((i, (*enc.encode_ordinary(t or ""), 1)) for i, t in odd_texts())
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rows[0].window <= 128 and at & (at - 1) == 0
    whole = Counter()
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for (i, n), parts in pieces.items():
        ids, k = [], 0
        for start, part in sorted(parts):
            if start == 0:
                k += 1
            ids += part
        assert len(ids) == n * k or i is None
        if k == 1:
            whole[(i, tuple(ids))] += 1
    assert all(want[x] for x in whole if x[0] is not None)
    assert sum(r.length for r in got) == sum(len(x[1]) * n for x, n in want.items())
    assert packing.op10(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_special_strings_are_their_ids(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    row = packing.pack_documents(df, RANKS, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}).orderBy("start").collect()
    ids = [x for r in row for x in np.frombuffer(r.ids, "<u4").tolist()]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert ids == [*t.encode("a<|endoftext|>b", add_special_tokens=False).ids, 1]
