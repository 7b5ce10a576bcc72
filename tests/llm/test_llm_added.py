"""Pieces, source divergence and resampling against the library, plain versions and by hand."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece

from caseloom.llm import divergence, pieces, resampling

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows():
    """doc_id, text, lang, source with every odd case."""
    r = random.Random(6)
    word = lambda: f"w{r.randrange(60)}"
    out = [(i, " ".join(word() for _ in range(r.randrange(1, 60))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])) for i in range(60)]
    return out + [
        (60, None, "en", "a"), (61, "", "fr", "z"), (62, " \n\t\x00\x1c ", "fr", "y"), (63, "ÄÉ é 日本語 W1 w1\x85w1　x 12é", "en", "ä"), (64, "w1 w1 w1", "en", "a"), (64, "w1 w1 w1", "en", "a"),
        (None, "no id, W1 w2 w3 " * 9, "en", "b"), (None, "no id, W1 w2 w3 " * 9, "en", "b"), (65, "w1 " * 40_000, "de", "a"), (66, "one lang only", "it", "z"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    typed = "doc_id long, text string, lang string, source string, n_chars long, term string, buckets string, rank string"
    return spark.createDataFrame([(*x, 0, "t", "b", "r") for x in rows()], typed).repartition(5)


def test_pieces_match_the_library(spark, docs):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter()
    for i, t, *_ in rows():
        ids = own.encode(t or "")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(i, len(ids), digest(",".join(map(str, ids))), digest(own.decode(ids)))] += 1
    assert Counter(tuple(r) for r in pieces.piece_digests(docs, MODEL).collect()) == want
    back = pieces.piece_decode(pieces.piece_encode(docs, MODEL), MODEL).collect()
    assert Counter(tuple(r) for r in back) == Counter((i, own.decode(own.encode(t or ""))) for i, t, *_ in rows())
    assert pieces.piece_digests(docs.limit(0), MODEL).count() == 0 and pieces.piece_encode(docs.limit(0), MODEL).count() == 0


def test_merge_rounds_match_on_random_characters():
    own, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(2)
    texts = ["".join(r.choice("aabcdeh tionsr   .'é日́▁\n\x00🙂Ａ") for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "<s> </s><unk><0x0A>", "a" * 97, "the" * 50, " " * 33, " " * 1000 + "x" + " " * 17, "ab" * 3000, "日本語" * 500]
    texts += ["".join(r.choice("ab") for _ in range(3000)) + "a" * 20_000]
    model = pieces.Model(MODEL)
    words = pieces.Words(model, tuple)
    for batch in (texts, texts[::-1]):
        got = [[i for w in found for i in w] for found in words.of(batch)]
        assert got == own.encode(batch)
        assert [pieces.decode_ids(ids, model).decode() for ids in got] == [own.decode(ids) for ids in got]
    assert pieces.merge_rounds(["", " the", ""], model) == [[], own.encode("the"), []]


def test_pieces_are_the_same_with_few_words_kept(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 3)
    model, texts = pieces.Model(MODEL), ["one two three four five", "six one two", "", "one"]
    words = pieces.Words(model, tuple)
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [[i for w in found for i in w] for t in texts for found in words.of([t])] == own.encode(texts)


def divergence_by_force(least_docs, top):
    """The same from dense tables of every group and kept term."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows():
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = term.findall((text or "").translate(LOWER))
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, k in df[lang].items() if k >= least_docs)
        whole = sum((n[g] for g in groups if g[0] == lang), Counter())

        def share(counts, kept=kept):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept}

        p, q = share(n[lang, source]), share(whole)
        pairs = []
        for other in (g for g in groups if g[0] == lang and g[1] != source):
            o = share(n[other])
            pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other[1].encode()))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(items)[:most])]
    return Counter(out)


def test_divergence_by_force(docs, monkeypatch):
    assert Counter(tuple(r) for r in divergence.divergence(docs).collect()) == divergence_by_force(3, 200)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    assert Counter(tuple(r) for r in divergence.divergence(docs, 2, 4).collect()) == divergence_by_force(2, 4)
    lonely = divergence.divergence(docs, 10**6).collect()  # no kept terms: pairs of value 0 alone
    assert lonely and {(r.part, r.value) for r in lonely} == {("pair", 0)}
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_terms_are_cut_by_one_table():
    assert divergence.term_counts("ABc,abC 1x_é É\x1f日".encode()) == {b"abc": 2, b"x": 1, "é É".encode(): 1, "日".encode(): 1}


def resampled_by_force(target, least, most, least_words, percent):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def cut(text):
        w = word.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    found = [(i, *cut(t)) for i, t, *_ in rows()]
    s, t = Counter(b for _, _, x in found for b in x), Counter(b for x in target for b in cut(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, n, x in found:
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1 if k < percent * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return Counter(drawn + [(*r[:4], None) for r in out if r[4] < least_words])


def test_resampling_by_force(spark, docs):
    target = ["w1 w2 W3, w4", None, "", "w1 w2 日本語"]
    wanted = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, buckets string")
    for least, most, words, percent in ((1, 1, 20, 10), (1, 3, 2, 50), (2, 2, 0, 100)):
        got = resampling.resample(docs, wanted, least, most, least_words=words, percent=percent).collect()
        assert Counter(tuple(r) for r in got) == resampled_by_force(target, least, most, words, percent)
    assert resampling.resample(docs.limit(0), wanted).count() == 0
    got = resampling.resample(docs, wanted.limit(0)).collect()
    assert Counter(tuple(r) for r in got) == resampled_by_force([], 1, 1, 20, 10)


def test_ranks_go_on_over_ranges(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as score").repartition(6)
    from pyspark.sql import functions as F

    got = {r.id: r["rank"] for r in resampling.ranked(df, [F.desc("score"), "id"], 900).collect()}
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert got == {i: k + 1 if k < 900 else None for k, i in enumerate(want)}
