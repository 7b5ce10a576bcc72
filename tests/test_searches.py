"""Searches by brute force, every query against every row."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from caseloom.operators import retrieve, search
from caseloom.plans import evidence
from caseloom.sources import cases

SF = "/root/testdata/sf0.001"


def test_cosine_topk_by_force(spark):
    x = np.random.default_rng(4).normal(size=(90, 8))
    x[50] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    q = df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieve.cosine_topk(q, df, 5).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    for i in range(0, 90, 20):
        near = sorted(range(90), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:5]
        assert [got[(i, n + 1)] for n in range(5)] == near


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_query_sets_are_whole(spark):
    emb = evidence.base(spark, SF, "embeddings")
    found = {r.query_id for r in evidence.cosine_topk(spark, SF).collect()}
    assert found == {r.vec_id for r in emb.where("vec_id % 20 = 0").collect()}
    assert evidence.fault_shortlist(spark, SF).select("vec_id").distinct().count() == emb.count()


def sparse_rows(groups=12, each=150):
    """Rows of a few words of their group, all with one common word; ids in mixed order."""
    r = random.Random(8)
    rows = []
    for i in range(groups * each):
        g = i % groups
        rows.append((i, {"common": 1.0} | {f"g{g}w{r.randrange(40)}": 1.0 + r.randrange(3) for _ in range(6)}))
    rows += [(groups * each + i, {}) for i in range(5)] + [(groups * each + 5 + i, dict(rows[3][1])) for i in range(40)]
    return rows


def unit(words):
    norm = math.sqrt(sum(w * w for w in words.values()))
    return {t: w / norm for t, w in words.items()}


def test_text_topk_by_force(spark):
    rows = sparse_rows()
    flat = [(i, t, w) for i, words in rows for t, w in unit(words).items()] if rows else []
    vectors = spark.createDataFrame(flat, "doc_id long, term string, weight double").repartition(4)
    ids = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    queries = vectors.where("doc_id % 20 = 3 or doc_id = 1801").withColumnRenamed("doc_id", "query_id")
    asked = ids.where("doc_id % 20 = 3 or doc_id = 1801").withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in retrieve.text_topk(queries, vectors, ["query_id"], ["doc_id"], [], 9, asked=asked, rows=ids).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.vector_score, 9)))
    every = {i: unit(words) if words else {} for i, words in rows}
    assert set(got) == {i for i in every if i % 20 == 3 or i == 1801}
    for q in got:
        scores = [(round(sum(w * every[i].get(t, 0) for t, w in every[q].items()), 9), i) for i in every]
        assert got[q] == [(i, pytest.approx(s, abs=2e-9)) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:9]]
    assert got[1801] == [(i, 0) for i in range(9)]  # a query without words has the first rows


def test_blocks_that_cannot_matter_are_left_out(spark):
    """All rows share a word, so all pairs do; few of them are scored."""
    rows = [x for x in sparse_rows(24, 100) if x[1]]
    vectors = spark.createDataFrame([(i, t, w) for i, words in rows for t, w in unit(words).items()], "doc_id long, term string, weight double")
    queries = vectors.where("doc_id % 20 = 3").withColumnRenamed("doc_id", "query_id")
    blocks = search.text_blocks(vectors, ["doc_id"], [])
    _, rest, asked = search.text_candidates(queries, blocks, ["query_id"], [], 5)
    n = asked.count()
    assert (rest.count() + n * search.FIRST_BLOCKS) * search.TEXT_BLOCK < 0.35 * n * len(rows)


def test_search_keeps_to_its_case_and_fills_up(spark):
    v = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 2, "x", 1.0), ("a", 3, "y", 1.0)], "case_id string, row long, term string, weight double")
    rows = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 2)], "case_id string, row long")
    q = spark.createDataFrame([("a", 0, "x", 1.0), ("b", 0, "y", 1.0)], "case_id string, q long, term string, weight double")
    got = retrieve.text_topk(q, v, ["case_id", "q"], ["case_id", "row"], ["case_id"], 3, rows=rows).orderBy("case_id", "rank").collect()
    assert [(r.case_id, r.row, r.vector_score, r["rank"]) for r in got] == [("a", 1, 1.0, 1), ("a", 0, 0.0, 2), ("a", 2, 0.0, 3), ("b", 2, 0.0, 1)]


def clustered(n=2400, centres=40, dims=16, spread=0.03):
    rng = np.random.default_rng(7)
    c = rng.normal(size=(centres, dims))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c[np.arange(n) % centres] + spread * rng.normal(size=(n, dims))


def test_cells_that_cannot_matter_are_left_out(spark):
    x = clustered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    q = df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieve.cosine_topk(q, df, 5, pivots=30).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, len(x), 20):
        assert [got[i, n + 1] for n in range(5)] == sorted(range(len(x)), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:5]
    pivot = search.pivots_of(df, 30)
    placed = search.in_cells(df, "vec_id", "embedding", pivot).collect()
    cells = {}
    for r in placed:
        lo, hi = cells.get(r.cell, (9, -9))
        cells[r.cell] = min(lo, r.lo), max(hi, r.hi)
    last = {i: float(u[i] @ u[got[i, 5]]) for i in range(0, len(x), 20)}
    known = spark.createDataFrame(list(last.items()), "id long, score double")
    asked = search.in_cells(q, "query_id", "query", pivot).select("id", "unit")
    sent = search.cells_asked(asked, known, cells, pivot).count()
    assert len(last) <= sent < 0.3 * len(last) * len(cells)


def test_a_very_common_vector_is_few_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3000)] + [(5000, [0.6, 0.8]), (5001, None), (5002, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 1.0])], "query_id long, query array<double>")
    got = {}
    for r in retrieve.cosine_topk(q, df, 4, pivots=2).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got == {7: [(i, 1.0) for i in range(4)], 8: [(5000, 0.8), (0, 0.0), (1, 0.0), (2, 0.0)]}


def test_only_files_of_asked_cases_are_opened(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0], f"c{i % 3}") for i in range(9)], "vec_id long, embedding array<double>, case_id string")
    cases.write_vectors(df.coalesce(1), str(tmp_path))
    for f in (tmp_path / "case_id=c1").glob("*.parquet"):
        f.write_bytes(b"not a parquet file")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    q = spark.createDataFrame([("c0", 1, [1.0, 0.0]), ("c2", 1, [0.0, 1.0]), ("gone", 2, [1.0, 0.0])], "case_id string, query_id long, query array<double>").where("query_id < 9")
    q.write.parquet(str(tmp_path / "../q"), mode="overwrite")
    q = spark.read.parquet(str(tmp_path / "../q")).where("query_id < 9")
    got = search.case_topk(q, cases.read_vectors(spark, str(tmp_path), "vec_id long, embedding array<double>, case_id string", q), 2)
    assert sorted((r.case_id, r.query_id, r.vec_id, r["rank"]) for r in got.collect()) == [("c0", 1, 3, 2), ("c0", 1, 6, 1), ("c2", 1, 2, 1), ("c2", 1, 5, 2)]


def test_rows_of_equal_words_are_few_before_they_are_weighed(spark):
    """Readings that differ in numbers only are one vector: the first k of them can be hits, all were weighed and shuffled."""
    from pyspark.sql import functions as F

    from caseloom.operators import hybrid

    r = random.Random(3)
    texts = [r.choice(["[metric] s quantity={}", "Metric {} s: quantity", "{} error late", "{}"]).format(i) for i in range(3000)]
    order = r.sample(range(3000), 3000)
    rows = [(f"r{i % 2}", i % 3, order[i], t, ("metrics", "logs", "events")[i % 3]) for i, t in enumerate(texts)] + [("r0", 0, 9000, None, "metrics")]
    obs = spark.createDataFrame(rows, "case_id string, mod_ord int, row_ord long, text string, modality string").repartition(3)
    queries = spark.createDataFrame([("r0", 0, "quantity metric"), ("r0", 1, "ERROR"), ("r1", 0, "nothing here"), ("r1", 1, "late s")], "case_id string, query_ord int, text string")
    few = retrieve.first_of_equal(obs, ["case_id"], ["mod_ord", "row_ord"], 5)
    assert few.count() < 500 and few.select("case_id", "mod_ord", "row_ord").distinct().count() == few.count()
    # By another encoder numbers may count, so only equal texts are equal.
    assert retrieve.first_of_equal(obs, ["case_id"], ["mod_ord", "row_ord"], 5, encoder=len).select("text").distinct().count() == len(set(texts))
    got = {}
    for x in hybrid.search(obs, queries, 5).orderBy("rank").collect():
        got.setdefault((x.case_id, x.query_ord), []).append((x.mod_ord, x.row_ord, round(x.vector_score, 6)))
    words = lambda t: [w for w in __import__("re").split("[^a-z]+", (t or "").lower()) if w]
    def cosine(a, b):
        n = lambda x: math.sqrt(sum(x.count(w) ** 2 for w in set(x))) or 1
        return sum(a.count(w) * b.count(w) for w in set(a)) / n(a) / n(b)
    for q in queries.collect():
        every = sorted((-round(cosine(words(q.text), words(t)), 9), m, o) for c, m, o, t, _ in rows if c == q.case_id)[:5]
        assert got[q.case_id, q.query_ord] == [(m, o, pytest.approx(-s, abs=1e-6)) for s, m, o in every]
    assert not few.where(F.col("text").isNull()).count()


def test_the_head_of_a_modality_sorts_few_rows(spark, monkeypatch):
    """Only rows up to the run of the n-th key are sorted; ties, null keys and modalities of fewer rows are kept right."""
    monkeypatch.setattr(retrieve, "HEAD_RUN", 16)
    r = random.Random(5)
    rows = [("a", "metrics", r.randrange(400), f"e{r.randrange(9)}", f"t{i}") for i in range(2000)] + [("a", "logs", i, None, "x") for i in range(7)]
    rows += [("b", "logs", None if i < 30 else i % 3, f"e{i % 4}", f"t{i}") for i in range(90)] + [("c", "logs", None if i < 5 else i, "e", f"t{i}") for i in range(40)]
    obs = spark.createDataFrame(rows, "case_id string, modality string, row_ord long, entity_id string, text string").repartition(3)
    low = lambda v: (v is not None, v if v is not None else 0)
    want = []
    for key in sorted({x[:2] for x in rows}):
        want += sorted((x for x in rows if x[:2] == key), key=lambda x: (low(x[2]), (x[3] is not None, x[3] or ""), x[4]))[:20]
    head = retrieve.head_per_modality(obs, 20)
    assert sorted(map(tuple, head.collect()), key=str) == sorted(want, key=str)
    plan = head._jdf.queryExecution().optimizedPlan().toString()
    assert "__last" in plan and plan.index("Window [row_number()") < plan.index("__last")


def test_search_of_many_queries_writes_no_row_for_each_query_and_block(spark, monkeypatch):
    """What is written grows with rows and hits, not with queries times blocks."""
    rows = [x for x in sparse_rows(24, 100) if x[1]]
    vectors = spark.createDataFrame([(i, t, w) for i, words in rows for t, w in unit(words).items()], "doc_id long, term string, weight double")
    queries = vectors.where("doc_id % 20 = 3").withColumnRenamed("doc_id", "query_id")
    written, stage = [], search.stage
    monkeypatch.setattr(search, "TEXT_BLOCK", 8)
    monkeypatch.setattr(search, "stage", lambda df, *rest: written.append(stage(df, *rest)) or written[-1])
    n, k = queries.select("query_id").distinct().count(), 5
    assert retrieve.text_topk(queries, vectors, ["query_id"], ["doc_id"], [], k).count() == n * k
    assert sum(df.count() for df in written) <= len(rows) + n * (k + 1)


def test_products_of_small_and_large_blocks_agree(spark, monkeypatch):
    """Blocks of any size have the same hits, ties by key; terms go by matrices or entry by entry alike."""
    rows = sparse_rows()
    vectors = spark.createDataFrame([(f"k{i}", i % 3, t, w) for i, words in rows for t, w in unit(words).items()], "a string, b long, term string, weight double").repartition(3)
    queries = vectors.where("b = 1").selectExpr("a as q", "term", "weight")
    found = []
    for most in (1024, 50):
        monkeypatch.setattr(search, "PRODUCT_ROWS", most)
        top = search.text_topk(queries, vectors, ["q"], ["a", "b"], [], 4)
        found.append(sorted((r.q, r["rank"], r.a, r.b, round(r.vector_score, 8)) for r in top.collect()))
    assert found[0] == found[1]
    got = {(q, rank): (a, b) for q, rank, a, b, _ in found[0]}
    every = [(f"k{i}", i % 3, unit(words)) for i, words in rows if words]
    for q, b, own in every[::50]:
        if b == 1:
            best = sorted((-round(sum(w * x.get(t, 0) for t, w in own.items()), 9), a, b) for a, b, x in every)[:4]
            assert [got[q, n + 1] for n in range(4)] == [(a, b) for _, a, b in best]
    one, other = [search._Block(pa.scalar(r.body)) for r in search.pack_vectors(search.term_lists(vectors, ["a", "b"]), ["a", "b"], "packed").collect()][:2]
    by_force = [[sum(w * x.get(t, 0) for t, w in own.items()) for x in (unit(dict(rows)[int(i["a"][1:])]) for i in other.ids.to_pylist())] for own in (unit(dict(rows)[int(i["a"][1:])]) for i in one.ids.to_pylist()[:20])]
    for share, step in ((0.0, 1 << 21), (2.0, 100), (1 / 300, 1000)):
        monkeypatch.setattr(search, "DENSE_SHARE", share)
        monkeypatch.setattr(search, "PAIR_STEP", step)
        assert np.allclose(search._products(one, other)[:20], by_force, atol=1e-12)


def test_copies_of_a_text_are_scored_once(spark, monkeypatch):
    """Every copy of a text was multiplied with every query, and every copy of a query with every text."""
    from pyspark.sql import functions as F

    words = "alpha beta gamma delta".split()
    texts = [None if i % 31 == 0 else " ".join(words[: 1 + i % 3] * (1 + i % 2) + ["own"] * (i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, copies = retrieve.first_texts(docs, "doc_id")
    assert sorted(r.text for r in first.collect()) == sorted({t for t in texts if t})
    assert {r.doc_id: texts[r.first] for r in copies.collect()} == {i: t for i, t in enumerate(texts) if t and texts.index(t) != i}
    monkeypatch.setattr(retrieve, "FILTER_BITS", 1 << 15)  # so that some keys are taken for a copy's wrongly
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 12_000).cast("string")).alias("text"))
    assert retrieve.first_texts(many, "doc_id")[0].select("doc_id").distinct().count() == 12_000
    monkeypatch.setattr(evidence, "base", lambda *_: docs)
    met, real = [], search.text_products
    monkeypatch.setattr(search, "text_products", lambda q, v, *a: (met.extend([q.count(), v.count()]), real(q, v, *a))[1])
    key = ("query_id", "rank", "doc_id", "vector_score")
    got = sorted(tuple(r[c] for c in key) for r in evidence.text_topk(spark, "").collect())
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    q, v = retrieve.term_weights(asked, ["query_id"], listed=True), retrieve.term_weights(docs, ["doc_id"], listed=True)
    want = retrieve.text_topk(q, v, ["query_id"], ["doc_id"], [], asked=asked, rows=docs)
    assert got == sorted((r.query_id, r.rank, r.doc_id, round(r.vector_score, 6)) for r in want.collect())
    assert met[:2] == [len({t for t in texts[::20] if t}), len({t for t in texts if t})]
