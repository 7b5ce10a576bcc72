"""The pipeline on a small corpus with planted cases."""

import random

import pytest


def test_stages_take_effect(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(3)
    make = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(120):
        w = make(90)
        if i % 4 == 0:
            w[5], w[40], w[70] = "scumbag", "vilestuff", "scumbag"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    passage = " ".join(make(60))
    clean = " ".join(make(100))
    near = clean.split(" ")
    near[50] = "edited"
    rows += [(200, clean), (201, clean), (202, clean.replace(" ", "\n")), (203, " ".join(near)), (204, " ".join([*make(40), passage, *make(40)])), (205, passage), (206, None), (None, "some text without an id"), (None, "another without an id")]
    rows += [(210, "first text of an id that comes twice"), (210, "second text of an id that comes twice")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    steps, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, f) in enumerate(pipeline.STAGES):
        out = f(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        at = steps[name] = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert at.columns == docs.columns
    ids = lambda name: {x.doc_id for x in steps[name].select("doc_id").collect()}
    assert ids("toxicity") == {i for i, _ in rows if i is None or i >= 200 or i % 4}
    assert ids("exact dedup") == ids("toxicity") - {201, 202}
    assert ids("near dedup") == ids("exact dedup") - {203}
    cut = {x.doc_id: x for x in steps["suffix dedup"].collect()}
    texts = lambda name, i: sorted(x.text for x in steps[name].collect() if x.doc_id == i)
    assert texts("suffix dedup", None) == ["another without an id", "some text without an id"]
    assert texts("suffix dedup", 210) == texts("near dedup", 210) != []
    assert set(cut) == ids("near dedup")
    assert passage in cut[204].text and cut[205].text == "" and cut[205].n_chars == 0
    assert steps["packing"].where("doc_id = 204").count() >= 1
    assert pipeline.run(spark, str(tmp_path)).count() == steps["packing"].count()


def test_verdicts_are_of_rows_not_of_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, id string, none string, row string, left string, toxicity_score double, __left string"
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(3, "x"), (5, "x"), (5, "y"), (None, "x"), (None, "z"), (None, "z"), (6, "q  q"), (6, "q q"), (7, long), (9, long + " end"), (None, long + " fin"), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d", 0.5, "e") for i, t in rows], schema)
    exact = pipeline.exact_stage(spark, docs, "")
    assert exact.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in exact.collect()), key=str)
    assert got == sorted([(3, "x"), (5, "y"), (None, "z"), (6, "q  q"), (7, long), (9, long + " end"), (None, long + " fin"), (8, None)], key=str)
    near = pipeline.near_stage(spark, exact, "")
    assert near.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    assert got == sorted([(3, "x"), (5, "y"), (None, "z"), (6, "q  q"), (7, long), (None, long + " fin"), (8, None)], key=str)
    cut = pipeline.suffix_stage(spark, docs, "")
    assert cut.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in cut.collect()), key=str)
    want = [(i, "" if t is None else t) for i, t in rows if i not in (7, 9) and t != long + " fin"]
    assert [x for x in got if len(x[1]) < 5 and "end" not in x[1] and "fin" not in x[1]] == sorted(want, key=str)
    assert all(x.id == "a" and x.left == "d" for x in cut.collect())


def test_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def without_repeats(rows):
    """Texts (ASCII) less what a 50-byte string of a smaller id covers, by force."""
    first, out = {}, {}
    for i, t in sorted(rows):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        out[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    return out


def test_stages_as_by_force(spark, tmp_path):
    """Each stage against a plain version on its own input, one after the other."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    import tokenizers
    from test_llm_operators import components_by_force
    from test_llm_whole import toxicity_by_force

    r = random.Random(17)
    pool, bad, good = [f"w{i}" for i in range(400)], [f"vile{i}" for i in range(6)], [f"kind{i}" for i in range(6)]
    rows, labels = [], {}
    for i in range(150):
        w = [r.choice(pool) for _ in range(70)]
        for _ in range(4):
            w[r.randrange(70)] = r.choice(bad if i % 3 == 0 else good)
        rows.append((i, " ".join(w)))
        labels[i] = int(i % 3 == 0)
    passage = " ".join(r.choice(pool) for _ in range(60))
    for i in range(200, 230):
        base = rows[r.randrange(150)][1].split(" ")
        kind = i % 4
        if kind == 1:
            base[r.randrange(70)] = f"edit{i}"
        if kind == 2:
            base = [*base[:30], passage, *base[30:], *(r.choice(pool) for _ in range(40))]
        rows.append((i, (" " if kind else "  ").join(base)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = {i: t for i, t in rows}

    def run(k):
        nonlocal docs
        out = pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        return docs

    scores = toxicity_by_force(list(at.items()), labels)
    at = {i: t for i, t in at.items() if scores[i] < 0.3}
    assert {x.doc_id: x.text for x in run(0).collect()} == at
    norm = {}
    for i in sorted(at):
        norm.setdefault(" ".join(at[i].split()), i)
    at = {i: at[i] for i in norm.values()}
    assert {x.doc_id: x.text for x in run(1).collect()} == at
    groups = components_by_force(list(at.items()), 5, 80)
    at = {i: t for i, t in at.items() if groups[i][1] == i}
    assert {x.doc_id: x.text for x in run(2).collect()} == at
    at = without_repeats(list(at.items()))
    assert {x.doc_id: x.text for x in run(3).collect()} == at
    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for i, t in at.items()}
    pieces = run(4).collect()
    got = {}
    for x in pieces:
        assert x.doc_tokens == sizes[x.doc_id]
        got.setdefault(x.doc_id, []).append((x.start, x.length))
    for i, n in sizes.items():
        assert sorted(got[i])[0][0] == 0 and sum(k for _, k in got[i]) == n
