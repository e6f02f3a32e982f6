"""The pipeline's stages against plain versions of what they keep, and the registered queries."""

import corpus_pipeline
from lectern.llm import quality, registry
from tests.llm.test_operators import agree, classes

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(texts):
    """Components of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, by all pairs."""
    own = {i: shingles(t) for i, t in texts.items()}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b) if a and b else len(a) == len(b)
    return classes(set(own), [(a, b) for a in own for b in own if a < b and alike(own[a], own[b])])


def test_stages_keep_what_plain_versions_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept, stages = [docs], dict(corpus_pipeline.STAGES)
    for name in ("quality", "exact_dedup", "near_dedup", "decontamination"):
        from lectern.llm.common import stored

        kept.append(stored(stages[name](spark, kept[-1], SF)))
        assert kept[-1].columns == columns
    texts = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()
    assert {r.id for r in good} == set(texts[1]) and labels
    last = {}
    for i, t in texts[1].items():
        last[t] = max(last.get(t, i), i)
    assert set(texts[2]) == set(last.values())
    assert set(texts[3]) == set(near(texts[2]).values())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    spread = [x for x in items if len(x.split()) >= 13]
    dirty = {i for i, t in texts[3].items() if any(x in t for x in spread)}
    gone = set(texts[3]) - set(texts[4])
    assert dirty <= gone and all(any(agree(texts[3][i], x) for x in items) for i in gone)
    last = stages["byte_bpe"](spark, kept[-1], SF)
    assert {r.doc_id for r in last.collect()} == set(texts[4])


def test_every_operator_is_registered():
    names = sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))


ODD = "doc_id long, text string, lang string, kept boolean, id string, fp long, size int"


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    base = " ".join(f"word{i}" for i in range(120))
    near_ = base.replace("word60", "other")
    item = " ".join(f"test{i}" for i in range(20))
    rows = [(1, base), (2, base), (2, base), (3, near_), (4, None), (5, ""), (6, " "), (None, "no id at all"), (7, f"x {item} y"), (8, "w " * 30_000), (9, "short")]
    docs = spark.createDataFrame([(i, t, "en", False, "x", 1, 2) for i, t in rows], ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    stages, sf = dict(corpus_pipeline.STAGES), "/unused"
    real = type(spark.read).parquet
    kept = {}
    try:
        type(spark.read).parquet = lambda self, *paths, **k: {f"{sf}/labels.parquet": labels, f"{sf}/benchmark.parquet": benchmark}.get(paths[0]) or real(self, *paths, **k)
        at = docs
        for name in ("quality", "exact_dedup", "near_dedup", "decontamination"):
            from lectern.llm.common import stored

            at = stored(stages[name](spark, at, sf))
            assert at.columns == docs.columns
            kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in at.collect())
        ids = stages["byte_bpe"](spark, at, sf).collect()
        empty = docs.limit(0)
        for name in stages:
            assert stages[name](spark, empty, sf).count() == 0
    finally:
        type(spark.read).parquet = real
    numbers = {k: [n for none, n in v if not none] for k, v in kept.items()}
    assert len(kept["quality"]) == 11 and numbers["exact_dedup"] == [2, 3, 5, 6, 7, 8, 9]
    assert numbers["near_dedup"] == [2, 5, 7, 8, 9] and numbers["decontamination"] == [2, 5, 8, 9] and all(v[-1][0] for v in kept.values())
    assert len(ids) == 5 and all(len(r.token_ids) == r.n_tokens for r in ids)


def test_near_copies_that_are_caught(spark):
    """Recall of near copies at a similarity of 0.8 and more: every pair is in one component, and no text stays apart from its likes."""
    import random

    from lectern.llm import similar

    rng = random.Random(7)
    texts = {}
    for k in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 200))]
        texts[10 * k] = " ".join(words)
        for j in range(1, rng.randint(2, 6)):
            copy = list(words)
            for _ in range(max(1, len(words) // 60)):
                copy[rng.randrange(len(copy))] = "changed"
            texts[10 * k + j] = " ".join(copy)
    got = {r.id: r.component_id for r in similar.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == near(texts) and len(set(got.values())) < 80
