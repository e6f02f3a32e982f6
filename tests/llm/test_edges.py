"""Names that clash, inputs that are no Parquet, hot keys, and texts that repeat one word or one notice."""

import math
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, decontaminate, exact_dedup, hmm, licenses, quality, similar, simhash, url_rules, warc


CLASH = "doc_id long, text string, __source_file long, `__source_row` string, `a.b` int, _metadata int, kept boolean, id string"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, 222, "r", 5, 6, None, "x") for i, t in enumerate(texts)], CLASH).repartition(2)


TEXTS = ["one two three", "one two three", None, "", "x", "a b c d e f g h"]


def test_columns_of_any_name_come_back(spark):
    df = clashing(spark, TEXTS)
    for f in (exact_dedup.deduplicate, simhash.deduplicate, similar.deduplicate):
        got = f(df)
        assert got.columns == df.columns and {(r["__source_file"], r["__source_row"], r["a.b"], r["_metadata"]) for r in got.collect()} == {(222, "r", 5, 6)}
        assert got.count() == 4
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select_good(df, labels).count() == 6
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    got = decontaminate.decontaminate(df, items)
    assert got.columns == df.columns and got.count() == 5
    # the id or the text may have such a name itself
    odd = df.select(F.col("doc_id").alias("__source_file"), F.col("text").alias("a.b"))
    assert exact_dedup.deduplicate(odd, "__source_file", "a.b").count() == 4


def test_other_files_than_parquet(spark, tmp_path):
    clashing(spark, TEXTS).select("doc_id", "text").write.json(str(tmp_path / "j"))
    df = spark.read.schema("doc_id long, text string").json(str(tmp_path / "j")).where("doc_id >= 0")
    assert exact_dedup.deduplicate(df).count() == 4 and hmm.score(df, passes=1).count() == 6


def test_a_seed_that_repeats_in_text_and_item(spark):
    rng = random.Random(2)
    items = [(1, "la " * 300), (2, "la " * 40 + "end of it " * 3), (3, "la lu " * 9)]
    texts = [(1, "la " * 50_000), (2, "x " * 20 + "la " * 13 + "y"), (3, " ".join(rng.choice(["la", "lu"]) for _ in range(400))), (4, "lu " * 1000)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    began = time.time()
    got = {(r.id, r.item_id): (r.first_word, r.n_words, r.n_equal) for r in decontaminate.overlaps(docs, bench).collect()}
    assert time.time() - began < 240
    assert got[1, 1] == (0, 300, 300) and got[2, 1] == (20 - 2, 15, 13) and (4, 1) not in got and (1, 2) in got


@pytest.mark.parametrize("expanded", [1 << 21, 0])
def test_overlaps_are_the_best_of_all_diagonals(expanded, monkeypatch):
    monkeypatch.setattr(decontaminate, "EXPANDED", expanded)
    rng = random.Random(3)
    items = decontaminate.Items([1, 2, 3], [" ".join(rng.choice(["la", "lu", "x"]) for _ in range(n)).encode() for n in (30, 13, 6)])
    for _ in range(30):
        text = " ".join(rng.choice(["la", "lu", "x"]) for _ in range(rng.randint(1, 60))).encode()
        found = decontaminate.hash_words([text])
        words = text.split()
        hits, whole = items.hits(found.hashes, found.owner())
        for item, want in enumerate(items.words):
            diagonals = np.arange(1 - len(want), len(words)) if [0, item] in whole.tolist() else hits[hits[:, 1] == item, 2]
            got = items.overlap(found.hashes, 0, len(words), item, diagonals, lambda i: words[i]) if len(diagonals) else None
            least, need = (13, 11) if len(want) >= 13 else (len(want), len(want))
            best = None
            for d in range(1 - len(want), len(words)):
                same = [words[i] == want[i - d] if 0 <= i - d < len(want) else None for i in range(len(words))]
                good = [s for s in range(len(words) - least + 1) if None not in same[s : s + least] and sum(same[s : s + least]) >= need]
                if good:
                    inside = sorted({i for s in good for i in range(s, s + least)})
                    hit = (sum(same[i] for i in inside), -inside[0], len(inside))
                    best = max(best, hit) if best else hit
            assert (got and (got[2], -got[0], got[1])) == best


def test_blocks_of_items_are_read_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    rng = random.Random(5)
    items = [(i, " ".join(str(rng.random()) for _ in range(15))) for i in range(5)]
    docs = spark.createDataFrame([(i, f"start {t} end") for i, t in items], "doc_id long, text string")
    got = decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.id, r.item_id, r.n_equal) for r in got) == [(i, i, 15) for i in range(5)]


def test_very_many_notices(spark):
    one = "All rights reserved. Released under the MIT License. "
    rows = [(1, one * 5_000), (1, one), (2, None), (3, "version " * 100_000)]
    got = Counter((r.id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, "all-rights-reserved"): 5001, (1, "MIT"): 5001}


def test_notices_are_those_of_all_templates_tried_everywhere():
    """Against an alignment of every template at every place, the best first, in short blocks."""
    own, rng = licenses.Templates({"a": ("red green blue black white",), "b": ("red green blue grey white brown",)}), random.Random(6)

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                last, row[j] = row[j], min(last + (p != q), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for _ in range(60):
        words = [rng.choice([b"red", b"green", b"blue", b"black", b"white", b"grey", b"brown", b"x"]) for _ in range(12)]
        at = rng.randrange(6)
        words[at : at + 5] = [w if rng.random() < 0.9 else b"x" for w in own.words[0]]
        any_ = any(edits(t, words[s:e]) <= int(licenses.DIFFER * len(t)) for t in own.words for s in range(12) for e in range(s, 13))
        found = own.find(words)
        assert bool(found) == any_
        for first, n, i, _, differing in found:
            assert len(differing) == edits(own.words[i], words[first : first + n]) <= int(licenses.DIFFER * len(own.words[i]))


def test_one_row_for_each_rated_id(spark):
    docs = spark.createDataFrame([(1, "a")] * 30 + [(1, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    ratings = spark.createDataFrame([(1, 2), (1, 2), (2, 0), (None, 1), (9, 1)], "id long, grade int")
    assert sorted(tuple(r) for r in quality.rated(docs, ratings, 10, "doc_id", "text").collect()) == [(0, "c"), (2, "a")]


def test_screening_holds_no_second_copy_of_the_features(monkeypatch):
    def screened(n):
        feature, of = np.arange(n, dtype=np.int32) % 1001, (np.arange(n, dtype=np.int32) // 1001 % 2 * (np.arange(n) % 1001 < 500)).astype(np.int32)
        tracemalloc.start()
        try:
            out = quality.screened(feature, of, np.arange(n // 50) % 2, 2)
            return out, tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    (_, small), (many, large) = screened(2 << 20), screened(8 << 20)
    assert large < small + 10
    monkeypatch.setattr(quality, "PIECE", 1 << 30)
    assert not many[:500].any() and many[500:1001].all() and not many[1001:].any() and (many == screened(8 << 20)[0]).all()


def test_weights_are_those_of_a_dense_solver(monkeypatch):
    """Newton's method with numerical derivatives on the likelihood written out with a dense matrix."""
    size = quality.PLACES + quality._RATES * quality._BANDS
    monkeypatch.setattr(quality, "screened", lambda *a: np.ones(size, dtype=bool))
    rng = np.random.default_rng(1)
    n, p = 80, 4
    x = rng.random((n, p)) < 0.4
    x[:, 0] |= ~x.any(axis=1)
    grade = np.clip((x @ np.array([2.0, -2.0, 1.0, 0]) + rng.normal(size=n)).round().astype(int) + 1, 0, 2)
    rows = [np.flatnonzero(r) for r in x]
    w, cut = quality.fit(np.concatenate(rows), np.cumsum([0, *map(len, rows)]), grade, 3, steps=500)

    def loss(v):
        c = np.array([v[p], v[p] + np.exp(v[p + 1])])
        tail = 1 / (1 + np.exp(-((x @ v[:p])[:, None] - c)))
        chance = (np.c_[np.ones(n), tail] - np.c_[tail, np.zeros(n)])[np.arange(n), grade]
        return -np.log(chance).sum() + quality.RIDGE / 2 * (v[:p] @ v[:p]) + 5e-4 * (v[p:] @ v[p:])

    v, h, eye = np.r_[np.zeros(p), -1.0, 0.0], 1e-4, np.eye(p + 2)
    for _ in range(40):
        g = np.array([(loss(v + h * e) - loss(v - h * e)) / (2 * h) for e in eye])
        hess = np.array([[(loss(v + h * a + h * b) - loss(v + h * a - h * b) - loss(v - h * a + h * b) + loss(v - h * a - h * b)) / (4 * h * h) for b in eye] for a in eye])
        step = np.linalg.solve(hess + 1e-6 * eye, g)
        rate = 1.0
        while loss(v - rate * step) > loss(v) and rate > 1e-6:
            rate /= 2
        v = v - rate * step
    np.testing.assert_allclose(np.r_[w[:p], cut], np.r_[v[:p], v[p], v[p] + np.exp(v[p + 1])], atol=2e-2)
    np.testing.assert_allclose(quality.scores(w, np.concatenate(rows), np.cumsum([0, *map(len, rows)])), x @ w[:p], atol=1e-4)


def test_expected_counts_of_long_texts_are_those_of_whole_ones(monkeypatch):
    rng = np.random.default_rng(0)
    mass = rng.random(hmm.CLASSES) + 0.01
    model = hmm.Model.begin(mass / mass.sum(), np.ones(hmm.CLASSES), [b"w%d" % i for i in range(hmm.OWN)])
    model.step = rng.dirichlet(np.ones(hmm.STATES), size=hmm.STATES)
    texts = [rng.integers(0, hmm.CLASSES, n).astype(np.int16) for n in (700, 31, 1, 64, 65, 128, 3)]
    want = hmm._sum([hmm.expected(model, [t]) for t in texts])
    monkeypatch.setattr(hmm, "SEGMENT", 32)
    monkeypatch.setattr(hmm, "GROUP", 5)
    for whole in (0, 64, 1000):
        monkeypatch.setattr(hmm, "WHOLE", whole)
        for a, b in zip(hmm.expected_sums(model, texts), want):
            np.testing.assert_allclose(a, b, rtol=2e-3, atol=1e-4)
    assert hmm.expected_sums(model, [])[2].sum() == 0


def test_a_pass_raises_the_likelihood():
    rng = np.random.default_rng(4)
    mass = rng.random(hmm.CLASSES) + 0.01
    unigram = mass / mass.sum()
    model = hmm.Model.begin(unigram, np.ones(hmm.CLASSES), [b"w%d" % i for i in range(hmm.OWN)])
    texts = [np.r_[rng.integers(1, 30, 40) + 30 * (i % 2), 0].astype(np.int16) for i in range(60)]
    before = hmm.forward(model, texts).sum()
    for _ in range(3):
        model = model.update(*hmm.expected_sums(model, texts), unigram)
        after = hmm.forward(model, texts).sum()
        assert after > before
        before = after
    for x in (model.start.sum(), *model.step.sum(axis=1), *model.emit.sum(axis=0)):
        assert math.isclose(x, 1, rel_tol=1e-6)


def test_ties_are_broken_alike_and_long_words_count(spark):
    counts = spark.createDataFrame([(bytearray(b"w%d" % i), 7) for i in range(3000)] + [(bytearray(b"top"), 900)], "word binary, c long")
    got = {bytes(r.word) for r in hmm.most_frequent(counts, 1000).collect()}
    assert b"top" in got and 900 < len(got) <= 1000
    assert got == {bytes(r.word) for r in hmm.most_frequent(counts.repartition(7), 1000).collect()}
    assert hmm.most_frequent(counts, 5000).count() == 3001
    long = "http://" + "x" * 200
    docs = spark.createDataFrame([(i, f"{long} word") for i in range(40)] + [(99, "y" * 300)], "doc_id long, text string")
    got = {r.id: r for r in hmm.score(docs, passes=1).collect()}
    assert all(got[i].n_known == 3 for i in range(40)) and len(next(iter(hmm.runs(long.encode())))[0]) < 64


def test_equal_urls_fill_several_ranges(spark):
    rows = [(i, "no scheme" if i % 3 else "http://a.net/x") for i in range(3000)]
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, action string")
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, "page_id")
    sizes = [n for n in got.rdd.glom().map(len).collect() if n]
    assert len(sizes) > 1 and max(sizes) < 2000
    assert Counter(r.verdict for r in got.collect()) == {"block": 1000, "allow": 2000}


def test_url_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "h", "p", "k", 7, "r")], "page_id long, url string, host string, path string, key string, kind int, range string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, action string")
    assert [tuple(r) for r in url_rules.judge(df, rules, "page_id").collect()] == [(1, "a.net", "/", "net/", "block")]


def test_empty_payloads_and_a_least_size(spark):
    rows = [(1, "u", ""), (2, "u", None), (3, None, "ab")]
    for least, kinds in ((0, ["response", "revisit", "response"]), (1, ["response", "response", "response"])):
        path = common.shared_dir(spark)
        warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path, least_bytes=least)
        got = sorted((r.row_id, r.record_type, r.payload_bytes) for r in warc.payloads(warc.read(spark, path)).collect())
        assert [g[1] for g in got] == kinds and [g[2] for g in got] == [0, 0, 2]
