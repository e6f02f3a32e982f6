"""Storage, catalog checks, packs, dated events and speeches, and streaming ingest."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.operators import evidence as V
from lectern.operators import pack as K
from lectern.sources import catalog, storage
from lectern.streaming import ingest


def test_catalog_problems(spark):
    schema = "book_id string, dir string, volume_witness string, expected_volumes int, declared_volumes int"
    rows = [("a", "x", "corpus", 3, None), ("b", "", "declared", 0, None), ("b", "y", "other", None, 2)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.book_id, r.problem) for r in catalog.problems(df, "book_id", catalog.standard_checks()).collect())
    assert got == [("b", "bad number of volumes"), ("b", "declared without number"), ("b", "duplicate id"), ("b", "no folder"), ("b", "unknown witness")]
    assert catalog.require(df.where("book_id = 'a'")).count() == 1
    with pytest.raises(ValueError, match="b: bad number"):
        catalog.require(df)


def test_manifest_and_vectors(spark):
    inputs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, sha string")
    manifest = spark.createDataFrame([("a", "1"), ("b", "x")], "k string, sha string")
    assert sorted(tuple(r) for r in storage.unregistered(inputs, manifest, "k", "sha").collect()) == [("b", "changed"), ("c", "unregistered")]
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,), ([float("nan"), 0.0],)], "v array<float>")
    assert tuple(storage.vector_faults(v, "v", 2).first()) == (4, 1, 1, 1)


def test_grounded_words_and_searches(spark):
    df = spark.createDataFrame([("齊桓公會諸侯于葵丘",), ("管仲病",)], "normalized_text string")
    assert K.grounded(df, ["問齊桓公", "管仲", "無此"]) == ["齊桓公", "管仲"]
    assert K.probes("葵丘會") == ["葵丘會", "葵丘", "丘會"] and K.probes("管仲") == ["管仲"]
    assert K.searches(["a", "b"], ["x"]) == ["a b", "a", "b", "a x", "b x"] and K.searches([], ["x"]) == [] and len(K.searches(list("abcd"), ["x", "y"])) == K.SEARCHES
    assert K.topics("城濮之戰誰勝了", "誰了之", ("怎麼",)) == ["城濮", "戰", "勝"] or K.topics("城濮之戰", "之") == ["城濮", "戰"]


def test_gaps_and_pack(spark):
    df = spark.createDataFrame([("abXXcdXab",), ("ab",), ("cdab",), (None,), ("ab" * 200_000 + "cd",)], "t string")
    assert [r.g for r in df.select(K.nearest_gap(F.col("t"), "ab", "cd").alias("g")).collect()] == [3, None, 2, None, 2]
    rows = [(1, 9, [1, 2, 3], 100), (2, 8, [2, 3, 4], 100), (3, 7, [10], 11_950), (4, 6, [20], 100)]
    got = {r.k: r.decision for r in K.selected(spark.createDataFrame(rows, "k int, score int, rows array<int>, n int"), "k", "rows", "n").collect()}
    assert got == {1: "taken", 2: "same context", 3: "too long", 4: "taken"}
    rows = [(i, 20 - i, [10 * i], 1, i != 2) for i in range(13)]
    got = [r.decision for r in K.selected(spark.createDataFrame(rows, "k int, score int, rows array<int>, n int, firm boolean"), "k", "rows", "n", "firm").orderBy("place").collect()]
    assert got == ["taken", "taken", "unsupported", *["taken"] * 8, "no place left", "no place left"]


def test_clusters_and_bound_chunks(spark):
    hits = spark.createDataFrame([(1, r) for r in (1, 2, 4, 5, 9)], "f int, r int")
    assert [(x.r, x.batch) for x in K.clusters(hits, "f", "r", 3).orderBy("r").collect()] == [(1, 1), (2, 1), (4, 1), (5, 2), (9, 3)]
    rows = spark.createDataFrame([(1, i, "a" if i < 6 else "b", "x" * 30) for i in range(10)], "f int, r int, b string, t string")
    got = K.bound_chunks(rows, "f", "r", "b", "t", 100, 25).orderBy("n").collect()
    assert [(c.first_row, c.last_row) for c in got] == [(0, 2), (2, 4), (4, 5), (6, 8), (8, 9)]


def test_rerank(spark):
    df = spark.createDataFrame([("the cat",), ("a dog",), (None,)], "t string")
    assert [r.model_score for r in K.reranked(df, "the dog", "t").collect()][:2] == [0.5, 0.5]
    assert [r.model_score for r in K.reranked(df, "q", "t", lambda q, texts: [len(t) for t in texts]).collect()] == [7.0, 5.0, 0.0]


def test_dated_events():
    text = "桓公元年春王正月公即位。三月會于垂。夏四月盟。二年秋大水。\n明年公薨。"
    got = [(text[s:e], d) for s, e, d in V.annals(text)]
    assert got[0][1] == {"era": "桓公", "year": "元", "season": "春", "month": "王正月"}
    assert got[1][1] == {"era": "桓公", "year": "元", "season": "春", "month": "三月"}
    assert got[2][1] == {"era": "桓公", "year": "元", "season": "夏", "month": "四月"}
    assert got[3][1] == {"era": "桓公", "year": "二", "season": "秋"}
    two = "桓公元年春會。明年盟。"
    assert V.relative_time(two, two.index("明年")) == {"word": "明年", "unit": "year", "distance": 1, "base": {"era": "桓公", "year": "元", "season": "春"}, "absolute_year": None}
    assert V.relative_time(text, text.index("明年"))["base"] is None and V.relative_time(text, 0) is None


def test_speeches_focus_and_context():
    text = "公立。管仲謂桓公曰：「不可。」公從之。子曰「善」。"
    got = [(s["speaker"], s["addressee"], s["text"]) for s in V.speeches(text)]
    assert got == [("管仲", "桓公", "不可。"), ("子", None, "善")] and V.speeches("「") == []
    plan = V.Plan(("公",), ("從",))
    s, e = V.focus(text, plan)
    assert text[s:e] == "公從之。" and V.focus("無", plan) is None
    assert V.assembled(text, s, e, 4) == (s, e) and V.assembled(text, s, e) == (0, len(text))


def test_spans_and_pins():
    assert V.projected([(7, 10, 15), (8, 0, 5)], 3, 7) == [(7, 13, 15), (8, 0, 2)]
    with pytest.raises(ValueError):
        V.projected([(7, 0, 2)], 1, 4)
    text = "甲乙丙"
    assert V.sound(text, (1, 2), "乙", hashlib.sha256(text.encode()).hexdigest()) and not V.sound(text, (1, 2), "丙", hashlib.sha256(text.encode()).hexdigest())


def test_streaming_ingest_is_incremental(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("* T\none\n(two)x\n")
    run = lambda: ingest.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == first == 5
    (source / "b.txt").write_text("more")
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and got.select("file_id").distinct().count() == 2


def test_streaming_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value", "user_id")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = ingest.windows(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from w").count() == ingest.windows(events, "1 day").count()


def test_aliases_step_by_step(spark):
    from lectern.operators import question as N

    names = spark.createDataFrame([("齊桓公", "桓公", 9), ("魯桓公", "桓公", 4), ("晉文公", "文公", 3)], "name string, short string, n int")
    rows = [("桓公", "魯人立桓公"), ("桓公", "齊與魯"), ("文公", ""), ("齊桓公", ""), ("仲父", ""), ("子犯", "")]
    got = [(r.short, r.name, r.method) for r in N.resolved(spark.createDataFrame(rows, "short string, context string"), names, {"仲父": "管仲"}).collect()]
    want = [("桓公", "魯桓公", "context"), ("桓公", None, "unresolved"), ("文公", "晉文公", "unique"), ("齊桓公", "齊桓公", "full name"), ("仲父", "管仲", "curated"), ("子犯", None, "unresolved")]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert N.years("莊公元年，前206年，三十二年，1999") == ["莊公元年", "前206年", "三十二年", "1999"]


def test_durations_count_where_the_entity_is_named(spark):
    from lectern.operators import question as N

    words = N.Vocabulary((N.Entity("Ann", ("Ann",)),), {"duration": ("how long",)}, lasting=r"[0-9]+ years")
    df = spark.createDataFrame([("Ann ruled 7 years",), ("Bob ruled 7 years",), ("Ann ruled",)], "text_orig string")
    assert [r.score for r in N.scored(df, N.analyze("how long did Ann", words)).collect()] == [N.DURATION + N.EXACT + N.COMBO_BARE, 0.0, N.EXACT + N.COMBO_BARE]


def test_blocks_of_files_are_those_of_rows(spark):
    import random

    from lectern.operators import blocks as B

    rng = random.Random(5)
    files = [(i, "\n".join(rng.choice(["", "and so on", "a hit here " * rng.randint(1, 9), "plain line " * rng.randint(1, 30), "¶"]) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    df = spark.createDataFrame(files, "file_id long, text string")
    rows = [(f, i, line, "passage" if line.strip("¶ ") else "page", "main", str(max([j for j, x in enumerate(t.split("\n")[:i], 1) if "and" in x], default=0))) for f, t in files for i, line in enumerate(t.split("\n"), 1)]
    table = spark.createDataFrame(rows, "file_id long, row_no int, text_orig string, kind string, layer string, boundary string")
    for length in B.LIMITS:
        got = B.over_files(df, "hit", length, opens="and", score=lambda line: -float(len(line)))
        want = B.assemble(table, table.where(F.col("text_orig").contains("hit")).select("file_id", "row_no", (-F.length("text_orig")).cast("double").alias("score")), length)
        assert sorted(map(str, got.drop("match_type").collect())) == sorted(map(str, want.collect()))
    titles = [(1, "x\nand a hit\nfirst\n\nand none\nlast hit")]
    got = B.over_files(spark.createDataFrame(titles, "file_id long, text string"), "hit", "short", opens="and").collect()
    assert [(r.row_first, r.match_type) for r in got] == [(2, "both"), (5, "text")]


def test_quotes_are_found_by_an_inner_word(spark):
    from lectern.operators.audit import quoted

    items = spark.createDataFrame([(1, "b cc d"), (2, "cc"), (3, None), (4, "x  y z"), (5, "")], "i int, text string")
    texts = spark.createDataFrame([(1, "ab cc dx"), (2, "b cc"), (3, None), (4, "x  y z"), (5, "x y z")], "t int, text string")
    assert sorted(tuple(r) for r in quoted(items, texts, "i", "t").collect()) == [(1, 1), (2, 1), (2, 2), (4, 4), (5, 1), (5, 2), (5, 4), (5, 5)]


def test_shared_folder_on_a_cluster_must_be_named():
    from types import SimpleNamespace as N

    conf = N(get=lambda k, d=None: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(N(conf=conf, sparkContext=N(getConf=lambda: conf, master="yarn")))


def test_traces_are_appended_and_aged(spark, tmp_path):
    path = str(tmp_path / "log")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-03"):
        storage.trace(spark.createDataFrame([("q", 3)], "query string, hits int"), path, F.lit(day))
    assert spark.read.json(path).count() == 4
    assert storage.keep_traces(spark, path, 2) == ["day=2024-01-01"] and spark.read.json(path).count() == 3


class Lengths:
    """An encoder that needs no model."""

    def load(self):
        return lambda texts: [[float(len(t)), 1.0] for t in texts]


def test_vectors_of_an_encoder(spark):
    from lectern.operators import dense

    df = spark.createDataFrame([(1, "ab"), (2, None)], "k int, t string")
    assert [r.embedding for r in dense.encoded(df, Lengths(), "t", size=2).orderBy("k").collect()] == [[2.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="longer than the encoder"):
        dense.encoded(spark.createDataFrame([(1, "a b c")], df.schema), Lengths(), "t", tokens=2).collect()
    with pytest.raises(ValueError, match="between 1 and 100"):
        dense.nearest(df, [1.0], 101)


def test_packed_and_unpacked(spark):
    rows = [("a", 2, "x", None), ("a", 1, None, 5), ("b", 1, "y", 7), ("b", 2, "x", 8)]
    df = spark.createDataFrame(rows, "g string, n int, w string, v int")
    whole, codes = storage.packed(df, "g", "n", ["n", "w", "v"], ["w"])
    assert {r.g: (r.n, r.w, r.n_rows) for r in whole.collect()} == {"a": ([1, 2], [-1, 0], 2), "b": ([1, 2], [1, 0], 2)}
    back = storage.unpacked(whole, codes, "g", ["n", "w", "v"], ["w"]).drop("place").select(*df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="another length"):
        storage.unpacked(whole.withColumn("v", F.slice("v", 1, 1)), codes, "g", ["w", "v"], ["w"]).collect()


def test_states_of_books(spark):
    listed = spark.createDataFrame([(b, b != "e") for b in "abcdef"], "book_id string, recall_verified boolean")
    held = spark.createDataFrame([("a", "OK", True, "complete"), ("b", "OK", True, "partial"), ("c", "WARN", True, "partial"), ("d", "OK", False, "complete"), ("e", "OK", True, "unknown"), ("x", "OK", True, "complete")], "book_id string, coverage string, indexed boolean, volumes string")
    got = {r.book_id: (r.status, r.catalog_gap) for r in catalog.reconciled(listed, held).collect()}
    assert got == {b: (s, False) for b, s in zip("abcdef", catalog.STATES[:4] + catalog.STATES[4:])} | {"x": ("imported", True)}
