"""Search, blocks, fusion, questions, evidence and audits on small cases, and every registered query at the smallest size."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import dense as D
from lectern.operators import evidence as V
from lectern.operators import question as N
from lectern.operators import relational as R
from lectern.operators import search as S
from lectern.plans import catalog


def test_plan_of_a_query():
    assert S.plan("rein on").path == "trigram" and S.plan("on ti").path == "bigram" and S.plan("a").path == "scan" and S.plan("").groups == ()
    assert S.plan("ré", {"é": "e"}).groups == (("ré", "re"),)
    assert S.resolve_edition("SBCK") == "sbck" and S.resolve_edition("WYG") is None


def test_bm25_formula(spark):
    texts = ["abcabc", "abc", "xyz", "xx", "q", None]
    df = spark.createDataFrame(list(enumerate(texts)), "passage_id int, normalized_text string")
    got = {r.passage_id: r.score for r in S.bm25(df, ["abc"]).collect()}
    idf = max(math.log((6 - 2 + 0.5) / 2.5), 1e-6)
    average = (4 + 1 + 1) / 6
    for i, tf, dl in ((0, 2, 4), (1, 1, 1)):
        assert math.isclose(got[i], -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average)))
    assert set(got) == {0, 1}


def test_unknown_book_is_an_error(spark):
    books = spark.createDataFrame([("a", ["first"])], "book_id string, names array<string>")
    assert S.resolve_book(books, "first") == "a"
    with pytest.raises(ValueError, match="known: a"):
        S.resolve_book(books, "b")
    with pytest.raises(ValueError):
        R.page(books, ["book_id"], 0, 10)


def _file(texts, boundary=None, kind=None, limits=B.Limits(10, 5, 20)):
    n = len(texts)
    rows = pd.DataFrame({"row_no": range(n), "text_orig": texts, "kind": kind or ["passage"] * n, "layer": ["main"] * n, "boundary": boundary or [None] * n})
    return B.File(rows, limits)


def test_blocks_grow_merge_and_stop_at_boundaries():
    f = _file(["aaaa"] * 8)
    assert f.grow(3) == (2, 4)
    assert f.blocks([(3, 1.0), (4, 0.5)]) == [[2, 5, 2, 0.5, 3]]
    f = _file(["aaaa"] * 8, ["x"] * 4 + ["y"] * 4)
    assert f.grow(3) == (1, 3) and f.grow(4) == (4, 6)
    assert [b[:3] for b in f.blocks([(3, 1.0), (4, 1.0)])] == [[1, 3, 1], [4, 6, 1]]
    f = _file(["aaaa", "", "aaaa"], ["x", "z", "x"], ["passage", "page", "passage"])
    assert f.grow(0) == (0, 2)
    assert _file(["a" * 50]).grow(0) == (0, 0)


def test_blocks_never_overlap(spark):
    rows = [(f, r, "passage", "main", str(r // 7), "word " * (r % 5 + 1)) for f in (1, 2) for r in range(60)]
    df = spark.createDataFrame(rows, "file_id long, row_no int, kind string, layer string, boundary string, text_orig string")
    hits = df.where("row_no % 3 = 0").select("file_id", "row_no", F.lit(1.0).alias("score"))
    got = B.assemble(df, hits, "short").toPandas()
    for _, g in got.groupby("file_id"):
        g = g.sort_values("row_first")
        assert (g["row_first"].to_numpy()[1:] > g["row_last"].to_numpy()[:-1]).all()
        assert g["match_count"].sum() == 20
        assert (g["row_first"] // 7 == g["row_last"] // 7).all()


def test_fusion_and_overlaps(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "k int, rank int")
    got = D.fuse({"a": a, "b": b}, "k", 10).collect()
    assert [(r.k, r.channels) for r in got] == [(2, "a,b"), (1, "a"), (3, "b")] and math.isclose(got[0].score, 1 / 62 + 1 / 61)
    spans = spark.createDataFrame([(1, "s", 0, 10), (2, "s", 1, 11), (3, "s", 5, 15), (4, "t", 0, 10), (5, "s", 6, 8)], "rank int, source string, start int, end int")
    assert [r["rank"] for r in D.without_overlaps(spans, "rank", "source", "start", "end").orderBy("rank").collect()] == [1, 3, 4]


WORDS = N.Vocabulary(
    (N.Entity("桓公", ("齊桓公",), ("桓公",), ("公",)), N.Entity("管仲", ("管仲",), ("仲父",))), {"death": ("怎麼死",), "when": ("何時",)}, {"death": ("卒", "薨")}, {"death": ("病",)}, frozenset({"的"})
)


def test_question_and_score(spark):
    q = N.analyze("齊桓公怎麼死的 葵丘 前643", WORDS)
    assert [e.name for e in q.entities] == ["桓公"] and q.intents == ("death",) and q.years == ("前643",) and q.topics == ("葵丘",)
    rows = ["齊桓公卒", "桓公病", "公薨", "管仲言於齊桓公", "葵丘", None]
    got = {r.t: r for r in N.scored(spark.createDataFrame([(x,) for x in rows], "t string"), q, "t").collect()}
    assert got["齊桓公卒"].score == 14 + 8 + 15 and got["桓公病"].score == 6 + 1.5 + 3
    assert got["公薨"].score == 2 + 8 + 6 and got["葵丘"].score == 5 and got[None].score == 0
    two = N.analyze("齊桓公管仲", WORDS)
    got = N.scored(spark.createDataFrame([("管仲言於齊桓公",)], "t string"), two, "t").first()
    assert got.score == 14 + 9.5 + 20 + 3 and "pair=20.0" in got.detail


def test_quotes_units_and_qualifiers():
    text = "公曰：「善。『可』也。」遂行。聞齊侯卒。若晉敗，不戰。"
    assert [text[s:e] for s, e, d in V.quotes(text)] == ["「善。『可』也。」", "『可』"]
    assert V.quotes("「a") is None and V.quotes("」") is None
    assert [text[s:e] for s, e in V.units(text)] == ["公曰：「善。『可』也。」", "遂行。", "聞齊侯卒。", "若晉敗，不戰。"]
    assert len(V.masked(text)) == len(text) and "善" not in V.masked(text)
    assert V.locate(text, "遂行") == (text.index("遂行"), text.index("遂行") + 2) and V.locate(text, "。") is None and V.locate(text, "") is None
    plan = V.Plan(("齊侯",), ("卒",), ("晉",))
    status, missing, f = V.audit(text, plan)
    assert status == "insufficient" and missing == ["plain statement"] and f["qualifier"] == "reported" and f["gap"] == 0
    assert V.audit("晉人來。齊侯卒。", plan)[0] == "clues_present"
    assert V.features("齊侯不卒。", plan)["qualifier"] == "negated" and V.features("若齊侯卒。", plan)["qualifier"] == "hypothetical"
    assert V.audit("", plan) [1] == ["晉", "relation"]


def test_audits_quote_the_source(spark):
    plan = V.Plan(("齊侯",), ("卒",))
    df = spark.createDataFrame([(1, "夏。齊侯卒。葬。"), (2, None), (3, "齊侯來。")], "k int, t string")
    got = {r.k: r for r in V.audited(df, plan, "k", "t").collect()}
    assert got[1].quote == "齊侯卒。" and got[1].status == "clues_present" and not got[1].relation_verified and got[2].quote is None and got[3].missing == ["relation"]


def test_every_query_gives_what_its_sql_gives(spark):
    """Runs every query; those with SQL against DuckDB by number of rows, the others must have rows."""
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    assert len(catalog.queries()) >= 100
    sql = catalog.oracle_sql()
    for name, f in catalog.queries().items():
        df = f(spark, sf)
        n = df.count()
        assert len(set(df.columns)) == len(df.columns), name
        if name in sql:
            found = con.execute(sql[name])
            assert sorted(d[0] for d in found.description) == sorted(df.columns) and len(found.fetchall()) == n, name
        else:
            assert n, name


def test_flagship_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(catalog.oracle_sql()["O08_paging"]).fetchall()
    assert [tuple(r) for r in catalog.flagship(spark, "/root/testdata/sf0.001").collect()] == want
