"""Source files, text functions and sequences on a small corpus of our own."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import sequence as Q
from lectern.sources import markup

BOOK = """#+TITLE: 小史
#+EDITION: TLS
# src: 小史 卷一
* 桓公
<pb:XS_TLS_001-1a>¶
桓公元年春(註：元年)王正月¶
公即位。<pb:XS_TLS_001-1b>國人(皆(喜))曰善
# 一
# 二

#+PART: appendix
附錄　一則&KR0001;¶"""


def test_segments_make_up_the_file():
    out = list(markup.segment(BOOK))
    lines = {}
    for _, row, _, _, _, text, *_ in out:
        lines.setdefault(row, []).append(text)
    assert "\n".join("".join(lines[r]) for r in sorted(lines)) == BOOK
    kinds = [(r[2], r[3]) for r in out]
    assert kinds == [("part", "main"), ("part", "main"), ("comment", "main"), ("heading", "main"), ("page", "main"), ("passage", "main"), ("passage", "commentary_candidate"), ("passage", "main"), ("passage", "main"), ("comment", "main"), ("page", "main"), ("part", "appendix"), ("passage", "appendix")]
    assert {r[4] for r in out if r[2] == "passage"} == {"桓公", None}
    assert out[-1][8] == "<pb:XS_TLS_001-1b>"


@pytest.mark.parametrize("line, pieces", [("a(b)c", [(0, 1, False), (1, 4, True), (4, 5, False)]), ("a(b)¶", [(0, 1, False), (1, 5, True)]), ("a(b", [(0, 3, False)]), ("a((b))", [(0, 6, False)]), ("", [(0, 0, False)]), ("（甲）乙", [(0, 3, True), (3, 4, False)])])
def test_brackets(line, pieces):
    assert markup.brackets(line) == pieces


def test_files_header_and_conservation(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x_001.txt").write_text(BOOK, encoding="utf-8")
    (tmp_path / "b" / "skip.md").write_text("no")
    df = markup.files(spark, str(tmp_path))
    row = df.select("sha256", "text", markup.split_header(F.col("text")).alias("h")).first()
    assert row.text == BOOK and row.h.header["TITLE"] == "小史" and row.h.body.startswith("* 桓公") and len(row.h.header) == 3
    texts = df.select(F.lit(1).cast("long").alias("file_id"), "text").union(spark.createDataFrame([(2, ""), (3, "a\n\nb")], "file_id long, text string"))
    records = markup.parse(texts)
    assert records.where("file_id = 1").count() == 13
    assert markup.conserved(records, texts).count() == 0
    assert [r.file_id for r in markup.conserved(records.where("file_id <> 3 or row_no <> 2"), texts).collect()] == [3]


def test_text_functions(spark):
    rows = ["　桓公<pb:A_B_1-2a>卒¶　", "¶", "<pb:bad>", "# src: 小史 卷一 下", "Lun 3.12.4 text", "&KR0001;甲&KR0002;", None]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").select(
        "i", T.normalize("t").alias("n"), T.page_marker("t").alias("pb"), T.source_line("t").alias("s"), T.paragraph_code("t").alias("c"), T.glyph_codes("t").alias("k"), T.contains("t", "TEXT").alias("has")
    )
    r = {x.i: x for x in out.collect()}
    assert r[0].n == "桓公卒" and r[1].n is None and r[0].pb.asDict() == {"raw": "<pb:A_B_1-2a>", "book_id": "A", "edition": "B", "block": "1", "page": "2", "side": "a"}
    assert r[2].pb.raw == "<pb:bad>" and r[2].pb.book_id is None and r[1].pb is None
    assert r[3].s.prefix == "小史" and r[3].s.section_ref == "卷一 下" and r[4].s is None
    assert r[4].c == "3.12" and r[5].k == ["&KR0001;", "&KR0002;"] and r[4].has and not r[0].has
    assert T.variants("國史", {"國": "国"}) == ["國史", "国史"]


def test_runs_context_and_onward(spark):
    rows = [(1, i, "ab"[i // 3 % 2], i) for i in range(9)] + [(2, 0, None, 0), (2, 1, None, 1)]
    df = spark.createDataFrame(rows, "file_id int, row_no int, layer string, v int")
    got = {(r.file_id, r.row_no): r.run for r in Q.runs(df, "file_id", "row_no", F.col("layer")).collect()}
    assert [got[1, i] for i in range(9)] == [1, 1, 1, 2, 2, 2, 3, 3, 3] and got[2, 0] == got[2, 1] == 1
    near = Q.context(df, df.where("row_no = 8 and file_id = 1"), "file_id", "row_no", 2).collect()
    assert sorted((r.row_no, r.distance) for r in near) == [(6, -2), (7, -1), (8, 0)]
    page = Q.onward(df.where("file_id = 1"), "file_id", "row_no", F.lit(3), F.col("layer") == "a", 10).collect()
    assert [r.row_no for r in page] == [4, 5] and not any(r.reaches_end for r in page)


def test_chunks_cover_the_text(spark):
    rng = random.Random(0)
    for _ in range(50):
        text = "".join(rng.choice("abc. \n。") for _ in range(rng.randint(0, 900)))
        parts = list(Q.cut(text, 120, 20))
        assert all(0 < e - s <= 120 for s, e in parts)
        assert (not text and not parts) or (parts[0][0] == 0 and parts[-1][1] == len(text))
        assert all(b[0] <= a[1] for a, b in zip(parts, parts[1:])) and all(a[0] < b[0] for a, b in zip(parts, parts[1:]))
    assert Q.chunks(spark.createDataFrame([(1, None), (2, "")], "k int, t string"), "k", "t").count() == 0


def test_volume_status_and_normalized_text():
    text = "#+PROPERTY: JUAN 十二\n* 甲\n　文(註)¶\n(甲(乙))\n(甲\n<pb:x>¶\n#+JUAN: 3\n尾 "
    got = [(r[2], r[9], r[10], r[11]) for r in markup.segment(text)]
    assert got == [
        ("part", 12, "confirmed", "#+PROPERTY: JUAN 十二"), ("heading", 12, "confirmed", "* 甲"), ("passage", 12, "confirmed", "文"), ("passage", 12, "confirmed", "(註)"), ("passage", 12, "pending", "(甲(乙))"),
        ("passage", 12, "pending", "(甲"), ("page", 12, "confirmed", None), ("part", 3, "confirmed", "#+JUAN: 3"), ("passage", 3, "confirmed", "尾"),
    ]


def test_volumes_of_some_lines_only(spark):
    df = spark.createDataFrame([(1, "a\n#+JUAN: 3\nb"), (2, None)], "file_id long, text string")
    assert sorted((r.file_id, r.row_no, r.juan) for r in markup.parse(df).collect()) == [(1, 1, None), (1, 2, 3), (1, 3, 3), (2, 1, None)]
