"""Queries over rows in reading order, blocks, chunks, and dense retrieval with fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import dense as D
from lectern.operators import sequence as Q
from lectern.plans.registry import query
from lectern.plans.views import PASSAGES, SECTIONS, TURNS, passages, sections, table, turns


@query(f"""WITH {PASSAGES}, m AS (SELECT *, text_orig LIKE '%the%' AS m FROM passages), r AS (SELECT *, sum(CASE WHEN m = pm THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY row_no) AS run FROM (SELECT *, lag(m) OVER (PARTITION BY file_id ORDER BY row_no) AS pm FROM m))
SELECT file_id, min(row_no) AS first_row, max(row_no) AS last_row, count(*) AS n, string_agg(text_orig, chr(10) ORDER BY row_no) AS text FROM r WHERE m GROUP BY file_id, run""")
def P03_comment_blocks(spark, sf):
    return Q.merged_runs(passages(spark, sf), "file_id", "row_no", F.col("text_orig").contains("the"), "text_orig")


@query(f"WITH {TURNS} SELECT file_id, row_no, last_value(CASE WHEN layer = 'user' THEN row_no END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY row_no) AS part FROM turns")
def P04_sticky_layer(spark, sf):
    return Q.sticky(turns(spark, sf), "file_id", "row_no", F.when(F.col("layer") == "user", F.col("row_no")), "part").select("file_id", "row_no", "part")


@query(f"WITH {SECTIONS}, e AS (SELECT file_id, max(row_no) AS last FROM passages GROUP BY 1) SELECT s.file_id, s.label, s.first_row, coalesce(lead(first_row) OVER (PARTITION BY s.file_id ORDER BY first_row) - 1, e.last) AS last_row FROM sections s JOIN e ON s.file_id = e.file_id")
def P19_section_closing(spark, sf):
    return Q.closed(sections(spark, sf), passages(spark, sf).select("file_id", "row_no"), "file_id", "first_row", "row_no").select("file_id", "label", "first_row", "last_row")


@query("SELECT s.doc_id AS file_id, s.source AS book, CAST(length(s.text) AS INT) AS chars, l.quality FROM documents s JOIN labels l USING (doc_id) ORDER BY book, file_id LIMIT 200")
def S15_section_export(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.orderBy("source", "doc_id").limit(200).select(F.col("doc_id").alias("file_id"), F.col("source").alias("book"), F.length("text").alias("chars"), "quality")


@query(f"""WITH {PASSAGES}, p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_no) AS rn FROM passages), a AS (SELECT file_id, row_no AS anchor, rn FROM p WHERE text_orig LIKE '%ndtion%')
SELECT p.file_id, p.row_no, a.anchor, CAST(p.rn - a.rn AS INT) AS distance FROM p JOIN a ON p.file_id = a.file_id AND abs(p.rn - a.rn) <= 2""")
def W01_context(spark, sf):
    p = passages(spark, sf)
    return Q.context(p.select("file_id", "row_no"), p.where(F.col("text_orig").contains("ndtion")), "file_id", "row_no", 2).select("file_id", "row_no", "anchor", "distance")


@query(f"""WITH {TURNS}, t AS (SELECT *, row_number() OVER w AS rn, max(CASE WHEN layer = 'system' THEN 1 ELSE 0 END) OVER w AS b FROM turns WHERE row_no > 1 WINDOW w AS (PARTITION BY file_id ORDER BY row_no)),
u AS (SELECT *, max(rn) OVER (PARTITION BY file_id) AS total FROM t), v AS (SELECT * FROM u WHERE b = 0 AND rn <= 4) SELECT file_id, row_no, max(rn) OVER (PARTITION BY file_id) = total AS reaches_end FROM v""")
def W02_onward_page(spark, sf):
    return Q.onward(turns(spark, sf), "file_id", "row_no", F.lit(1), F.col("layer") == "system", 4).select("file_id", "row_no", "reaches_end")


@query(f"""WITH {TURNS} SELECT file_id, row_no, sum(CASE WHEN layer IS NOT DISTINCT FROM p AND row_number_ > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY row_no) AS run
FROM (SELECT *, lag(layer) OVER (PARTITION BY file_id ORDER BY row_no) AS p, row_number() OVER (PARTITION BY file_id ORDER BY row_no) AS row_number_ FROM turns)""")
def W04_boundary_runs(spark, sf):
    return Q.runs(turns(spark, sf), "file_id", "row_no", F.col("layer")).select("file_id", "row_no", "run")


@query(f"""WITH {PASSAGES}, c AS (SELECT file_id, row_no, CASE WHEN length(text_orig) > 20 THEN length(text_orig) // 100 END AS code FROM passages), h AS (SELECT *, lag(code) OVER (PARTITION BY file_id ORDER BY row_no) AS p FROM c WHERE code IS NOT NULL)
SELECT file_id, code, row_no AS first_row, lead(row_no) OVER (PARTITION BY file_id ORDER BY row_no) AS stop FROM h WHERE p IS NULL OR p <> code""")
def W05_code_spans(spark, sf):
    code = F.when(F.length("text_orig") > 20, F.floor(F.length("text_orig") / 100))
    return Q.spans(passages(spark, sf), "file_id", "row_no", code)


@query(f"WITH {TURNS} SELECT file_id, min(row_no) < 2 AS more_before, max(row_no) > 4 AS more_after FROM turns GROUP BY 1")
def W06_reach_flags(spark, sf):
    return turns(spark, sf).groupBy("file_id").agg((F.min("row_no") < 2).alias("more_before"), (F.max("row_no") > 4).alias("more_after"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def W07_rank(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rank"))


@query("""WITH c AS (SELECT l_partkey AS item, l_returnflag AS channel, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY s DESC, item) AS r FROM c)
SELECT item, min(r) AS best_rank, string_agg(channel || ':' || r, ',' ORDER BY channel || ':' || r) AS votes FROM r WHERE r <= 20 GROUP BY 1""")
def W08_channel_quota(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("channel")).agg(F.max("l_extendedprice").alias("s"))
    return Q.quotas(c, "item", "channel", [F.desc("s"), F.col("item")], 20)


INTERLEAVE = """r AS (SELECT item, list_no, row_number() OVER (PARTITION BY list_no ORDER BY s DESC, item) AS rank FROM (SELECT p_partkey AS item, p_size AS list_no, p_retailprice AS s FROM part WHERE p_size <= 4 UNION ALL SELECT p_partkey, 99, p_retailprice FROM part WHERE p_partkey % 3 = 0))"""


@query(f"WITH {INTERLEAVE}, f AS (SELECT item, min(struct_pack(r := rank, l := list_no)) AS k FROM r GROUP BY 1) SELECT item, row_number() OVER (ORDER BY k, item) AS place FROM f ORDER BY k, item LIMIT 60")
def W09_interleave(spark, sf):
    p = table(spark, sf, "part")
    a = p.where("p_size <= 4").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("list_no"), F.col("p_retailprice").alias("s"))
    a = a.unionByName(p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("item"), F.lit(99).alias("list_no"), F.col("p_retailprice").alias("s")))
    a = a.withColumn("rank", F.row_number().over(Window.partitionBy("list_no").orderBy(F.desc("s"), "item")))
    return Q.interleaved(a, "item", "list_no", "rank", 60)


@query("SELECT doc_id, CAST(n AS INT) AS n, CAST(n * 200 AS INT) AS start, substr(text, CAST(n * 200 + 1 AS INT), 240) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 40) / 200.0) AS INT) - 1, 0))) AS n FROM documents WHERE length(text) > 0)")
def W10_windows(spark, sf):
    return Q.windows(table(spark, sf, "documents"), ["doc_id"], "text", 240, 40)


_END = "CASE WHEN {s} + 240 >= length(text) THEN length(text) WHEN regexp_matches(substr(text, CAST({s} + 121 AS INT), 120), '[。！？；.!?;\\n]') THEN {s} + 120 + length(regexp_extract(substr(text, CAST({s} + 121 AS INT), 120), '(?s)^(.*[。！？；.!?;\\n])', 1)) ELSE {s} + 240 END"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS n, 0 AS start, CAST({_END.format(s='0')} AS INT) AS stop FROM documents WHERE length(text) > 0
UNION ALL SELECT doc_id, text, n + 1, nxt, CAST({_END.format(s='nxt')} AS INT) FROM (SELECT doc_id, text, n, greatest(stop - 40, start + 1) AS nxt FROM c WHERE stop < length(text)))
SELECT doc_id, n, start, stop AS "end", substr(text, start + 1, stop - start) AS chunk FROM c""")
def C02_chunks(spark, sf):
    return Q.chunks(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT doc_id, substr(source, 1, 32) || ' ' || substr(lang, 1, 32) || ' ' || regexp_replace(text, '[\\s]+', ' ', 'g') AS embedding_text FROM documents")
def C03_embedding_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", F.substring("source", 1, 32), F.substring("lang", 1, 32), F.regexp_replace("text", r"\s+", " ")).alias("embedding_text"))


DOT = "round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"


def _first(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 0").first().embedding


@query(f"SELECT e.vec_id, {DOT} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label IN (1, 3, 5) ORDER BY score DESC, e.vec_id LIMIT 25")
def C05_dense_top_k(spark, sf):
    return D.nearest(table(spark, sf, "embeddings"), _first(spark, sf), 25, where=F.col("label").isin(1, 3, 5)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT e.vec_id, list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT 50)),
k AS (SELECT vec_id, row_number() OVER (ORDER BY x DESC, vec_id) AS rank FROM (SELECT vec_id, embedding[1] AS x FROM embeddings ORDER BY x DESC, vec_id LIMIT 50)),
v AS (SELECT vec_id, 1.0 / (60 + rank) AS v, 'semantic' AS c FROM s UNION ALL SELECT vec_id, 1.0 / (60 + rank), 'keyword' FROM k)
SELECT vec_id, round(sum(v), 9) AS score, string_agg(c, ',' ORDER BY c) AS channels FROM v GROUP BY 1 ORDER BY score DESC, vec_id LIMIT 20""")
def C06_rank_fusion(spark, sf):
    e = table(spark, sf, "embeddings")
    semantic = D.ranked(D.nearest(e, _first(spark, sf), 50), [F.desc("score"), F.col("vec_id")])
    keyword = D.ranked(e.select("vec_id", F.col("embedding")[0].alias("x")).orderBy(F.desc("x"), "vec_id").limit(50), [F.desc("x"), F.col("vec_id")])
    return D.fuse({"semantic": semantic, "keyword": keyword}, "vec_id", 20).withColumn("score", F.round("score", 9))


@query()
def C07_overlap_suppression(spark, sf):
    c = Q.windows(table(spark, sf, "documents").where(F.col("text").contains("ndtion")), ["doc_id"], "text", 240, 220).where(F.col("piece").contains("ndtion"))
    n = (F.length("piece") - F.length(F.replace("piece", F.lit("ndtion"), F.lit("")))).alias("n")
    best = c.select("doc_id", "start", (F.col("start") + F.length("piece")).alias("end"), n).orderBy(F.desc("n"), "doc_id", "start").limit(D.CANDIDATES)
    return D.without_overlaps(D.ranked(best, [F.desc("n"), F.col("doc_id"), F.col("start")]), "rank", "doc_id", "start", "end")


def _block_rows(spark, sf):
    p = passages(spark, sf)
    return p.select("file_id", "row_no", "kind", F.lit("main").alias("layer"), F.floor(F.col("row_no") / 12).cast("string").alias("boundary"), "text_orig")


def _files(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")


@query()
def W03_result_blocks(spark, sf):
    return B.over_files(_files(spark, sf), "rein", score=lambda line: -float(len(line)))


@query()
def O03_block_order(spark, sf):
    return B.listed(B.over_files(_files(spark, sf), "an", "short", opens="and")).limit(200)


@query(f"""WITH {SECTIONS}, s AS (SELECT file_id, first_row, label, lead(first_row) OVER (PARTITION BY file_id ORDER BY first_row) AS stop FROM sections), h AS (SELECT * FROM s WHERE contains(label, 'an'))
SELECT h.file_id, h.label, min(p.row_no) AS anchor FROM h JOIN passages p ON p.file_id = h.file_id AND p.kind = 'passage' AND p.row_no >= h.first_row AND (h.stop IS NULL OR p.row_no < h.stop) GROUP BY h.file_id, h.label, h.first_row ORDER BY h.file_id, anchor LIMIT 50""")
def Q07_section_hits(spark, sf):
    from lectern.operators.relational import in_interval, intervals

    s = intervals(sections(spark, sf), "file_id", "first_row")
    p = passages(spark, sf).where("kind = 'passage'").select("file_id", "row_no")
    inside = in_interval(p, s, "file_id", "row_no", "first_row", "stop", ["label"]).where(F.col("label").contains("an"))
    return inside.groupBy("file_id", "label", "first_row").agg(F.min("row_no").alias("anchor")).orderBy("file_id", "anchor").limit(50).select("file_id", "label", "anchor")
