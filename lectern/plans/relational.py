"""Joins, aggregations, sorts, limits and set operations, on the tables at hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import relational as R
from lectern.plans.registry import query
from lectern.plans.views import PASSAGES, SECTIONS, passages, sections, table


@query("SELECT l_orderkey, l_linenumber, l_quantity, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def J01_star_join(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate >= timestamp'1998-01-01'").select("l_orderkey", "l_linenumber", "l_quantity")
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "l_quantity", "c_name", "n_name")


@query(f"WITH {PASSAGES}, hits AS (SELECT passage_id, 1.0 / length(text_orig) AS score FROM passages WHERE text_orig LIKE '%rein%') SELECT h.passage_id, round(h.score, 9) AS score, p.book_id, p.row_no FROM hits h JOIN passages p USING (passage_id)")
def J02_hits_join_facts(spark, sf):
    p = passages(spark, sf)
    hits = p.where(F.col("text_orig").contains("rein")).select("passage_id", F.round(1.0 / F.length("text_orig"), 9).alias("score"))
    return hits.join(p.select("passage_id", "book_id", "row_no"), "passage_id")


@query(f"WITH {SECTIONS}, f AS (SELECT file_id, min(first_row) AS fr FROM sections GROUP BY 1) SELECT p.file_id, count(*) AS uncovered FROM passages p JOIN f ON f.file_id = p.file_id AND p.row_no < f.fr GROUP BY 1")
def J03_rows_before_first_section(spark, sf):
    return R.rows_before_first(passages(spark, sf), sections(spark, sf)).groupBy("file_id").agg(F.count(F.lit(1)).alias("uncovered"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def J04_anti_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query(f"WITH {SECTIONS} SELECT p.passage_id, s.label FROM passages p ASOF LEFT JOIN sections s ON p.file_id = s.file_id AND p.row_no >= s.first_row")
def J05_as_of_section(spark, sf):
    p = passages(spark, sf).select("file_id", "row_no", "passage_id")
    return R.as_of(p, sections(spark, sf), "file_id", "row_no", "first_row", ["label"]).select("passage_id", "label")


@query(f"""WITH {SECTIONS}, spans AS (SELECT file_id, first_row, label, lead(first_row) OVER (PARTITION BY file_id ORDER BY first_row) AS stop FROM sections)
SELECT p.passage_id, s.label, s.first_row FROM passages p JOIN spans s ON p.file_id = s.file_id AND p.row_no >= s.first_row AND (s.stop IS NULL OR p.row_no < s.stop)""")
def J06_interval_join(spark, sf):
    spans = R.intervals(sections(spark, sf), "file_id", "first_row")
    p = passages(spark, sf).select("file_id", "row_no", "passage_id")
    return R.in_interval(p, spans, "file_id", "row_no", "first_row", "stop", ["label"]).select("passage_id", "label", "first_row")


@query("SELECT doc_id, w AS code, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS w FROM documents) GROUP BY 1, 2")
def J07_lateral_unnest(spark, sf):
    codes = F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))).alias("code")
    return table(spark, sf, "documents").select("doc_id", codes).groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def J08_semi_join(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("SELECT l_suppkey, l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2")
def J09_bridge_first_occurrence(spark, sf):
    return R.first_occurrence(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"], [F.col("l_orderkey").alias("first_order")])


@query("SELECT conv_id, turn, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def J10_neighbours(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


@query("SELECT s_suppkey, s_name, coalesce(n, 0) AS n_lines, coalesce(q, 0) AS quantity FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON s_suppkey = l_suppkey")
def J11_left_merge(spark, sf):
    agg = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    return R.left_merge(table(spark, sf, "supplier").select("s_suppkey", "s_name"), agg, "s_suppkey", "l_suppkey", {"n_lines": 0, "quantity": 0.0})


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def J15_left_outer(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


@query("""WITH a AS (SELECT source, lang, count(*) AS expected FROM documents GROUP BY 1, 2), b AS (SELECT d.source, CASE WHEN quality = 1 THEN d.lang ELSE 'xx' END AS lang, count(*) AS declared FROM labels JOIN documents d USING (doc_id) GROUP BY 1, 2)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.lang, b.lang) AS lang, expected, declared, CASE WHEN expected IS NULL THEN 'unregistered' WHEN declared IS NULL THEN 'missing' WHEN expected = declared THEN 'complete' WHEN declared > expected THEN 'surplus' ELSE 'partial' END AS status FROM a FULL JOIN b ON a.source = b.source AND a.lang = b.lang""")
def J14_reconcile(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "source", "lang"), table(spark, sf, "labels")
    expected = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("expected"))
    found = labels.join(docs, "doc_id").withColumn("lang", F.when(F.col("quality") == 1, F.col("lang")).otherwise("xx"))
    return R.reconcile(expected, found.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("declared")), ["source", "lang"])


@query("""SELECT source, count(*) AS files, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE n_chars > 2000) AS long_files,
count(*) FILTER (WHERE text LIKE '%' || chr(10) || '%') AS multi_line, count(*) FILTER (WHERE text LIKE '%(%') AS bracketed FROM documents GROUP BY 1""")
def A01_conditional_counts(spark, sf):
    tests = {"en": "lang = 'en'", "de": "lang = 'de'", "long_files": "n_chars > 2000", "multi_line": "text like '%\n%'", "bracketed": "text like '%(%'"}
    return R.conditional_counts(table(spark, sf, "documents"), ["source"], "files", tests)


@query("SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS users, min(turn) FILTER (WHERE role = 'assistant') AS first_answer, max(turn) FILTER (WHERE role = 'assistant') AS last_answer FROM conversations GROUP BY 1")
def A02_conditional_extremes(spark, sf):
    answer = F.when(F.col("role") == "assistant", F.col("turn"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("users"), F.min(answer).alias("first_answer"), F.max(answer).alias("last_answer"))


@query("SELECT count(*) AS files, count(DISTINCT source) AS books, sum(n_chars) AS chars, max(n_chars) AS longest, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents")
def A03_global_stats(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("source").alias("books"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.count_if(F.col("lang") == "fr").alias("fr"))


@query("SELECT l_returnflag, l_linestatus, month(l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def A04_count_by_three_keys(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", F.month("l_shipdate").cast("long").alias("m")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SECTIONS} SELECT file_id, min(first_row) AS first_row FROM sections GROUP BY 1")
def A05_first_section_row(spark, sf):
    return sections(spark, sf).groupBy("file_id").agg(F.min("first_row").alias("first_row"))


@query("SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING l_suppkey IN (1, 2, 3, 5, 8) AND count(*) > 10")
def A06_group_filter(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_suppkey").isin(1, 2, 3, 5, 8)).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")).where("n > 10")


@query("SELECT 'source' AS c, count(DISTINCT source) AS n_distinct, max(length(source)) AS longest FROM documents UNION ALL SELECT 'lang', count(DISTINCT lang), max(length(lang)) FROM documents UNION ALL SELECT 'text', count(DISTINCT text), max(length(text)) FROM documents")
def A07_column_profile(spark, sf):
    return R.profile(table(spark, sf, "documents"), ["source", "lang", "text"])


@query("SELECT code, count(*) AS n, min(doc_id) AS first_file FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS code FROM documents) GROUP BY 1")
def A08_code_histogram(spark, sf):
    return R.code_histogram(table(spark, sf, "documents"), "doc_id", "text", "([0-9]{4,})")


@query(f"WITH {PASSAGES} SELECT term, count(*) AS n FROM passages JOIN (VALUES ('in'), ('au'), ('rein'), ('ndtion'), ('zzz')) v(term) ON contains(lower(text_orig), term) GROUP BY 1")
def A11_corpus_counts(spark, sf):
    return R.corpus_counts(passages(spark, sf), "text_orig", ["in", "au", "rein", "ndtion", "zzz"])


@query("SELECT CASE WHEN quality IS NULL THEN 'untagged' ELSE 'q' || quality END AS method, count(*) AS n, count(*) FILTER (WHERE coalesce(toxic, 1) = 1) AS low FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def A13_method_histogram(spark, sf):
    j = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    method = F.coalesce(F.concat(F.lit("q"), F.col("quality").cast("string")), F.lit("untagged"))
    return j.groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("toxic", F.lit(1)) == 1).alias("low"))


@query("""WITH w AS (SELECT source, CAST(doc_id % 40 AS INT) AS num, 'label' AS via, doc_id FROM documents JOIN labels USING (doc_id) UNION ALL SELECT source, CAST(doc_id % 40 AS INT), 'page', doc_id FROM documents JOIN pages ON page_id = doc_id),
m AS (SELECT source, num, count(DISTINCT doc_id) AS files, count(DISTINCT via) AS kinds FROM w GROUP BY 1, 2),
s AS (SELECT source, min(num) AS lo, max(num) AS hi, count(*) AS n, count(*) FILTER (WHERE files > 1) AS split, list(num) AS have FROM m GROUP BY 1)
SELECT source, lo, hi, n, split, hi - lo + 1 - n AS gaps, array_to_string(list_sort(list_filter(generate_series(lo, hi), lambda x: NOT list_contains(have, x))), ',') AS missing FROM s""")
def A14_volume_measure(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    a = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id").withColumn("via", F.lit("label"))
    b = d.join(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id")), "doc_id").withColumn("via", F.lit("page"))
    return R.measure_volumes(a.unionByName(b).withColumn("num", (F.col("doc_id") % 40).cast("int")), "source", "num", "doc_id")


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def A15_rollup(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 2).cast("double").alias("balance"))


@query("SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS pass, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS warn, count(*) FILTER (WHERE quality = 0) AS fail FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def A16_recall_metrics(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return R.recall_metrics(j.withColumn("outcome", F.when(F.col("quality") == 0, "fail").when(F.col("toxic") == 1, "warn").otherwise("pass")), "lang", "outcome", ["pass", "warn", "fail"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def O07_top_k(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(f"WITH {PASSAGES} SELECT passage_id, book_id, file_id, row_no FROM passages WHERE contains(lower(text_orig), 'rein') ORDER BY book_id, file_id, row_no LIMIT 20 OFFSET 40")
def O08_paging(spark, sf):
    p = passages(spark, sf).where(F.lower("text_orig").contains("rein")).select("passage_id", "book_id", "file_id", "row_no")
    return R.page(p, ["book_id", "file_id", "row_no"], 3, 20)


@query("SELECT p_partkey, p_name FROM part ORDER BY (p_brand = 'Brand#11') DESC, length(p_name), p_partkey LIMIT 50")
def O05_expression_sort(spark, sf):
    return table(spark, sf, "part").orderBy((F.col("p_brand") == "Brand#11").desc(), F.length("p_name"), "p_partkey").select("p_partkey", "p_name").limit(50)


@query("SELECT s_suppkey FROM supplier ORDER BY CASE WHEN s_nationkey IN (3, 7) THEN 0 ELSE 1 END, s_suppkey LIMIT 30")
def O06_case_sort(spark, sf):
    return table(spark, sf, "supplier").orderBy(F.when(F.col("s_nationkey").isin(3, 7), 0).otherwise(1), "s_suppkey").select("s_suppkey").limit(30)


@query(f"WITH {PASSAGES}, h AS (SELECT passage_id FROM passages WHERE contains(lower(text_orig), 'in')) SELECT * FROM (SELECT passage_id, (SELECT count(*) FROM h) > 2000 AS truncated FROM h ORDER BY passage_id LIMIT 2000)")
def O09_capped_pool(spark, sf):
    return R.capped(passages(spark, sf).where(F.lower("text_orig").contains("in")).select("passage_id"), ["passage_id"], 2000)


@query(f"WITH {PASSAGES} SELECT passage_id, min(pool) AS pool FROM (SELECT passage_id, 1 AS pool FROM passages WHERE contains(text_orig, 'rein') UNION ALL SELECT passage_id, 2 FROM passages WHERE contains(text_orig, 'ung')) GROUP BY 1")
def U01_union_first_wins(spark, sf):
    p = passages(spark, sf)
    return R.union_first([p.where(F.col("text_orig").contains(t)).select("passage_id") for t in ("rein", "ung")], ["passage_id"], "pool")


@query("SELECT key, CASE WHEN bool_or(t) AND bool_or(s) THEN 'both' WHEN bool_or(t) THEN 'text' ELSE 'section' END AS match_type FROM (SELECT o_custkey AS key, true AS t, false AS s FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT c_custkey, false, true FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def U02_match_types(spark, sf):
    a = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("key"))
    return R.match_types(a, table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key")), "key")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def U03_difference(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS labels_in_documents, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS documents_in_labels")
def U04_subset_invariant(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return R.is_subset(l, d, "labels_in_documents").crossJoin(R.is_subset(d, l, "documents_in_labels"))  # one row each


@query("SELECT 'documents' AS name, count(*) AS n, count(*) - count(DISTINCT doc_id) AS repeated FROM documents UNION ALL SELECT 'labels', count(*), count(*) - count(DISTINCT doc_id) FROM labels")
def S09_key_fingerprint(spark, sf):
    return R.key_report(table(spark, sf, "documents"), "documents", "doc_id").unionByName(R.key_report(table(spark, sf, "labels"), "labels", "doc_id"))
