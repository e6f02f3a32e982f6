"""Text functions, predicates, keyword search and index tables on the passages view."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import search as S
from lectern.plans.registry import query
from lectern.plans.views import NORMAL, PASSAGES, passages, table

#: A small conversion table that stands in for script conversion.
ACCENTS = dict(zip("éèêçäöüßñóí", "eeecaousnoi"))
ACC = "'éèêçäöüßñóí', 'eeecaousnoi'"


@query("SELECT event_id, CAST(json_extract_string(props, '$.page') AS VARCHAR) AS page, concat(event_type, coalesce('-' || CAST(user_id % 5 AS VARCHAR), '')) AS label, nullif(event_type, 'click') AS other FROM events")
def F01_row_projection(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.concat("event_type", F.coalesce(F.concat(F.lit("-"), (F.col("user_id") % 5).cast("string")), F.lit(""))).alias("label"), F.nullif("event_type", F.lit("click")).alias("other"))


@query(f"WITH {PASSAGES} SELECT passage_id FROM passages WHERE contains(lower(text_orig), 'the.')")
def F02_substring(spark, sf):
    return passages(spark, sf).where(T.contains("text_orig", "The.")).select("passage_id")


@query(f"WITH {PASSAGES} SELECT passage_id FROM passages WHERE contains(lower(text_orig), 'rein') OR contains(lower(text_orig), 'ndtion') OR contains(lower(text_orig), 'léé')")
def F03_any_of(spark, sf):
    return passages(spark, sf).where(T.contains_any("text_orig", ["rein", "ndtion", "léé"])).select("passage_id")


@query(f"WITH {PASSAGES} SELECT passage_id FROM passages WHERE (contains(lower(text_orig), 'rein') OR contains(lower(text_orig), 'ndtion')) AND (contains(lower(text_orig), 'are') OR contains(lower(text_orig), 'ver'))")
def F04_all_groups(spark, sf):
    return passages(spark, sf).where(T.contains_all("text_orig", [["rein", "ndtion"], ["are", "ver"]])).select("passage_id")


@query(f"WITH {PASSAGES} SELECT passage_id, row_no FROM passages WHERE kind = 'passage' AND family = 'en' AND contains(text_orig, 'on') ORDER BY file_id, row_no LIMIT 50")
def F05_facets(spark, sf):
    p = passages(spark, sf).where("kind = 'passage' and family = 'en'").where(F.col("text_orig").contains("on"))
    return p.orderBy("file_id", "row_no").limit(50).select("passage_id", "row_no")


@query("SELECT doc_id FROM documents WHERE source = 'src3'")
def F06_book_alias(spark, sf):
    docs = table(spark, sf, "documents")
    books = docs.select("source").distinct().select(F.col("source").alias("book_id"), F.array(F.concat(F.lit("book "), F.substring("source", 4, 9))).alias("names"))
    return docs.where(F.col("source") == S.resolve_book(books, "book 3")).select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(^|[^aeiou])on')")
def F08_bare_mention(spark, sf):
    return table(spark, sf, "conversations").where(T.bare_mention("text", "on", "aeiou")).select("conv_id", "turn")


@query("SELECT doc_id, contains(text, 'rein') AS canonical, regexp_matches(text, '(^|[^aeiou])on') OR contains(text, 'au') AS any_alias FROM documents")
def F09_any_form(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").contains("rein").alias("canonical"), (T.bare_mention("text", "on", "aeiou") | F.col("text").contains("au")).alias("any_alias"))


@query("SELECT doc_id FROM documents WHERE contains(replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')), 'é', 'e'), 'eleme') AND contains(replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')), 'é', 'e'), 'ver')")
def F11_chunk_predicate(spark, sf):
    x = F.replace(T.letters_only("text"), F.lit("é"), F.lit("e"))
    return table(spark, sf, "documents").where(x.contains("eleme") & x.contains("ver")).select("doc_id")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)")
def F12_existence(spark, sf):
    hit = table(spark, sf, "lineitem").where("l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey").join(hit, "s_suppkey", "left_semi")


@query(f"WITH {PASSAGES} SELECT passage_id FROM passages WHERE contains(lower(normalized_text), 'ndtion')")
def F13_index_prefilter(spark, sf):
    p = passages(spark, sf)
    grams = S.postings(p.where("normalized_text is not null").withColumn("normalized_text", T.fold("normalized_text")), 3).where(F.col("gram").isin("ndt", "dti", "tio", "ion"))
    some = grams.groupBy("passage_id").agg(F.count(F.lit(1)).alias("k")).where("k = 4")
    return p.join(some, "passage_id", "left_semi").where(T.contains("normalized_text", "ndtion")).select("passage_id")


@query("SELECT a.conv_id, a.turn, b.turn AS near_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = b.role AND abs(a.turn - b.turn) = 2")
def F14_scope_equality(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    b = c.select("conv_id", "role", F.explode(F.array(F.col("turn") - 2, F.col("turn") + 2)).alias("turn"), F.col("turn").alias("near_turn"))
    return c.join(b, ["conv_id", "role", "turn"]).select("conv_id", "turn", "near_turn")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes, length(text) - length(replace(text, chr(10), '')) AS breaks, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents")
def S02_scan_files(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.octet_length(t).cast("long").alias("bytes"), F.regexp_count(t, F.lit("\n")).cast("long").alias("breaks"), F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("digits"))


@query("SELECT doc_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS file_no FROM documents ORDER BY file_no, doc_id LIMIT 100")
def S03_natural_order(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("file_no")).orderBy("file_no", "doc_id").limit(100)


@query("SELECT doc_id, source AS title, lang AS edition, 2 AS header_lines, length(text) AS body_chars FROM documents")
def S04_header_split(spark, sf):
    from lectern.sources.markup import split_header

    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("#+TITLE: "), "source", F.lit("\n#+EDITION: "), "lang", F.lit("\n"), "text").alias("raw"))
    h = split_header(F.col("raw"))
    return d.select("doc_id", h["header"]["TITLE"].alias("title"), h["header"]["EDITION"].alias("edition"), F.size(h["header"]).alias("header_lines"), F.length(h["body"]).alias("body_chars"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'germanic' WHEN 'de' THEN 'germanic' WHEN 'fr' THEN 'romance' END AS family FROM documents")
def S05_family_of_edition(spark, sf):
    m = F.create_map(*[F.lit(x) for x in ("en", "germanic", "de", "germanic", "fr", "romance")])
    return table(spark, sf, "documents").select("doc_id", m[F.col("lang")].alias("family"))


@query(f"WITH {PASSAGES}, w AS (SELECT file_id, row_no, text_orig, kind FROM passages), c AS (SELECT file_id, min(row_no) AS lo, max(row_no) AS hi, row_no // 4 AS block FROM passages WHERE kind = 'passage' GROUP BY file_id, row_no // 4) SELECT w.file_id, w.row_no, c.block FROM w LEFT JOIN c ON w.file_id = c.file_id AND w.row_no BETWEEN c.lo AND c.hi")
def S11_raw_window(spark, sf):
    from lectern.operators.relational import as_of

    p = passages(spark, sf)
    c = p.where("kind = 'passage'").groupBy("file_id", F.floor(F.col("row_no") / 4).alias("block")).agg(F.min("row_no").alias("lo"), F.max("row_no").alias("hi"))
    found = as_of(p.select("file_id", "row_no"), c, "file_id", "row_no", "lo", ["block", "hi"])
    return found.select("file_id", "row_no", F.when(F.col("row_no") <= F.col("hi"), F.col("block")).alias("block"))


@query("SELECT event_id, k, v FROM (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events) t, LATERAL (SELECT json_extract_string(props, '$.' || k) AS v)")
def S12_json_blocks(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))


@query("SELECT 'lang' AS c, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def S13_dictionary_columns(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("value")) for c in ("lang", "source")])).alias("x")).select("x.*").groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, list_sort(list_filter(['path', 'mail', 'key'], lambda x: CASE x WHEN 'path' THEN regexp_matches(text, '(/home/|[A-Z]:\\\\)') WHEN 'mail' THEN regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') ELSE regexp_matches(text, '[0-9a-f]{32}') END)) AS leaks FROM documents WHERE regexp_matches(text, '(/home/|[A-Z]:\\\\)|[a-z0-9.]+@[a-z0-9.]+|[0-9a-f]{32}')")
def S16_leak_scrub(spark, sf):
    from lectern.operators.audit import leaks

    return leaks(table(spark, sf, "documents"), "doc_id", "text", {"path": r"(/home/|[A-Z]:\\)", "mail": r"[a-z0-9.]+@[a-z0-9.]+", "key": r"[0-9a-f]{32}"})


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def S17_quotes_in_texts(spark, sf):
    from lectern.operators.audit import quoted

    return quoted(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "doc_id")


@query("SELECT doc_id, translate(text, " + ACC + ") AS simple, length(regexp_replace(text, '[^éèêçäöüßñóí]', '', 'g')) AS changed FROM documents")
def Q10_simplified(spark, sf):
    d = table(spark, sf, "documents")
    simple = T.converted("text", ACCENTS)
    return d.select("doc_id", simple.alias("simple"), T.changed_characters(F.col("text"), simple).cast("long").alias("changed"))


@query("SELECT n_name, unnest(list_distinct([n_name, translate(n_name, 'AEIOU', 'aeiou'), translate(n_name, 'aeiou', 'AEIOU')])) AS variant FROM nation")
def Q08_variants(spark, sf):
    there, back = F.translate("n_name", "AEIOU", "aeiou"), F.translate("n_name", "aeiou", "AEIOU")
    return table(spark, sf, "nation").select("n_name", F.explode(F.array_distinct(F.array("n_name", there, back))).alias("variant"))


@query("SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS searched FROM documents")
def Q14_letters_only(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.letters_only("text").alias("searched"))


@query(f"WITH {PASSAGES} SELECT passage_id, book_id, row_no FROM passages WHERE contains(lower(normalized_text), 'ment') AND contains(lower(normalized_text), 'eau') AND family = 'fr' ORDER BY book_id, file_id, row_no LIMIT 20")
def Q02_keyword_search(spark, sf):
    return S.search(passages(spark, sf), "ment eau", ["book_id", "file_id", "row_no"], family="fr").select("passage_id", "book_id", "row_no")


BM25 = """t AS (SELECT coalesce(normalized_text, '') AS x, * FROM passages), s AS (SELECT count(*) AS n, sum(greatest(length(x) - 2, 0)) AS total, {dfs} FROM t)
SELECT passage_id, round(-({sum}), 6) AS score FROM t, s WHERE {where}"""


def _bm25_sql(terms: list[str]) -> str:
    dfs = ", ".join(f"count(*) FILTER (WHERE contains(lower(x), '{t}')) AS df{i}" for i, t in enumerate(terms))
    tf = [f"((length(x) - length(replace(lower(x), '{t}', ''))) / {len(t)})" for t in terms]
    part = [f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * greatest(length(x) - 2, 0) / (total / n)))" for i, f in enumerate(tf)]
    where = " AND ".join(f"contains(lower(x), '{t}')" for t in terms)
    return f"WITH {PASSAGES}, " + BM25.format(dfs=dfs, sum=" + ".join(part), where=where)


@query(_bm25_sql(["rein"]))
def Q03_bm25_phrase(spark, sf):
    return S.bm25(passages(spark, sf), ["rein"]).select("passage_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(["rein", "are"]))
def A12_bm25_terms(spark, sf):
    return S.bm25(passages(spark, sf), ["rein", "are"]).select("passage_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(["ndtion"]) + " ORDER BY score, passage_id LIMIT 25")
def O01_bm25_order(spark, sf):
    return S.bm25(passages(spark, sf), ["ndtion"]).select("passage_id", F.round("score", 6).alias("score")).orderBy("score", "passage_id").limit(25)


@query("SELECT gram, count(*) AS df, sum(tf) AS cf FROM (SELECT conv_id, turn, gram, count(*) AS tf FROM (SELECT conv_id, turn, unnest(list_transform(generate_series(1, length(text) - 1), lambda i: substr(text, CAST(i AS INT), 2))) AS gram FROM conversations WHERE length(text) >= 2) GROUP BY 1, 2, 3) GROUP BY 1")
def Q05_index_build(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("passage_id"), F.col("text").alias("normalized_text"))
    return S.postings(c, 2).groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'ti') AND contains(lower(text), 'ou')")
def Q04_bigram_terms(spark, sf):
    return S.hits(table(spark, sf, "conversations"), S.plan("ti ou"), "text").select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'ré') OR contains(lower(text), 're')")
def Q09_spellings(spark, sf):
    return S.hits(table(spark, sf, "conversations"), S.plan("ré", {"é": "e"}), "text").select("conv_id", "turn")


@query("""SELECT conv_id, turn, len(list_filter(w, lambda x: length(x) >= 3)) AS long, len(list_filter(w, lambda x: length(x) < 3)) AS short,
CASE WHEN len(list_filter(w, lambda x: length(x) >= 3)) > 0 THEN 'trigram' WHEN len(w) > 0 AND len(list_filter(w, lambda x: length(x) <> 2)) = 0 THEN 'bigram' ELSE 'scan' END AS path
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations)""")
def Q01_query_plan(spark, sf):
    def run(batches):
        for batch in batches:
            rows = [(c, t, len(p.long), len(p.short), p.path) for c, t, x in zip(batch["conv_id"], batch["turn"], batch["text"]) for p in [S.plan(x)]]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "long", "short", "path"])

    return table(spark, sf, "conversations").select("conv_id", "turn", "text").mapInPandas(run, "conv_id long, turn long, long long, short long, path string")


MARKED = "'<pb:' || book_id || '_' || family || '_' || (file_id % 50) || '-' || row_no || (CASE WHEN row_no % 3 = 0 THEN '' ELSE 'a' END) || '>' || text_orig || '¶'"


def _marked():
    side = F.when(F.col("row_no") % 3 == 0, "").otherwise("a")
    return F.concat(F.lit("<pb:"), "book_id", F.lit("_"), "family", F.lit("_"), (F.col("file_id") % 50).cast("string"), F.lit("-"), F.col("row_no").cast("string"), side, F.lit(">"), "text_orig", F.lit("¶"))


@query(f"WITH {PASSAGES} SELECT passage_id, book_id AS book, family AS edition, CAST(file_id % 50 AS VARCHAR) AS block, CAST(row_no AS VARCHAR) AS page, CASE WHEN row_no % 3 = 0 THEN '' ELSE 'a' END AS side FROM passages")
def P10_page_markers(spark, sf):
    p = passages(spark, sf).select("passage_id", T.page_marker(_marked()).alias("pb"))
    return p.select("passage_id", F.col("pb.book_id").alias("book"), "pb.edition", "pb.block", "pb.page", "pb.side")


@query(f"WITH {PASSAGES}, m AS (SELECT passage_id, {MARKED} AS t FROM passages) SELECT passage_id, {NORMAL} AS normal FROM m")
def P15_normalize(spark, sf):
    return passages(spark, sf).select("passage_id", T.normalize(_marked()).alias("normal"))


@query("SELECT doc_id, t AS src_text, w[1] AS prefix, CASE WHEN len(w) > 1 THEN array_to_string(w[2:], ' ') END AS section_ref FROM (SELECT doc_id, t, string_split(t, ' ') AS w FROM (SELECT doc_id, source || ' ' || lang || ' ' || n_chars AS t FROM documents))")
def P11_source_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.source_line(F.concat(F.lit("# src: "), "source", F.lit(" "), "lang", F.lit(" "), F.col("n_chars").cast("string"))).alias("s"))
    return d.select("doc_id", "s.*")


@query(f"WITH {PASSAGES} SELECT passage_id, row_no || '.' || (file_id % 7) AS code FROM passages")
def P12_paragraph_code(spark, sf):
    x = F.concat(F.lit("Lun "), F.col("row_no").cast("string"), F.lit("."), (F.col("file_id") % 7).cast("string"), F.lit(".3 "), "text_orig")
    return passages(spark, sf).select("passage_id", T.paragraph_code(x).alias("code"))


@query(f"WITH {PASSAGES} SELECT passage_id, CASE WHEN regexp_matches(text_orig, '^The ') THEN 'A' WHEN regexp_matches(text_orig, '^[A-Z][a-z]+,') THEN 'B' WHEN regexp_matches(text_orig, '[0-9]') THEN 'N' ELSE 'plain' END AS entry FROM passages")
def P13_entry_class(spark, sf):
    x = F.col("text_orig")
    return passages(spark, sf).select("passage_id", F.when(x.rlike("^The "), "A").when(x.rlike("^[A-Z][a-z]+,"), "B").when(x.rlike("[0-9]"), "N").otherwise("plain").alias("entry"))


@query("SELECT doc_id, CASE WHEN lang = 'de' AND doc_id % 2 = 0 THEN 'preface' WHEN lang = 'de' THEN 'main' WHEN doc_id % 2 = 0 THEN 'appendix' ELSE 'main' END AS layer FROM documents")
def P14_layer_rules(spark, sf):
    from lectern.operators.audit import first_rule

    rules = [(1, "de", 0, "preface"), (2, "de", None, "main"), (3, None, 0, "appendix")]
    return first_rule(table(spark, sf, "documents").withColumn("parity", F.col("doc_id") % 2), rules, ["lang", "parity"], "main").select("doc_id", "layer")


@query(f"WITH {PASSAGES} SELECT passage_id, regexp_replace(translate(substr(text_orig, 1, 20), {ACC}), '[\\s.,]+', '_', 'g') AS label FROM passages")
def P16_label_folding(spark, sf):
    return passages(spark, sf).select("passage_id", F.regexp_replace(T.converted(F.substring("text_orig", 1, 20), ACCENTS), r"[\s.,]+", "_").alias("label"))


@query(f"""WITH {PASSAGES}, r(ord, pat, method, conf) AS (VALUES (1, '^[A-Z]+ ', 'caps', CAST(0.9 AS DOUBLE)), (2, '^The [a-z]+', 'article', 0.8), (3, '^.{{0,40}}$', 'short', 0.5))
SELECT passage_id, arg_min(method, ord) AS method, arg_min(conf, ord) AS confidence FROM passages JOIN r ON regexp_matches(text_orig, pat) GROUP BY 1""")
def P17_title_patterns(spark, sf):
    from lectern.sources.markup import first_pattern

    patterns = [("caps", "^[A-Z]+ ", 0.9), ("article", "^The [a-z]+", 0.8), ("short", "^.{0,40}$", 0.5)]
    p = passages(spark, sf).withColumn("m", first_pattern(F.col("text_orig"), patterns)).where("m is not null")
    return p.select("passage_id", "m.method", "m.confidence")
