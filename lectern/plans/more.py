"""Further queries: storage, catalog checks, terms, packs and modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import dense as D
from lectern.operators import evidence as V
from lectern.operators import pack as K
from lectern.operators import question as N
from lectern.operators import relational as R
from lectern.operators import search as S
from lectern.operators import sequence as Q
from lectern.plans.inquiry import NAMES, PLAN, WORDS
from lectern.plans.registry import query
from lectern.plans.retrieval import ACC, ACCENTS, MARKED, _marked
from lectern.plans.sequence import _files, _first
from lectern.plans.views import PASSAGES, passages, sections, table
from lectern.sources import catalog as C
from lectern.sources import storage


@query("SELECT lang AS book_id, count(*) AS n, sum(row_no) AS rows FROM (SELECT lang, unnest(generate_series(1, len(string_split(text, chr(10))))) AS row_no FROM documents) GROUP BY 1")
def S06_jsonl_round_trip(spark, sf):
    from lectern.sources.markup import RECORD, parse

    d = table(spark, sf, "documents")
    records = parse(d.select(F.col("doc_id").alias("file_id"), "text")).join(d.select(F.col("doc_id").alias("file_id"), F.col("lang").alias("book_id")), "file_id")
    path = storage.shared_dir(spark)
    storage.write_jsonl(records, path)
    return storage.read_jsonl(spark, path, RECORD + ", book_id string").select("book_id", "file_id", "row_no").distinct().groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.sum("row_no").alias("rows"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unregistered' ELSE 'changed' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.toxic = 1")
def S08_manifest_check(spark, sf):
    d = table(spark, sf, "documents")
    inputs = d.select("doc_id", F.sha2("text", 256).alias("sha"))
    manifest = table(spark, sf, "labels").join(inputs, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "other").otherwise(F.col("sha")).alias("sha"))
    return storage.unregistered(inputs, manifest, "doc_id", "sha")


@query("WITH p AS (SELECT 'source' AS c, count(DISTINCT source) AS n_distinct FROM documents UNION ALL SELECT 'lang', count(DISTINCT lang) FROM documents UNION ALL SELECT 'text', count(DISTINCT text) FROM documents) SELECT *, n_distinct * 10 <= (SELECT count(*) FROM documents) AS chosen FROM p")
def S14_dictionary_choice(spark, sf):
    return storage.dictionary_columns(table(spark, sf, "documents"), ["source", "lang", "text"])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE embedding IS NULL) AS missing, count(*) FILTER (WHERE len(embedding) <> 64) AS other_size, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: isnan(x) OR x IS NULL)) > 0) AS no_numbers FROM embeddings")
def S18_vector_source(spark, sf):
    return storage.vector_faults(table(spark, sf, "embeddings"), "embedding", 64)


@query(f"SELECT count(*) AS texts, count(*) FILTER (WHERE length(translate(text, {ACC})) <> length(text)) AS changed_length, count(*) FILTER (WHERE translate(text, {ACC}) <> text) AS changed FROM documents")
def S19_table_verified(spark, sf):
    from lectern.functions.text import converted

    x = converted("text", ACCENTS)
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.length(x) != F.length("text")).alias("changed_length"), F.count_if(x != F.col("text")).alias("changed"))


@query(f"""WITH {PASSAGES} SELECT passage_id, last_value(CASE WHEN row_no % 4 = 1 THEN regexp_extract({MARKED}, '<pb:[^>]*>') END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY row_no) AS page FROM passages""")
def P02_current_page(spark, sf):
    from lectern.functions.text import page_marker

    own = F.when(F.col("row_no") % 4 == 1, page_marker(_marked())["raw"])
    return Q.sticky(passages(spark, sf), "file_id", "row_no", own, "page").select("passage_id", "page")


@query(f"WITH {PASSAGES} SELECT passage_id, length(regexp_extract(h, '^(\\*+) ', 1)) AS level, regexp_replace(h, '^\\*+ +', '') AS label FROM (SELECT passage_id, CASE WHEN row_no % 5 = 1 THEN '** ' || text_orig WHEN row_no % 5 = 2 THEN '*** ' || text_orig ELSE text_orig END AS h FROM passages) WHERE regexp_matches(h, '^\\*+ ')")
def P08_heading_levels(spark, sf):
    h = F.when(F.col("row_no") % 5 == 1, F.concat(F.lit("** "), "text_orig")).when(F.col("row_no") % 5 == 2, F.concat(F.lit("*** "), "text_orig")).otherwise(F.col("text_orig"))
    p = passages(spark, sf).select("passage_id", h.alias("h")).where(F.col("h").rlike(r"^\*+ "))
    return p.select("passage_id", F.length(F.regexp_extract("h", r"^(\*+) ", 1)).cast("long").alias("level"), F.regexp_replace("h", r"^\*+ +", "").alias("label"))


@query("SELECT source AS book_id, 'duplicate id' AS problem FROM documents GROUP BY source HAVING count(*) > 1 UNION ALL SELECT source, 'unknown witness' FROM documents WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL SELECT source, 'bad number' FROM documents WHERE n_chars <= 100")
def P18_catalog_problems(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("source", "book_id")
    return C.problems(d, "book_id", {"unknown witness": F.col("lang").isin("en", "de", "fr"), "bad number": F.col("n_chars") > 100})


@query("SELECT doc_id, CASE WHEN lower(lang) IN ('en', 'de') THEN lower(lang) END AS edition FROM documents")
def F07_edition_filter(spark, sf):
    low = F.lower("lang")
    return table(spark, sf, "documents").select("doc_id", F.when(low.isin("en", "de"), low).alias("edition"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(replace(replace(text, 'ther', '.'), 'then', '.'), 'the')")
def F10_trigger_with_exclusions(spark, sf):
    x = F.replace(F.replace(F.col("text"), F.lit("ther"), F.lit(".")), F.lit("then"), F.lit("."))
    return table(spark, sf, "conversations").where(x.contains("the")).select("conv_id", "turn")


@query("SELECT q.vec_id AS q, e.vec_id, round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id < 3")
def J13_query_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    few = e.where("vec_id < 3").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))  # a stated set of three
    return e.crossJoin(F.broadcast(few)).select("q", "vec_id", F.round(D.inner_product(F.col("embedding"), F.col("qv")), 6).alias("score"))


@query(f"WITH {PASSAGES} SELECT file_id, count(*) AS hits FROM passages WHERE contains(text_orig, 'ver') AND kind = 'passage' GROUP BY 1")
def A17_block_matches(spark, sf):
    return B.over_files(_files(spark, sf), "ver").groupBy("file_id").agg(F.sum("match_count").alias("hits"))


@query(f"WITH {PASSAGES} SELECT passage_id FROM passages WHERE contains(lower(normalized_text), 'ung') ORDER BY book_id, file_id, row_no LIMIT 100")
def O02_source_order(spark, sf):
    return S.search(passages(spark, sf), "ung", ["book_id", "file_id", "row_no"], 1, 100).select("passage_id")


@query(f"WITH {PASSAGES} SELECT passage_id FROM passages WHERE contains(lower(normalized_text), 'ung') AND contains(lower(normalized_text), 'ver')")
def Q06_all_hits(spark, sf):
    return S.hits(passages(spark, sf), S.plan("ung ver")).select("passage_id")


@query()
def Q11_block_search(spark, sf):
    return R.page(B.listed(B.over_files(_files(spark, sf), "rein", opens="and")), [F.col("part"), F.desc("match_count"), "score", "file_id", "row_first"], 1, 20)


@query("""WITH x AS (SELECT doc_id, text FROM documents WHERE contains(text, 'rein') AND contains(text, 'ung')),
a AS (SELECT doc_id, i FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 3)) AS i FROM x) WHERE substr(text, CAST(i AS INT), 4) = 'rein'),
b AS (SELECT doc_id, i FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 2)) AS i FROM x) WHERE substr(text, CAST(i AS INT), 3) = 'ung') SELECT doc_id, min(abs(a.i - b.i)) AS gap FROM a JOIN b USING (doc_id) GROUP BY 1""")
def Q13_nearest_gap(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").contains("rein") & F.col("text").contains("ung")).select("doc_id", K.nearest_gap(F.col("text"), "rein", "ung").cast("long").alias("gap"))
    return d.where("gap is not null")


@query()
def C01_bound_chunks(spark, sf):
    p = passages(spark, sf).withColumn("boundary", F.floor(F.col("row_no") / 20).cast("string"))
    return K.bound_chunks(p, "file_id", "row_no", "boundary", "text_orig")


@query("SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(substr(text, 1, 1000)), '\\s+')), ['the', 'of', 'und'])) / 3.0::DOUBLE AS model_score FROM (SELECT * FROM documents ORDER BY (length(text) - length(replace(text, 'the', ''))) / 3 DESC, doc_id LIMIT 120)")
def C10_rerank(spark, sf):
    best = table(spark, sf, "documents").orderBy(F.desc(F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))), "doc_id").limit(120)
    return K.reranked(best, "the of und", "text").select("doc_id", "model_score")


@query()
def C09_hybrid(spark, sf):
    """Keyword, semantic and planned channels over the same keys: a document's vector is that of its id."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("normalized_text"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "embedding").join(docs.select("key"), "key", "left_semi")
    keyword = S.bm25(docs, ["rein"]).orderBy("score", "key").limit(60).select("key", "score")
    semantic = D.nearest(vectors, _first(spark, sf), 60, "key")
    planned = S.hits(docs, S.plan("rein ver")).select("key").orderBy("key").limit(60)
    lists = {"keyword": D.ranked(keyword, [F.col("score"), F.col("key")]), "semantic": D.ranked(semantic, [F.desc("score"), F.col("key")]), "planned": D.ranked(planned, [F.col("key")])}
    return D.fuse(lists, "key", 20)


@query()
def C12_grounded_plan(spark, sf):
    anchors = K.grounded(passages(spark, sf), ["xreinx", "ndtionzz", "qqqq"])
    return spark.createDataFrame([(i, s) for i, s in enumerate(K.searches(anchors, ["ver", "ung"]))], "place int, search string")


@query("SELECT conv_id, turn, intent FROM conversations JOIN (VALUES ('time', 'when'), ('time', 'year'), ('place', 'wh'), ('person', 'her')) v(intent, ask) ON contains(text, ask) WHERE role = 'user' GROUP BY ALL")
def N02_intents(spark, sf):
    asks = spark.createDataFrame([("time", "when"), ("time", "year"), ("place", "wh"), ("person", "her")], "intent string, ask string")
    found = F.array_compact(F.array(*[F.when(F.col("text").contains(r.ask), F.lit(r.intent)) for r in asks.collect()]))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(F.array_distinct(found)).alias("intent"))


@query(f"""WITH {NAMES}, s AS (SELECT short, count(*) AS k, min(name) AS one, count(*) FILTER (WHERE contains('ABCDEF', left(name, 1))) AS near, min(name) FILTER (WHERE contains('ABCDEF', left(name, 1))) AS other FROM n GROUP BY 1)
SELECT short, CASE WHEN k = 1 THEN one WHEN near = 1 THEN other END AS name, CASE WHEN k = 1 THEN 'unique' WHEN near = 1 THEN 'context' ELSE 'unresolved' END AS method FROM s""")
def N04_alias_resolution(spark, sf):
    names = N.names_in_corpus(table(spark, sf, "documents"), "text", "[A-Z][a-z]{1,3}tion")
    return N.resolved(names.select("short", F.lit("ABCDEF").alias("context")).distinct(), names)


@query(f"WITH {NAMES} SELECT name, n FROM n WHERE n >= 3")
def N05_known_entities(spark, sf):
    return N.names_in_corpus(table(spark, sf, "documents"), "text", "[A-Z][a-z]{1,3}tion").where("n >= 3").select("name", "n")


@query(f"WITH {NAMES} SELECT short AS term, CASE WHEN count(DISTINCT name) > 1 THEN 'weak' ELSE 'alias' END AS role FROM n GROUP BY 1")
def N09_term_tiers(spark, sf):
    names = N.names_in_corpus(table(spark, sf, "documents"), "text", "[A-Z][a-z]{1,3}tion")
    return names.groupBy(F.col("short").alias("term")).agg(F.when(F.countDistinct("name") > 1, "weak").otherwise("alias").alias("role"))


@query(f"""WITH RECURSIVE {PASSAGES}, h AS (SELECT file_id, row_no FROM passages WHERE contains(text_orig, 'ver')), b AS (SELECT file_id, min(row_no) AS first, 1 AS batch FROM h GROUP BY 1
UNION ALL SELECT file_id, nxt, batch + 1 FROM (SELECT file_id, batch, (SELECT min(row_no) FROM h WHERE h.file_id = b.file_id AND h.row_no > b.first + 3) AS nxt FROM b) WHERE nxt IS NOT NULL)
SELECT h.file_id, h.row_no, max(batch) AS batch FROM h JOIN b ON h.file_id = b.file_id AND b.first <= h.row_no GROUP BY ALL""")
def N14_hit_clusters(spark, sf):
    p = passages(spark, sf)
    return K.clusters(p.where(F.col("text_orig").contains("ver")), "file_id", "row_no", 3)


@query()
def N16_evidence_pack(spark, sf):
    p = passages(spark, sf)
    scored = K.features(p.where(F.col("text_orig").contains("rein")), "text_orig", ["rein"], ["ver", "ung"]).orderBy(F.desc("score"), "passage_id").limit(240)
    near = Q.context(p.select("file_id", "row_no", "passage_id", "text_orig"), scored, "file_id", "row_no", 6).where("distance between -4 and 6")  # of the same file
    around = near.groupBy("file_id", F.col("anchor").alias("row_no")).agg(F.array_sort(F.collect_list("passage_id")).alias("rows"), F.sum(F.length("text_orig")).cast("int").alias("size"))
    firm = F.col("complete") & F.coalesce(F.col("gap") <= 24, F.lit(False))
    return K.selected(scored.select("file_id", "row_no", "passage_id", "score", firm.alias("firm")).join(around, ["file_id", "row_no"]), "passage_id", "rows", "size", "firm")


@query("SELECT doc_id, CAST(contains(text, 'au') AS INT) AS n_clues FROM documents WHERE regexp_matches(text, 'rein|ung')")
def E04_clues(spark, sf):
    return V.audited(V.subject_pool(table(spark, sf, "documents"), PLAN, "doc_id", "text"), PLAN, "doc_id", "text").select("doc_id", F.size("clues").alias("n_clues"))


@query("SELECT 'rein' AS head, '!zq' AS rest")
def E27_grounded_prefix(spark, sf):
    return spark.createDataFrame([V.grounded_prefix(table(spark, sf, "documents"), "rein!zq", "text")], "head string, rest string")


CHANNELS = {"alias": "ung", "anchor": "rein", "clue": "au", "context": "and", "event": "er,", "office": "on", "place": "an", "relation": "ver"}


@query("WITH t(ch, w) AS (VALUES " + ", ".join(f"('{c}', '{w}')" for c, w in CHANNELS.items()) + """), c AS (SELECT doc_id, ch, (length(text) - length(replace(text, w, ''))) / length(w) AS n FROM documents, t WHERE contains(text, w)),
r AS (SELECT doc_id, ch, row_number() OVER (PARTITION BY ch ORDER BY n DESC, doc_id) AS rank FROM c QUALIFY rank <= 20) SELECT doc_id, min(rank) AS best_rank, string_agg(ch || ':' || rank, ',' ORDER BY ch || ':' || rank) AS votes FROM r GROUP BY 1""")
def E29_admission(spark, sf):
    """Eight channels over one scan, each with its own order and quota; Spark keeps a channel's first rows before the shuffle."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), (F.length("text") - F.length(F.replace("text", F.lit(w), F.lit("")))).alias("n")) for c, w in CHANNELS.items()))).alias("x")
    rows = table(spark, sf, "documents").select("doc_id", each).select("doc_id", "x.*").where("n > 0")
    return Q.quotas(rows, "doc_id", "channel", [F.desc("n"), F.col("doc_id")], 20)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def X01_event_windows(spark, sf):
    from lectern.streaming.ingest import windows

    return windows(table(spark, sf, "events")).withColumn("value", F.round("value", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k""")
def X02_sessions(spark, sf):
    from lectern.streaming.ingest import sessions

    return sessions(table(spark, sf, "events"))


@query("SELECT doc_id, position('ver' IN text) - 1 AS start, substr(text, position('ver' IN text), 8) AS quote FROM documents WHERE contains(text, 'ver') AND NOT contains(substr(text, position('ver' IN text) + 1), 'ver')")
def E24_unique_quotes(spark, sf):
    at = F.instr("text", "ver")
    once = F.size(F.split("text", "ver")) == 2
    return table(spark, sf, "documents").where(once).select("doc_id", (at - 1).cast("long").alias("start"), F.substring("text", at, F.lit(8)).alias("quote"))


@query("WITH c AS (SELECT doc_id, CAST(n AS INT) AS n, n * 20 AS s, n * 20 + length(substr(text, CAST(n * 20 + 1 AS INT), 240)) AS e FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 220) / 20.0) AS INT) - 1, 0))) AS n FROM documents WHERE length(text) > 0)) SELECT a.doc_id, a.n AS a, b.n AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.n < b.n WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 0.8 * least(a.e - a.s, b.e - b.s)")
def J12_span_overlap(spark, sf):
    c = Q.windows(table(spark, sf, "documents"), ["doc_id"], "text", 240, 220).select("doc_id", "n", F.col("start").alias("s"), (F.col("start") + F.length("piece")).alias("e"))
    # spans of one text that overlap share a cell of 240 characters, or lie in neighbouring ones
    cell = F.floor(F.col("s") / 240)
    b = c.select("doc_id", F.col("n").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.explode(F.array(cell - 1, cell)).alias("cell"))
    near = c.withColumn("cell", cell).join(b, ["doc_id", "cell"]).where("n < b")
    return near.where(F.least("e", "e2") - F.greatest("s", "s2") >= 0.8 * F.least(F.col("e") - F.col("s"), F.col("e2") - F.col("s2"))).select("doc_id", F.col("n").alias("a"), "b")


@query("SELECT lang, count(*) AS n FROM documents WHERE contains(text, 'rein') GROUP BY 1")
def S10_view_scan(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("lectern_documents")
    return spark.sql("SELECT lang, count(*) AS n FROM lectern_documents WHERE contains(text, 'rein') GROUP BY lang")


@query(f"""WITH {PASSAGES}, l AS (SELECT 1 AS no, passage_id AS item, row_number() OVER (ORDER BY passage_id) AS rank FROM passages WHERE contains(text_orig, 'rein') QUALIFY rank <= 20
UNION ALL SELECT 2, passage_id, row_number() OVER (ORDER BY passage_id) AS rank FROM passages WHERE contains(text_orig, 'ung') QUALIFY rank <= 20), f AS (SELECT item, min(struct_pack(r := rank, l := no)) AS k FROM l GROUP BY 1) SELECT item, row_number() OVER (ORDER BY k, item) AS place FROM f ORDER BY k, item LIMIT 40""")
def C13_planned_channel(spark, sf):
    p = passages(spark, sf)
    lists = [D.ranked(p.where(F.col("text_orig").contains(t)).select(F.col("passage_id").alias("item")).orderBy("item").limit(20), [F.col("item")]).withColumn("list_no", F.lit(i)) for i, t in ((1, "rein"), (2, "ung"))]
    return Q.interleaved(lists[0].unionByName(lists[1]), "item", "list_no", "rank", 40)


@query("SELECT 0 AS differing")
def D10_bm25_check(spark, sf):
    """BM25 by scan against BM25 from postings, for one trigram: rows that differ by more than 1e-9."""
    p = passages(spark, sf).where("normalized_text is not null").select("passage_id", F.lower("normalized_text").alias("normalized_text"))
    scan = S.bm25(p, ["ung"]).select("passage_id", "score")
    posts = S.postings(p.where(F.col("normalized_text").contains("ung")), 3).where("gram = 'ung'")
    size = F.greatest(F.length("normalized_text") - 2, F.lit(0))
    totals = p.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total")).crossJoin(posts.agg(F.count(F.lit(1)).alias("df")))  # one row each
    both = posts.join(p, "passage_id").crossJoin(F.broadcast(totals))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(S.LEAST_IDF))
    other = -idf * F.col("tf") * (S.K1 + 1) / (F.col("tf") + S.K1 * (1 - S.B + S.B * size / (F.col("total") / F.col("n"))))
    joined = scan.join(both.select("passage_id", other.alias("other")), "passage_id", "full_outer")
    return joined.where("other is null or score is null or abs(score - other) > 1e-9").agg(F.count(F.lit(1)).cast("int").alias("differing"))


@query()
def Q15_blocks_with_metadata(spark, sf):
    meta = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("book_id"), "lang")
    found = B.over_files(_files(spark, sf), "rein", "long", opens="and")
    return found.join(meta, "file_id").select("block_id", "book_id", "lang", "row_first", "row_last", "match_count", "n_chars", "match_type")


@query()
def C08_expanded_mode(spark, sf):
    p = passages(spark, sf)
    anchors = K.grounded(p, ["xreinx"])
    lists = [D.ranked(S.hits(p, S.plan(s)).select("passage_id").orderBy("passage_id").limit(60), [F.col("passage_id")]) for s in K.searches(anchors, ["ver"])]
    return D.fuse({f"search {i}": f for i, f in enumerate(lists)}, "passage_id", 20)
