"""Questions, ranking, events, evidence and audits on the tables at hand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import audit as A
from lectern.operators import evidence as V
from lectern.operators import question as N
from lectern.plans.registry import query
from lectern.plans.views import PASSAGES, SECTIONS, passages, sections, table

WORDS = N.Vocabulary(
    entities=(N.Entity("rein", ("rein",), ("ung",), ("au",)), N.Entity("ndtion", ("ndtion",), ("lly",), ("of",))),
    asks={"change": ("how did",), "time": ("when",)},
    strong={"change": ("ver", "tion")},
    mild={"change": ("was", "is"), "time": ("year",)},
    stop=frozenset({"the", "and"}),
)
QUESTION = "how did rein and shth"


def _question():
    return N.analyze(QUESTION, WORDS)


C = "contains(t, '{}')"
SCORE = f"""WITH {PASSAGES}, x AS (SELECT passage_id, file_id, row_no, book_id, text_orig AS t, contains(text_orig, 'rein')::INT AS ex, contains(text_orig, 'ung') AS al,
 contains(text_orig, 'au') AS we, contains(text_orig, 'ver')::INT + contains(text_orig, 'tion')::INT AS ns, contains(text_orig, 'was')::INT + contains(text_orig, 'is')::INT AS nm, contains(text_orig, 'shth') AS tp FROM passages),
y AS (SELECT *, CASE WHEN ex > 0 THEN 14.0 ELSE 0 END AS e, CASE WHEN ex = 0 AND al THEN 6.0 ELSE 0 END AS a, CASE WHEN ex = 0 AND NOT al AND we THEN 2.0 ELSE 0 END AS w,
 CASE WHEN ns > 0 THEN least(14.0, 8 + 2 * (ns - 1)) ELSE 0 END AS s, least(4.5, 1.5 * nm) AS m, CASE WHEN tp THEN 5.0 ELSE 0 END AS p FROM x),
z AS (SELECT *, CASE WHEN ns > 0 AND (e > 0 OR a > 0) THEN 15.0 WHEN ns > 0 AND w > 0 THEN 6 WHEN e > 0 OR a > 0 OR w > 0 THEN 3 ELSE 0 END AS c FROM y)"""


@query(f"{SCORE} SELECT passage_id, CAST(round(e + a + w + s + m + p + c, 2) AS DOUBLE) AS score FROM z")
def N12_score(spark, sf):
    return N.scored(passages(spark, sf), _question()).select("passage_id", "score")


@query(f"{SCORE} SELECT passage_id, CAST(round(e + a + w + s + m + p + c, 2) AS DOUBLE) AS score FROM z ORDER BY score DESC, book_id, file_id, row_no LIMIT 40")
def N13_rank(spark, sf):
    return N.scored(passages(spark, sf), _question()).orderBy(F.desc("score"), "book_id", "file_id", "row_no").limit(40).select("passage_id", "score")


def _turns(spark, sf, f, schema):
    """What f finds in each turn of a conversation, read as a question."""
    names = ["conv_id", "turn", *(x.split()[0] for x in schema.split(", "))]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(c, t, *x) for c, t, text in zip(batch["conv_id"], batch["turn"], batch["text"]) for x in f(N.analyze(text, TALK))], columns=names)

    return table(spark, sf, "conversations").select("conv_id", "turn", "text").mapInPandas(run, f"conv_id long, turn long, {schema}")


TALK = N.Vocabulary(
    entities=(N.Entity("rein", ("rein",), ("ung",), ("au",)), N.Entity("ndtion", ("ndtion",), ("lly",), ("of",))), asks={"change": ("what", "is"), "time": ("when", "the")},
    strong={"change": ("ver", "tion"), "time": ("year",)}, mild={"change": ("was", "is"), "time": ("year",)},
)
ASKED = """q AS (SELECT conv_id, turn, contains(text, 'rein') OR contains(text, 'ung') AS a, contains(text, 'ndtion') OR contains(text, 'lly') AS b, contains(text, 'what') OR contains(text, 'is') AS c,
contains(text, 'when') OR contains(text, 'the') AS d FROM conversations), x AS (SELECT conv_id, turn, unnest(list_concat(CASE WHEN a THEN ['entity:rein', 'alias:ung', 'weak:au'] ELSE [] END, CASE WHEN b THEN ['entity:ndtion', 'alias:lly', 'weak:of'] ELSE [] END,
CASE WHEN c THEN ['intent:ver', 'intent:tion', 'intent_weak:was', 'intent_weak:is'] ELSE [] END, CASE WHEN d THEN ['intent:year', 'intent_weak:year'] ELSE [] END)) AS pair FROM q)"""


def _groups(q: N.Question) -> list[tuple[str, str]]:
    """A question's terms by role, without its topics."""
    rows = [(role, f) for e in q.entities for role, forms in (("entity", e.canonical), ("alias", e.alias), ("weak", e.weak)) for f in forms]
    return rows + [("intent", t) for t in q.strong] + [("intent_weak", t) for t in q.mild]


@query(f"WITH {ASKED} SELECT conv_id, turn, concat_ws(',', CASE WHEN a THEN 'rein' END, CASE WHEN b THEN 'ndtion' END) AS entities, concat_ws(',', CASE WHEN c THEN 'change' END, CASE WHEN d THEN 'time' END) AS intents FROM q")
def N01_analyze(spark, sf):
    return _turns(spark, sf, lambda q: [(",".join(e.name for e in TALK.entities if e in q.entities), ",".join(q.intents))], "entities string, intents string")


@query(f"WITH {ASKED} SELECT conv_id, turn, split_part(pair, ':', 1) AS role, split_part(pair, ':', 2) AS term FROM x")
def N08_expansion(spark, sf):
    return _turns(spark, sf, _groups, "role string, term string")


@query(f"WITH {ASKED} SELECT DISTINCT conv_id, turn, split_part(pair, ':', 2) AS term FROM x WHERE NOT starts_with(pair, 'intent_weak')")
def N07_flat_expansion(spark, sf):
    return _turns(spark, sf, lambda q: [(t,) for t in dict.fromkeys(t for role, t in _groups(q) if role != "intent_weak")], "term string")


@query("SELECT doc_id, form, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'ndtion|rein|ung')) AS form FROM documents) GROUP BY 1, 2")
def N03_entity_mentions(spark, sf):
    found = F.explode(F.regexp_extract_all("text", F.lit("(ndtion|rein|ung)"), F.lit(1))).alias("form")
    return table(spark, sf, "documents").select("doc_id", found).groupBy("doc_id", "form").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PASSAGES} SELECT passage_id FROM passages WHERE CASE WHEN (SELECT count(*) FROM passages WHERE contains(text_orig, 'rein')) > 0 THEN contains(text_orig, 'rein') ELSE contains(text_orig, 'shth') END")
def N11_two_pools(spark, sf):
    return N.pools(passages(spark, sf), F.col("text_orig").contains("rein"), F.col("text_orig").contains("shth")).select("passage_id")


NAMES = "n AS (SELECT name, substr(name, 2) AS short, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{1,3}tion')) AS name FROM documents) GROUP BY 1, 2)"


@query(f"WITH {NAMES} SELECT * FROM n")
def A09_names_in_corpus(spark, sf):
    return N.names_in_corpus(table(spark, sf, "documents"), "text", "[A-Z][a-z]{1,3}tion")


@query(f"""WITH {NAMES}, t AS (SELECT short, count(*) AS total FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{{1,3}}tion')) AS short FROM documents) GROUP BY 1),
s AS (SELECT n.short, count(*) AS candidates, sum(n) AS ex FROM n GROUP BY 1) SELECT short, candidates, total - ex AS bare, candidates = 1 AS "unique" FROM s JOIN t USING (short) WHERE total - ex >= 3""")
def A10_short_forms(spark, sf):
    d = table(spark, sf, "documents")
    bare = d.select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{1,3}tion)"), F.lit(1))).alias("short")).groupBy("short").agg(F.count(F.lit(1)).alias("total"))
    return N.short_forms(N.names_in_corpus(d, "text", "[A-Z][a-z]{1,3}tion"), bare)


BLOCKS = f"{PASSAGES}, b AS (SELECT book_id, file_id, row_no // 10 AS section, row_no, length(text_orig) AS score, row_number() OVER (PARTITION BY book_id ORDER BY length(text_orig) DESC, passage_id) AS rank FROM passages WHERE contains(text_orig, 'rein'))"


def _blocks(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("book_id").orderBy(F.desc(F.length("text_orig")), "passage_id")
    p = passages(spark, sf).where(F.col("text_orig").contains("rein"))
    return p.select("book_id", "file_id", F.floor(F.col("row_no") / 10).alias("section"), F.length("text_orig").alias("score"), F.row_number().over(w).alias("rank"), F.lit(1).alias("match_count"))


@query(f"WITH {BLOCKS} SELECT book_id, file_id, section, max(score) AS relevance, min(rank) AS best_rank, count(*) AS match_count, count(*) AS n_blocks FROM b GROUP BY 1, 2, 3")
def A18_events(spark, sf):
    return N.events(_blocks(spark, sf), ["file_id", "section"], "book_id")


@query(f"WITH {BLOCKS}, e AS (SELECT book_id, file_id, section, max(score) AS relevance FROM b GROUP BY 1, 2, 3) SELECT book_id, count(*) AS n_events, max(relevance) AS best FROM e GROUP BY 1")
def A19_sources(spark, sf):
    return N.by_source(N.events(_blocks(spark, sf), ["file_id", "section"], "book_id"), "book_id")


@query(f"WITH {BLOCKS}, e AS (SELECT book_id, file_id, section, max(score) AS relevance, min(rank) AS best_rank, count(*) AS match_count FROM b GROUP BY 1, 2, 3) SELECT book_id, file_id, section FROM e ORDER BY relevance DESC, best_rank, match_count DESC, book_id, file_id, section LIMIT 40")
def O04_event_order(spark, sf):
    e = N.events(_blocks(spark, sf), ["file_id", "section"], "book_id")
    return e.orderBy(F.desc("relevance"), "best_rank", F.desc("match_count"), "book_id", "file_id", "section").limit(40).select("book_id", "file_id", "section")


@query("""WITH s AS (SELECT count(*) FILTER (WHERE lang = 'de') AS rows_in_scope, count(*) FILTER (WHERE lang = 'de' AND contains(lower(text), 'éau')) AS hits, count(*) FILTER (WHERE lang = 'de' AND contains(text, 'éau')) AS raw_hits, count(*) FILTER (WHERE contains(text, 'éau')) AS anywhere FROM documents)
SELECT 'éau' AS term, *, CASE WHEN hits > 0 THEN 'hit' WHEN rows_in_scope = 0 THEN 'coverage' WHEN raw_hits > 0 THEN 'normalization' WHEN anywhere > 0 THEN 'scope' ELSE 'absent' END AS reason FROM s""")
def D01_explain_empty(spark, sf):
    d = table(spark, sf, "documents").withColumn("low", F.lower("text"))
    return A.explain_empty(d, "éau", F.col("lang") == "de", "text", "low")


@query("""WITH k AS (SELECT source, count(*) AS expected, count(l.doc_id) AS imported FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1), h AS (SELECT source, count(*) AS n FROM documents WHERE contains(text, 'Ndtion') GROUP BY 1)
SELECT source, coalesce(n, 0) AS n_hits, CASE WHEN coalesce(n, 0) > 0 THEN 'hit' WHEN imported = 0 THEN 'not_imported' WHEN imported < expected THEN 'partial_no_hit' ELSE 'complete_no_hit' END AS status FROM k LEFT JOIN h USING (source)""")
def D02_scope_status(spark, sf):
    d = table(spark, sf, "documents")
    known = d.select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("expected"), F.count("l").alias("imported"))
    return A.scope_status(d.where(F.col("text").contains("Ndtion")).select("source"), known, "source")


@query(f"""WITH {SECTIONS}, f AS (SELECT file_id, min(first_row) AS fr FROM sections GROUP BY 1), c AS (SELECT book_id, count(*) AS body_rows, count(*) FILTER (WHERE fr IS NULL OR row_no < fr) AS uncovered_rows FROM passages LEFT JOIN f USING (file_id) GROUP BY 1)
SELECT *, CASE WHEN 1 - uncovered_rows / body_rows >= 0.9 THEN 'OK' WHEN uncovered_rows < body_rows THEN 'WARN' ELSE 'FAIL' END AS status FROM c""")
def D03_section_coverage(spark, sf):
    return A.coverage(passages(spark, sf), sections(spark, sf), "book_id", "file_id", "row_no", "first_row")


@query(f"""WITH {SECTIONS}, s AS (SELECT file_id, first_row, first_row + 2 AS last_row FROM sections) SELECT file_id, last_row AS after, nxt AS before FROM (SELECT *, lead(first_row) OVER (PARTITION BY file_id ORDER BY first_row) AS nxt FROM s) WHERE nxt > last_row + 1""")
def D04_interval_gaps(spark, sf):
    return A.interval_gaps(sections(spark, sf).withColumn("last_row", F.col("first_row") + 2), "file_id", "first_row", "last_row")


@query("""WITH m AS (SELECT source, count(DISTINCT doc_id % 40) AS n, max(doc_id % 40) - min(doc_id % 40) + 1 - count(DISTINCT doc_id % 40) AS gaps, count(*) - count(DISTINCT doc_id % 40) AS split FROM documents GROUP BY 1)
SELECT *, concat_ws(',', CASE WHEN n < 35 THEN 'missing' END, CASE WHEN n > 35 THEN 'surplus' END, CASE WHEN gaps > 0 THEN 'gap' END, CASE WHEN split > 0 THEN 'split' END) AS problems, CASE WHEN n < 35 THEN 'FAIL' WHEN n > 35 OR gaps > 0 OR split > 0 THEN 'WARN' ELSE 'OK' END AS level FROM m""")
def D05_volume_audit(spark, sf):
    num = F.col("doc_id") % 40
    m = table(spark, sf, "documents").groupBy("source").agg(F.countDistinct(num).alias("n"), (F.max(num) - F.min(num) + 1 - F.countDistinct(num)).alias("gaps"), (F.count(F.lit(1)) - F.countDistinct(num)).alias("split"))
    return A.volume_audit(m, F.lit(35))


@query("SELECT source, count(*) AS files, count(DISTINCT lang) AS editions, round(count(*) FILTER (WHERE lang = 'en') / count(*), 4) AS aligned FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def D07_source_check(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("lang").alias("editions"), F.round(F.count_if(F.col("lang") == "en") / F.count(F.lit(1)), 4).alias("aligned"))
    return d.where("editions > 1")


@query("SELECT 0 AS broken_files")
def D08_conservation(spark, sf):
    from lectern.sources.markup import conserved, parse

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return conserved(parse(d), d).agg(F.count(F.lit(1)).cast("int").alias("broken_files"))


@query("WITH f AS (SELECT source, min(substr(text, 1, 8)) AS frag FROM documents GROUP BY 1) SELECT f.source, count(*) > 0 AS found FROM f JOIN documents d ON d.source = f.source AND contains(d.text, f.frag) GROUP BY 1")
def D09_self_probe(spark, sf):
    d = table(spark, sf, "documents")
    frag = d.groupBy("source").agg(F.min(F.substring("text", 1, 8)).alias("frag"))
    return d.join(frag, "source").groupBy("source").agg((F.count_if(F.col("text").contains(F.col("frag"))) > 0).alias("found"))


@query()
def P01_parse_records(spark, sf):
    from lectern.sources.markup import parse

    return parse(table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text"))


@query("SELECT item_id, doc_id, contains(d.text, b.text) AS verbatim FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")
def N17_verbatim_quotes(spark, sf):
    answers = table(spark, sf, "benchmark").select("item_id", F.col("item_id").alias("doc_id"), F.col("text").alias("quote"))
    return V.verbatim(answers, table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "quote", "text").select("item_id", "doc_id", "verbatim")


PLAN = V.Plan(("rein", "ung"), ("ver", "tion"), ("au",), negations=("un", "not"), reports=("lich",), conditions=("wenn",))


@query("SELECT doc_id, CAST((SELECT count(*) FROM documents WHERE regexp_matches(text, 'rein|ung')) > 300 AS BOOLEAN) AS truncated FROM documents WHERE regexp_matches(text, 'rein|ung') ORDER BY doc_id LIMIT 300")
def E03_subject_pool(spark, sf):
    return V.subject_pool(table(spark, sf, "documents"), PLAN, "doc_id", "text", 300).select("doc_id", "truncated")


@query()
def E25_evidence_audit(spark, sf):
    pool = V.subject_pool(table(spark, sf, "documents"), PLAN, "doc_id", "text")
    return V.audited(pool, PLAN, "doc_id", "text")


@query()
def E29_evidence_order(spark, sf):
    pool = V.subject_pool(table(spark, sf, "documents"), PLAN, "doc_id", "text")
    return V.evidence_order(V.audited(pool, PLAN, "doc_id", "text"), "doc_id").limit(20)


@query("""WITH u AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[。！？!?.\\n]')) AS s FROM documents WHERE regexp_matches(text, 'rein|ung')),
m AS (SELECT doc_id, s, i + length(f) AS e FROM (SELECT doc_id, s, f, unnest(generate_series(1, length(s) - length(f) + 1)) AS i FROM u, (VALUES ('rein'), ('ung')) v(f) WHERE contains(s, f)) WHERE substr(s, CAST(i AS INT), length(f)) = f),
g AS (SELECT doc_id, least(nullif(position('ver' IN w), 0), nullif(position('tion' IN w), 0)) - 1 AS gap FROM (SELECT doc_id, substr(s, CAST(e AS INT), 24) AS w FROM m))
SELECT d.doc_id, min(gap) AS gap, contains(any_value(text), 'au') AS clue FROM documents d LEFT JOIN g USING (doc_id) WHERE regexp_matches(text, 'rein|ung') GROUP BY 1""")
def E04_relation_gaps(spark, sf):
    found = V.audited(V.subject_pool(table(spark, sf, "documents"), PLAN, "doc_id", "text"), PLAN, "doc_id", "text")
    return found.select("doc_id", F.col("gap").cast("long").alias("gap"), (F.size("clues") > 0).alias("clue"))
