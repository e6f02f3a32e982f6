"""Evidence, parser and question operators over a corpus of annals: one short work for each row of `documents`, made of sentences whose turns follow from its id.

The tables at hand hold no marked-up or punctuated Chinese, so this view writes it. The SQL that each query is held against is derived from the ids alone,
by what a reader would say of such a sentence; it knows nothing of the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import evidence as V
from lectern.operators import frames as R
from lectern.operators import pack as K
from lectern.operators import question as N
from lectern.plans.registry import query
from lectern.plans.views import table
from lectern.sources import markup

PEOPLE, PLACES, OFFICES = ("沈光", "陸澄", "顧寧", "韓越", "柳成"), ("臨川", "平陽", "東原"), ("主簿", "太守", "侍郎")
DIGITS, YEARS = "〇一二三四五六七八九", ("元", "二", "三")
#: Turns of each line by the id modulo their number. p, q: two people; c, d: two places; o, r: two offices; y: a year.
LINES = {
    "attack": ("{p}遂攻{c}。", "{p}不攻{c}。", "{p}將攻{c}。", "聞{p}攻{c}。", "若{p}攻{c}，民散。", "「{p}攻{c}」。"),
    "death": ("{y}年秋，{q}誅{p}。", "{q}誅{p}。", "三年冬，{q}不誅{p}。", "四年春，{p}為{q}所殺。"),
    "capture": ("{p}走至{c}，為{q}所獲。", "{p}為{q}所獲。", "{p}走至{c}，{q}還，{p}被獲。", "{q}走至{c}，{p}還。"),
    "advice": ("{q}勸{p}曰：「勿戰。恐失{c}。」{p}遂還。", "{q}勸{p}曰：「戰。」{p}不還。"),
    "deed": ("{p}執{q}，殺之。", "{p}圍{c}，{q}擊之。", "{p}執{q}，命殺之。"),
    "life": ("{p}，字子{c}，邑人。拜{o}，遷{r}。{q}拜{o}。{p}乞骸骨。", "{p}，字子{c}，邑人。拜{o}，遷{r}。{q}拜{o}。{p}不拜{o}。"),
    "motive": ("{p}曰：「吾老矣，恐誤國。」{p}乃辭官。", "{p}曰：「吾老矣，恐誤國。」{p}不辭官。"),
    "year": ("{y}年春會。三月盟。明年大水。",),
}
NAMES = (*PEOPLE, *PLACES)


def _pick(words: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def _filled(form: str, parts: dict[str, Column]) -> Column:
    """The form with columns in place of its names."""
    out, rest = [], form
    while rest:
        text, mark, rest = rest.partition("{")
        out.append(F.lit(text))
        if mark:
            name, _, rest = rest.partition("}")
            out.append(parts[name])
    return F.concat(*out)


def annals(spark, sf) -> DataFrame:
    """k (the document's id), the words p, q, c, d, o, r, y, a column for each line, and work: all lines."""
    k = F.col("k")
    parts = {"p": _pick(PEOPLE, k), "q": _pick(PEOPLE, k + 1), "c": _pick(PLACES, k), "d": _pick(PLACES, k + 1), "o": _pick(OFFICES, k), "r": _pick(OFFICES, k + 1), "y": _pick(YEARS, k)}
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("k")).select("k", *(x.alias(n) for n, x in parts.items()))
    words = {n: F.col(n) for n in parts}
    turn = lambda forms: reduce(lambda a, i: F.when(k % len(forms) == i, _filled(forms[i], words)).otherwise(a), range(len(forms)), F.lit(None))
    rows = rows.select("*", *(turn(forms).alias(name) for name, forms in LINES.items()))
    return rows.withColumn("work", F.concat_ws("\n", *LINES))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


ANNALS = "a AS (SELECT doc_id AS k, " + ", ".join(f"{_list(w)}[1 + (doc_id + {n}) % {len(w)}] AS {name}" for name, w, n in (("p", PEOPLE, 0), ("q", PEOPLE, 1), ("c", PLACES, 0), ("d", PLACES, 1), ("o", OFFICES, 0), ("r", OFFICES, 1), ("y", YEARS, 0))) + " FROM documents)"


def found(rows: DataFrame, columns: list[str], f: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """k and what f finds in the columns of each row; rows stay where they lie."""
    names = ["k", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *x) for k, *own in zip(*(batch[c] for c in ["k", *columns])) for x in f(*own)]
            yield pd.DataFrame(out, columns=names)

    return rows.select(*dict.fromkeys(["k", *columns])).mapInPandas(run, f"k long, {schema}")


def add(name: str, columns: str, f: Callable[..., list[tuple]], schema: str, sql: str) -> None:
    query(f"WITH {ANNALS} {sql}", name)(lambda spark, sf: found(annals(spark, sf), columns.split(), f, schema))


def part(text: str, span) -> str | None:
    return text[slice(*span)] if span else None


def date(parts: dict | None) -> str | None:
    return "/".join(parts.values()) if parts else None


# Clauses and roles
add("E06_role_frames", "p c attack", lambda p, c, t: [(o["kind"], o["polarity"], part(t, o["object_span"])) for o in R.roles(t, (p,), (c,))], "kind string, polarity string, object string",
    "SELECT k, 'attack' AS kind, ['asserted', 'denied', 'intended', 'reported', 'supposed'][1 + k % 6] AS polarity, c AS object FROM a WHERE k % 6 < 5")
add("E07_qualifiers", "p c attack", lambda p, c, t: [(V.features(t, V.Plan((p,), ("攻",), (c,)))["qualifier"],)], "qualifier string",
    "SELECT k, ['plain', 'negated', 'plain', 'reported', 'hypothetical', 'reported'][1 + k % 6] AS qualifier FROM a")
add("E11_executions", "p q death", lambda p, q, t: [(date(o["date"]), o["quote"] == t) for o in R.executed(t, (p,), (q,))], "date string, whole boolean",
    "SELECT k, CASE k % 4 WHEN 0 THEN y || '/秋' WHEN 3 THEN '四/春' END AS date, true AS whole FROM a WHERE k % 4 <> 2")
add("E12_captures", "p capture", lambda p, t: [(part(t, o["place_span"]), part(t, o["agent_span"])) for o in R.captured(t, (p,), NAMES)], "place string, agent string",
    "SELECT k, CASE WHEN k % 4 = 0 THEN c END AS place, CASE WHEN k % 4 < 2 THEN q END AS agent FROM a WHERE k % 4 < 3")
add("E14_advice", "advice", lambda t: [(o["speaker"], o["addressee"], len(o["reason_spans"])) for o in R.advice(t, PEOPLE)], "speaker string, addressee string, reasons long",
    "SELECT k, q AS speaker, p AS addressee, CAST(1 - k % 2 AS BIGINT) AS reasons FROM a")
add("E15_advice_followed", "advice", lambda t: [(x,) for x in R.followed(t, R.advice(t, PEOPLE), PEOPLE)], "followed boolean", "SELECT k, k % 2 = 0 AS followed FROM a")
add("E16_departures", "p life", lambda p, t: [(o["event"],) for o in R.departures(t, (p,), PEOPLE)], "event string", "SELECT k, CASE k % 2 WHEN 0 THEN 'departure' ELSE 'refusal' END AS event FROM a")
add("E17_motives", "p motive", lambda p, t: [(part(t, o["reason_span"]), part(t, o["predicate_span"])) for o in R.motives(t, (p,), ("retire",), ("恐",))], "reason string, act string",
    "SELECT k, '吾老矣，恐誤國。' AS reason, '辭官' AS act FROM a WHERE k % 2 = 0")
add("E18_outcomes", "c deed", lambda c, t: [(part(t, o["subject_span"]), part(t, o["object_span"])) for o in R.outcomes(t, c, PEOPLE)], "actor string, repelled string", "SELECT k, q AS actor, p AS repelled FROM a WHERE k % 3 = 1")
add("E19_referents", "deed", lambda t: [(o["kind"], part(t, o["antecedent"])) for o in R.referents(t, PEOPLE, others=PLACES)], "kind string, antecedent string",
    "SELECT k, CASE k % 3 WHEN 0 THEN 'kill' ELSE 'repel' END AS kind, CASE k % 3 WHEN 0 THEN q ELSE p END AS antecedent FROM a WHERE k % 3 < 2")
add("E20_careers", "p life", lambda p, t: [(o["office"],) for o in R.career(t, p, OFFICES, PEOPLE)], "office string", "SELECT k, o AS office FROM a UNION ALL SELECT k, r FROM a")
add("E21_speech_turns", "motive", lambda t: [(s["speaker"], s["addressee"], s["text"]) for s in V.speeches(t)], "speaker string, addressee string, said string", "SELECT k, p AS speaker, CAST(NULL AS VARCHAR) AS addressee, '吾老矣，恐誤國。' AS said FROM a")
add("E28_biography_names", "p life", lambda p, t: [(x,) for x in R.other_names(t, p)], "name string", "SELECT k, '子' || c AS name FROM a")
add("E26_focus", "life", lambda t: [(part(t, V.focus(t, V.Plan(PEOPLE, ("拜",)))),)], "focus string", "SELECT k, q || '拜' || o || '。' AS focus FROM a")


def _answers(p: str, t: str) -> list[tuple]:
    plan, slots, kinds = V.question_plan(f"{p}何時被殺")
    dates = [o["date"] for o in R.executed(t, plan.subject, PEOPLE)]
    return [(",".join(slots), ",".join(kinds), date(dates[0]) if dates else None, "no_account" if not dates else "dated" if dates[0] else "undated")]


add("E13_execution_answers", "p death", _answers, "slots string, kinds string, date string, status string",
    "SELECT k, 'time' AS slots, 'death' AS kinds, CASE k % 4 WHEN 0 THEN y || '/秋' WHEN 3 THEN '四/春' END AS date, ['dated', 'undated', 'no_account', 'dated'][1 + k % 4] AS status FROM a")


def _status(k: int, p: str, q: str, c: str, d: str, t: str) -> list[tuple]:
    seen = [{"kind": o["kind"], "polarity": o["polarity"], "subject": part(t, o["subject_span"]), "object": part(t, o["object_span"]), "date": None, "reason": None} for o in R.roles(t, PEOPLE, PLACES)]
    wanted = [{"subject": p, "object": c}, {"subject": q}, {"subject": p, "date": True}, {"subject": p, "object": d}, {"reason": True}][k % 5]
    return [(R.adjudicated(seen, {"kind": "attack", **wanted}, pinned=k % 7 > 0),)]


add("E22_adjudication", "k p q c d attack", _status, "status string",
    "SELECT k, CASE WHEN k % 7 = 0 OR k % 6 = 5 THEN 'no_event' WHEN k % 5 > 0 THEN ['other_roles', 'undated', 'other_party', 'no_reason'][k % 5] "
    "WHEN k % 6 = 0 THEN 'supported' WHEN k % 6 = 1 THEN 'contradicted' ELSE 'no_event' END AS status FROM a")  # fmt: skip

# Dates
add("E08_annal_events", "year", lambda t: [(t[s:e], date(d)) for s, e, d in V.annals(t)], "event string, date string",
    "SELECT k, y || '年春會。' AS event, y || '/春' AS date FROM a UNION ALL SELECT k, '三月盟。', y || '/春/三月' FROM a UNION ALL SELECT k, '明年大水。', y || '/春/三月' FROM a")
add("E09_relative_time", "year", lambda t: [(r["word"], r["distance"], date(r["base"]), r["absolute_year"] is None) for i in range(len(t)) if (r := V.relative_time(t, i))], "word string, distance long, base string, open boolean",
    "SELECT k, '明年' AS word, 1 AS distance, y || '/春/三月' AS base, true AS open FROM a")
add("E10_time_and_place_slots", "p death capture", lambda p, t, u: [("time", date(d[1])) for d in [V.date_prefix(t)] if d] + [("place", part(u, o["place_span"])) for o in R.captured(u, (p,), NAMES) if o["place_span"]], "slot string, value string",
    "SELECT k, 'time' AS slot, CASE k % 4 WHEN 0 THEN y || '/秋' WHEN 2 THEN '三/冬' ELSE '四/春' END AS value FROM a WHERE k % 4 <> 1 UNION ALL SELECT k, 'place', c FROM a WHERE k % 4 = 0")

# Spans, units and contexts
add("E23_projected_spans", "attack death", lambda a, b: V.projected([(1, 0, len(a)), (2, 0, len(b))], len(a) - 2, len(a) + 3), "block long, start long, stop long",
    "SELECT k, 1 AS block, n - 2 AS start, n AS stop FROM (SELECT k, [7, 7, 7, 7, 10, 8][1 + k % 6] AS n FROM a) UNION ALL SELECT k, 2, 0, 3 FROM a")
add("E24_sentences_in_context", "p advice", lambda p, t: [(i, t[s:e]) for i, (s, e) in enumerate(V.units(t), 1)] + [(0, part(t, V.assembled(t, len(t) - 2, len(t), 8)))], "place long, sentence string",
    "SELECT k, 1 AS place, q || '勸' || p || CASE k % 2 WHEN 0 THEN '曰：「勿戰。恐失' || c || '。」' ELSE '曰：「戰。」' END AS sentence FROM a UNION ALL SELECT k, 2, p || CASE k % 2 WHEN 0 THEN '遂還。' ELSE '不還。' END FROM a "
    "UNION ALL SELECT k, 0, p || CASE k % 2 WHEN 0 THEN '遂還。' ELSE '不還。' END FROM a")  # fmt: skip

# Questions
ASKED = ("何時去世", "為何被殺", "在哪裡出生", "何時即位", "是何官", "遷往何地", "為何攻打{c}", "多少卷", "何時辭官", "為何被貶")
WANTED = ("time|death", "reason|death", "place|birth", "time|accession", "office|", "place|movement", "reason|military", "quantity|", "time|resignation", "reason|demotion")


def _plan(k: int, p: str, c: str) -> list[tuple]:
    plan, slots, kinds = V.question_plan(p + ASKED[k % 10].format(c=c))
    return [(",".join(plan.subject), ",".join(slots) + "|" + ",".join(kinds), ",".join(plan.clues))]


add("E01_question_plans", "k p c", _plan, "subject string, plan string, clues string", f"SELECT k, p AS subject, {_list(WANTED)}[1 + k % 10] AS plan, CASE WHEN k % 10 = 6 THEN c ELSE '' END AS clues FROM a")
add("E02_relation_classes", "k p", lambda k, p: [(kind, len(V.question_plan(p + V.RELATIONS[kind][0][0])[0].relation) > 0) for kind in [sorted(V.RELATIONS)[k % len(V.RELATIONS)]] if kind in V.question_plan(p + V.RELATIONS[kind][0][0])[2]], "kind string, told boolean",
    f"SELECT k, {_list(sorted(V.RELATIONS))}[1 + k % {len(V.RELATIONS)}] AS kind, true AS told FROM a")
add("N10_topics", "p c", lambda p, c: [(x,) for x in K.topics(f"{p}攻{c}之戰誰勝了", "之誰了的")], "topic string", "SELECT k, unnest([p || '攻' || left(c, 1), right(c, 1), '戰', '勝']) AS topic FROM a WHERE false UNION ALL SELECT k, unnest([p || '攻' || left(c, 1)]) FROM a UNION ALL SELECT k, unnest(['戰', '勝']) FROM a")
query(f"WITH {ANNALS} SELECT k, true AS sound FROM a WHERE k % 6 = 0 ORDER BY k LIMIT 50", "E05_feature_order")(
    lambda spark, sf: V.evidence_order(V.audited(annals(spark, sf).select("k", "attack"), V.Plan(PEOPLE, ("攻",), PLACES[:1]), "k", "attack").where("status = 'clues_present'"), "k").limit(50).select("k", (F.col("gap") == 1).alias("sound"))
)

# Files
BOOK = "#+TITLE: 小史\n# src: 小史 卷一\n* {p}\n<pb:XS_TLS_{o}-1a>¶\n{attack}¶\n{p}({c})至¶\n# 一\n# 二\n* {q}\n{death}\n#+PART: appendix\n附錄　{d}¶"


def books(spark, sf) -> DataFrame:
    names = ["p", "q", "c", "d", "o", "attack", "death"]
    return annals(spark, sf).select(F.col("k").alias("file_id"), _filled(BOOK, {n: F.col(n) for n in names}).alias("text"))


@query("SELECT layer, kind, n * m AS n FROM (VALUES ('appendix', 'part', 1), ('appendix', 'passage', 1), ('commentary_candidate', 'passage', 1), ('main', 'comment', 2), ('main', 'heading', 2), ('main', 'page', 1), ('main', 'part', 1), ('main', 'passage', 4)) t(layer, kind, n), (SELECT count(*) AS m FROM documents)")
def P05_record_kinds(spark, sf):
    return markup.parse(books(spark, sf)).groupBy("layer", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ANNALS} SELECT k AS file_id, p AS label, 3 AS first_row, 8 AS last_row FROM a UNION ALL SELECT k, q, 9, 12 FROM a")
def S07_rebuilt_sections(spark, sf):
    from lectern.operators.sequence import closed
    from lectern.sources import storage

    path = storage.shared_dir(spark)
    storage.write_jsonl(markup.parse(books(spark, sf)).withColumn("book_id", F.lit("小史")), path)
    records = storage.read_jsonl(spark, path, markup.RECORD + ", book_id string")
    marks = records.where("kind = 'heading'").select("file_id", F.col("section").alias("label"), F.col("row_no").alias("first_row"))
    return closed(marks, records.select("file_id", "row_no"), "file_id", "first_row", "row_no").select("file_id", "label", "first_row", "last_row")


add("P06_declared_titles", "p c d", lambda p, c, d: markup.declared_titles(f"{c}策\n{p}\n{d}策\n\n{d}策\n<pb:x>¶\n{c}策".split("\n"), [f"{c}策", f"{d}策"]), "row_no long, title string",
    "SELECT k, 1 AS row_no, c || '策' AS title FROM a UNION ALL SELECT k, 5, d || '策' FROM a")


def numeral(n: int) -> str:
    """A number below 10,000 in Chinese numerals."""
    out, gap = "", False
    for unit, size in (("千", 1000), ("百", 100), ("十", 10), ("", 1)):
        d, n = divmod(n, size)
        if d:
            out += ("零" if gap and out else "") + ("" if unit == "十" and d == 1 and not out else DIGITS[d]) + unit
        gap = d == 0
    return out or DIGITS[0]


add("P07_volume_titles", "k", lambda k: [v for v in [markup.volume_title(f"{'小' if k % 4 else '他'}史　卷第{numeral(k % 1000)}{('', '上', '下')[k % 3]}¶", "小史")] if v], "volume long, part string",
    "SELECT k, k % 1000 AS volume, CASE k % 3 WHEN 1 THEN '上' WHEN 2 THEN '下' END AS part FROM a WHERE k % 4 > 0")
@query(f"WITH {ANNALS} SELECT k, k % 10000 AS number, k % 10000 AS again FROM a")
def P20_chinese_numbers(spark, sf):
    labels = found(annals(spark, sf), ["k"], lambda k: [(numeral(k % 10_000), markup.number(numeral(k % 10_000)))], "label string, again long")
    return labels.select("k", T.chinese_number("label").cast("long").alias("number"), "again")


add("P09_bracket_pieces", "k p c q", lambda k, p, c, q: [(t[s:e], b) for t in [(f"{p}({c}){q}", f"{p}({c})¶", f"{p}({c}", f"（{p}）{q}")[k % 4]] for s, e, b in markup.brackets(t)], "piece string, note boolean",
    "SELECT k, p AS piece, false AS note FROM a WHERE k % 4 < 2 UNION ALL SELECT k, CASE k % 4 WHEN 0 THEN '(' || c || ')' WHEN 1 THEN '(' || c || ')¶' ELSE '（' || p || '）' END, true FROM a WHERE k % 4 <> 2 "
    "UNION ALL SELECT k, q, false FROM a WHERE k % 4 IN (0, 3) UNION ALL SELECT k, p || '(' || c, false FROM a WHERE k % 4 = 2")  # fmt: skip


# Years
add("N06_years", "y c", lambda y, c: [(x,) for x in N.years(f"{c}王{y}年會，前二百年無之，公元前206年至西元1999")], "year string",
    "SELECT k, c || '王' || y || '年' AS year FROM a UNION ALL SELECT k, unnest(['二百年', '公元前206年', '1999']) FROM a")
