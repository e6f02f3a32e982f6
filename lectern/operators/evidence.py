"""Evidence in punctuated text: quotations, units, clues and their qualifications, and audits that quote the source verbatim.

Every rule works on one candidate with its offsets in the unchanged text, refuses rather than guesses, and never says that a
relation is true: relation_verified is false in all that is returned. Vocabularies are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed pairs of quotation marks and the ends of sentences.
PAIRS = {"「": "」", "『": "』", "“": "”", "‘": "’"}
STOPS = "。！？!?."
NEAR = 24


def quotes(text: str) -> list[tuple[int, int, int]] | None:
    """Quotations as (start, end, depth), marks included, outer ones first; None if the marks are not balanced."""
    closing, stack, out = {v: k for k, v in PAIRS.items()}, [], []
    for i, c in enumerate(text):
        if c in PAIRS:
            stack.append((i, c))
        elif c in closing:
            if not stack or stack[-1][1] != closing[c]:
                return None
            out.append((stack.pop()[0], i + 1, len(stack)))
    return None if stack else sorted(out)


def masked(text: str) -> str:
    """The text with quotations blanked, so that offsets stay; unbalanced text is left as it is."""
    found = quotes(text)
    out = list(text)
    for s, e, depth in found or []:
        if depth == 0:
            out[s:e] = " " * (e - s)
    return "".join(out)


def units(text: str) -> list[tuple[int, int]]:
    """Sentences: they end after a stop outside quotations, with what closes right behind it, and at line breaks."""
    inside = [False] * len(text)
    for s, e, depth in quotes(text) or []:
        if depth == 0:
            inside[s : e - 1] = [True] * (e - 1 - s)
    out, start = [], 0
    for i, c in enumerate(text):
        ends_quote = c in PAIRS.values() and not inside[i] and i and text[i - 1] in STOPS
        if c == "\n" or (c in STOPS and not inside[i]) or ends_quote:
            if text[start : i + 1].strip():
                out.append((start, i + 1))
            start = i + 1
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def locate(text: str, quote: str) -> tuple[int, int] | None:
    """Where a quotation stands, if it stands there exactly once."""
    at = text.find(quote) if quote else -1
    return (at, at + len(quote)) if at >= 0 and text.find(quote, at + 1) < 0 else None


@dataclass(frozen=True)
class Plan:
    """What is looked for: forms of the subject, words of the relation, clues, and words that qualify a clause."""

    subject: tuple[str, ...]
    relation: tuple[str, ...]
    clues: tuple[str, ...] = ()
    negations: tuple[str, ...] = ("不", "未", "無", "弗", "not", "never")
    reports: tuple[str, ...] = ("聞", "或曰", "傳言", "said that", "it is said")
    conditions: tuple[str, ...] = ("若", "如", "使", "if", "should")


def qualifier(text: str, start: int, end: int, plan: Plan) -> str:
    """How the clause around a span is meant: negated, hypothetical, reported, or plain."""
    lo = max((text.rfind(c, 0, start) for c in STOPS + "，,；;"), default=-1) + 1
    before = text[lo:start]
    if any(w in text[max(lo, start - 3) : start] for w in plan.negations):
        return "negated"
    if any(w in before for w in plan.conditions):
        return "hypothetical"
    if any(w in before for w in plan.reports) or any(s <= start and end <= e for s, e, _ in quotes(text) or []):
        return "reported"
    return "plain"


def features(text: str, plan: Plan) -> dict:
    """Clues that are there, and the relation's word next to the subject in one sentence, with its span and qualification."""
    best = None
    for s, e in units(text):
        for subject in plan.subject:
            for m in re.finditer(re.escape(subject), text[s:e]):
                for relation in plan.relation:
                    at = text.find(relation, s + m.end(), min(e, s + m.end() + NEAR))
                    if at >= 0:
                        found = (at - s - m.end(), s, e, at, at + len(relation))
                        best = min(best, found) if best else found
    present = [c for c in plan.clues if c in text]
    out = {"clues": present, "all_clues": len(present) == len(plan.clues), "gap": None, "start": None, "end": None, "qualifier": None}
    if best:
        out |= {"gap": best[0], "start": best[1], "end": best[2], "qualifier": qualifier(text, best[3], best[4], plan)}
    return out


def audit(text: str, plan: Plan) -> tuple[str, list[str], dict]:
    """clues_present or insufficient, and what is missing."""
    f = features(text, plan)
    missing = [c for c in plan.clues if c not in f["clues"]]
    if f["gap"] is None:
        missing.append("relation")
    elif f["qualifier"] != "plain":
        missing.append("plain statement")
    return ("insufficient" if missing else "clues_present"), missing, f


AUDIT = "status string, missing array<string>, clues array<string>, gap int, start int, end int, qualifier string, quote string, relation_verified boolean"


def audited(candidates: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """Every candidate with its audit and the sentence that it rests on, verbatim."""
    kind = candidates.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                status, missing, f = audit(t or "", plan)
                quote = t[f["start"] : f["end"]] if f["start"] is not None else None
                rows.append((k, status, missing, f["clues"], f["gap"], f["start"], f["end"], f["qualifier"], quote, False))
            out = pd.DataFrame(rows, columns=["key", *(c.split()[0] for c in AUDIT.split(", "))])
            yield out.astype({c: "Int64" for c in ("gap", "start", "end")})

    return candidates.select(key, text).mapInPandas(run, f"key {kind}, {AUDIT}").withColumnRenamed("key", key)


def subject_pool(rows: DataFrame, plan: Plan, key: str, text: str, budget: int | None = None) -> DataFrame:
    """Candidates that name the subject, all of them; with a budget the first ones by key, and a flag (truncated) that says whether there were more."""
    from lectern.operators.relational import capped

    named = rows.where(F.col(text).rlike("|".join(f"\\Q{s}\\E" for s in plan.subject))).select(key, text)
    return capped(named, [key], budget) if budget else named


def evidence_order(rows: DataFrame, key: str) -> DataFrame:
    """Sound candidates first, then plain statements, more clues, a shorter gap, and source order."""
    return rows.orderBy((F.col("status") != "clues_present"), (F.coalesce("qualifier", F.lit("")) != "plain"), F.desc(F.size("clues")), F.asc_nulls_last("gap"), key)


def verbatim(answers: DataFrame, sources: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """Answers with whether their quotation stands in the named source, character for character."""
    joined = answers.join(sources.select(key, F.col(text).alias("_t")), key, "left")
    return joined.withColumn("verbatim", F.coalesce(F.col("_t").contains(F.col(quote)), F.lit(False))).drop("_t")


#: Fixed parts of regnal dates: an era year, season, month and day, in that order and each may be missing.
DATE = re.compile(r"(?:(?P<era>[一-鿿]{1,4}公|[一-鿿]{2})?(?P<year>元|[一二三四五六七八九十百]+)年)?(?P<season>[春夏秋冬])?[，,]?(?P<month>(?:王?正|閏?[一二三四五六七八九十]+)月)?(?P<day>[甲乙丙丁戊己庚辛壬癸][子丑寅卯辰巳午未申酉戌亥])?")


def date_prefix(text: str) -> tuple[int, dict] | None:
    """The date that a sentence begins with: its length and its parts; None without one. Years are never converted."""
    m = DATE.match(text)
    parts = {k: v for k, v in (m.groupdict() if m else {}).items() if v}
    return (m.end(), parts) if parts else None


def annals(text: str) -> list[tuple[int, int, dict]]:
    """Sentences as events (start, end, date). A part of the date that is not given goes on from the event before, but nothing finer than what is given."""
    order, held, out = ("era", "year", "season", "month", "day"), {}, []
    for s, e in units(text):
        found = date_prefix(text[s:e].lstrip("，,　 "))
        if found:
            first = min(order.index(k) for k in found[1])
            held = {k: v for k, v in held.items() if order.index(k) < first} | found[1]
        out.append((s, e, dict(held)))
    return out


#: Words that name a time by another one: fixed, with the distance in units where it is certain.
RELATIVE = {"明年": ("year", 1), "是歲": ("year", 0), "是年": ("year", 0), "明日": ("day", 1), "是月": ("month", 0)}


def relative_time(text: str, at: int) -> dict | None:
    """The relative time that begins at `at`, with the date it counts from: the nearest one before it in the same paragraph. The absolute year stays unknown."""
    word = next((w for w in RELATIVE if text.startswith(w, at)), None)
    if word is None:
        return None
    start = text.rfind("\n", 0, at) + 1
    base = [(s, d) for s, e, d in annals(text[start:at]) if d]
    unit, distance = RELATIVE[word]
    return {"word": word, "unit": unit, "distance": distance, "base": base[-1][1] if base else None, "absolute_year": None}


SPEECH = re.compile(r"(?P<speaker>[一-鿿]{1,4}?)(?:(?:謂|告|語|問|言於|對)(?P<addressee>[一-鿿]{1,4}?))?曰[：:]?(?=[「“])")


def speeches(text: str) -> list[dict]:
    """Quoted turns with speaker and addressee as they are named right before the quotation; unbalanced text has none."""
    found = quotes(text)
    out = []
    for s, e, depth in found or []:
        if depth:
            continue
        lo = max((text.rfind(c, 0, s) for c in STOPS + "，,；;\n」”"), default=-1) + 1
        m = next((m for m in SPEECH.finditer(text, lo, s + 1) if m.end() == s), None)
        out.append({"start": s, "end": e, "speaker": m["speaker"] if m else None, "addressee": m["addressee"] if m else None, "text": text[s + 1 : e - 1]})
    return out


def focus(text: str, plan: Plan) -> tuple[int, int] | None:
    """The sentence with the subject that has most clues and words of the relation; the earliest on ties."""
    best = None
    for s, e in units(text):
        part = text[s:e]
        if any(x in part for x in plan.subject):
            n = sum(x in part for x in (*plan.relation, *plan.clues))
            best = max(best, (n, -s, e)) if best else (n, -s, e)
    return (-best[1], best[2]) if best else None


def assembled(text: str, start: int, end: int, most: int = 3200) -> tuple[int, int]:
    """Whole sentences around a span, growing on both sides in turn while they fit; the span's own sentences always stay."""
    own = units(text)
    inside = [i for i, (s, e) in enumerate(own) if s < end and e > start]
    if not inside:
        return start, end
    lo, hi = inside[0], inside[-1]
    grown = True
    while grown:
        grown = False
        if hi + 1 < len(own) and own[hi + 1][1] - own[lo][0] <= most:
            hi, grown = hi + 1, True
        if lo > 0 and own[hi][1] - own[lo - 1][0] <= most:
            lo, grown = lo - 1, True
    return own[lo][0], own[hi][1]


def projected(parts: list[tuple[int, int, int]], start: int, end: int) -> list[tuple[int, int, int]]:
    """A chunk's span in the blocks that it was made of; parts: (block, start, end) in order. Raises if the span is not covered."""
    out, at = [], 0
    for block, s, e in parts:
        lo, hi = max(start, at), min(end, at + e - s)
        if lo < hi:
            out.append((block, s + lo - at, s + hi - at))
        at += e - s
    if sum(e - s for _, s, e in out) != end - start:
        raise ValueError("the span is not in the chunk's parts")
    return out


def sound(text: str, span: tuple[int, int], quote: str, digest: str) -> bool:
    """Whether a pinned source still has the digest and the quotation at its place."""
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest() == digest and text[slice(*span)] == quote


def grounded_prefix(rows: DataFrame, words: str, text: str) -> tuple[str, str]:
    """The longest beginning of a text of two characters and more that some row contains, and the rest. One scan for all beginnings."""
    heads = [words[:n] for n in range(len(words), 1, -1)]
    if not heads:
        return "", words
    found = rows.agg(*[F.max(F.col(text).contains(h)).alias(f"h{i}") for i, h in enumerate(heads)]).first()
    head = next((h for h, yes in zip(heads, found) if yes), "")
    return head, words[len(head) :]


def admitted(channels: dict[str, DataFrame], key: str, quota: int = 20) -> DataFrame:
    """Candidates of several channels (key, rank), `quota` of each: key, best_rank, votes."""
    from functools import reduce

    from lectern.operators.sequence import quotas

    rows = reduce(DataFrame.unionByName, (f.select(key, "rank", F.lit(name).alias("channel")) for name, f in channels.items()))
    return quotas(rows, key, "channel", [F.col("rank"), F.col(key)], quota)


#: Ask words of answer slots, and relation classes with the words that ask for them and those that tell of them: a starting vocabulary, in traditional script.
#: The names of the classes are fixed values.
SLOTS = {"time": ("何時", "哪一年", "什麼時候"), "place": ("何地", "在哪裡", "哪裡"), "reason": ("為何", "為什麼", "何故"), "quantity": ("多少", "幾"), "office": ("何官", "什麼官"), "object": ("何物", "什麼東西"), "outcome": ("結果", "結局")}
RELATIONS = {
    "death": (("去世", "被殺", "死"), ("卒", "薨", "崩", "殺")), "policy": (("變法", "改制"), ("變法", "更令")), "imprisonment": (("入獄", "囚禁"), ("下獄", "囚")), "punishment": (("受罰", "用刑"), ("刑", "黥")),
    "cause": (("起因", "緣由"), ("因", "故")), "birth": (("出生", "誕生"), ("生",)), "accession": (("即位", "繼位"), ("即位", "立")), "appointment": (("任官", "拜官"), ("拜", "除", "授")),
    "movement": (("遷往", "逃往"), ("遷", "奔", "徙")), "military": (("攻打", "征伐"), ("伐", "攻", "圍", "敗")), "document": (("著書", "編修"), ("著", "撰")), "exam": (("登科", "應試"), ("登第", "及第")),
    "resignation": (("辭官", "致仕"), ("辭官", "乞骸骨")), "demotion": (("被貶", "降職"), ("貶", "謫")), "kinship": (("親族", "婚配"), ("娶", "妻", "子")), "quantity": (("數目", "人數"), ("萬", "千", "百")),
}


def question_plan(question: str) -> tuple[Plan, list[str], list[str]]:
    """A question as a plan, with its answer slots and relation classes. What is neither names the subject first and then clues; nothing is guessed about who they are."""
    rest, slots, kinds, told = question, [], [], []
    for slot, asks in SLOTS.items():
        if any(a in rest for a in asks):
            slots.append(slot)
            for a in sorted(asks, key=len, reverse=True):
                rest = rest.replace(a, " ")
    for kind, (asks, words) in RELATIONS.items():
        if any(a in rest for a in asks):
            kinds.append(kind)
            told += words
            for a in sorted(asks, key=len, reverse=True):
                rest = rest.replace(a, " ")
    runs = re.findall("[㐀-鿿]{2,}", re.sub("[的了在是與和？]", " ", rest))
    return Plan(tuple(runs[:1]), tuple(dict.fromkeys(told)), tuple(runs[1:4])), slots, kinds
