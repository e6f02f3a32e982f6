"""Clauses and what they say of known names: one small grammar whose words are all parameters.

A sentence outside quotations is a row of clauses. Each is read from left to right: what frames it (hearsay, a condition, a date, an order), a known name or
none, small words, a verb, a preposition, an object. Whatever does not fit is left unread, so silence is never taken for a denial. The operators below look at
neighbouring clauses only: a clause without a name goes on with the one before, a pronoun stands for a name of the clause before.

Offsets are those of the unchanged text. Nothing here claims that a statement is true.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.evidence import date_prefix, masked, quotes, speeches, units

Span = tuple[int, int]


@dataclass(frozen=True)
class Lexicon:
    """Words by their place in a clause. spaced: words are separated by spaces and end where letters end."""

    verbs: dict[str, tuple[str, ...]]
    plain: tuple[str, ...] = ()
    denying: tuple[str, ...] = ()
    intending: tuple[str, ...] = ()
    hearsay: tuple[str, ...] = ()
    supposing: tuple[str, ...] = ()
    ordering: tuple[str, ...] = ()
    prepositions: tuple[str, ...] = ()
    pronouns: tuple[str, ...] = ()
    passive: tuple[tuple[str, str], ...] = ()  # what opens the agent, and what closes it
    naming: tuple[str, ...] = ()
    marks: str = "，,；;：:、"
    spaced: bool = False

    def kinds(self) -> dict[str, str]:
        return {w: kind for kind, words in self.verbs.items() for w in words}


#: A starting vocabulary of literary Chinese; callers bring their own.
WORDS = Lexicon(
    verbs={
        "attack": ("攻", "伐", "圍", "侵"), "defeat": ("敗", "破"), "repel": ("擊", "逐"), "capture": ("獲", "擒", "虜"), "seize": ("執", "拘"), "kill": ("誅", "殺", "斬"),
        "travel": ("至", "如", "入", "走至"), "retire": ("辭官", "歸田", "乞骸骨"), "appoint": ("拜", "除", "遷"), "urge": ("勸", "諫", "說"), "die": ("卒", "薨"), "return": ("還", "退"),
    },
    plain=("遂", "乃", "又", "復"), denying=("不", "未", "弗"), intending=("將", "欲"), hearsay=("聞", "傳言", "或言"), supposing=("若", "如使"), ordering=("令", "命"),
    prepositions=("于", "於"), pronouns=("之",), passive=(("為", "所"), ("被", "")), naming=("字", "號"),
)


@dataclass
class Clause:
    start: int
    end: int
    unit: Span
    subject: Span | None = None
    kind: str | None = None
    verb: Span | None = None
    object: Span | None = None
    agent: Span | None = None  # of a passive clause, whose subject is who suffers it
    passive: bool = False
    polarity: str = "asserted"
    when: tuple[Span, dict] | None = None
    carried: bool = False  # the subject is that of a clause before
    extra: dict = field(default_factory=dict)


class Reader:
    """Reads clauses with a lexicon and known names."""

    def __init__(self, lexicon: Lexicon, names: tuple[str, ...]):
        self.lexicon, self.kinds = lexicon, lexicon.kinds()
        by_length = lambda words: sorted(set(words) - {""}, key=lambda w: (-len(w), w))
        self.names, self.verbs = by_length(names), by_length(self.kinds)
        self.small = {w: p for words, p in ((lexicon.plain, None), (lexicon.denying, "denied"), (lexicon.intending, "intended")) for w in words}
        self.smalls, self.frames = by_length(self.small), [(by_length(lexicon.hearsay), "reported"), (by_length(lexicon.supposing), "supposed"), (by_length(lexicon.ordering), "ordered")]

    def word(self, text: str, at: int, end: int, words: list[str]) -> int | None:
        """The end of the longest of the words that stands at a place."""
        for w in words:
            stop = at + len(w)
            if stop <= end and text.startswith(w, at) and not (self.lexicon.spaced and stop < end and text[stop].isalnum()):
                return stop
        return None

    def gap(self, text: str, at: int, end: int) -> int:
        while at < end and text[at].isspace():
            at += 1
        return at

    def clause(self, text: str, start: int, end: int, unit: Span, held: str | None) -> Clause:
        c = Clause(start, end, unit)
        at = self.gap(text, start, end)
        said = [held] if held else []
        if not self.lexicon.spaced and (found := date_prefix(text[at:end])):
            c.when, at = ((at, at + found[0]), found[1]), self.gap(text, at + found[0], end)
        for words, name in self.frames[:2]:
            if (stop := self.word(text, at, end, words)) is not None:
                said.append(name)
                c.extra["scope"] = name
                at = self.gap(text, stop, end)
        if (stop := self.word(text, at, end, self.names)) is not None:
            c.subject, at = (at, stop), self.gap(text, stop, end)
        if (stop := self.word(text, at, end, self.frames[2][0])) is not None:
            said.append("ordered")
            at = self.gap(text, stop, end)
            if (stop := self.word(text, at, end, self.names)) is not None:
                at = self.gap(text, stop, end)
        while (stop := self.word(text, at, end, self.smalls)) is not None and self.word(text, at, end, self.verbs) is None:
            if self.small[text[at:stop]]:
                said.append(self.small[text[at:stop]])
            at = self.gap(text, stop, end)
        for opens, closes in self.lexicon.passive:
            stop = self.word(text, at, end, [opens])
            verb_at = text.find(closes, stop, end) if stop is not None and closes else stop
            if stop is not None and verb_at >= 0 and self.word(text, verb_at + len(closes), end, self.verbs):
                c.agent = (stop, verb_at) if verb_at > stop else None
                c.passive, at = True, verb_at + len(closes)
                break
        if (stop := self.word(text, at, end, self.verbs)) is not None:
            c.verb, c.kind = (at, stop), self.kinds[text[at:stop]]
            at = self.gap(text, stop, end)
            if (stop := self.word(text, at, end, list(self.lexicon.prepositions))) is not None:
                at = self.gap(text, stop, end)
            stop = self.word(text, at, end, self.names) or end
            while stop > at and text[stop - 1].isspace():
                stop -= 1
            if stop > at:
                c.object = (at, stop)
        c.polarity = next((p for p in ("denied", "supposed", "reported", "ordered", "intended") if p in said), "asserted")
        return c

    def read(self, text: str) -> list[Clause]:
        """All clauses outside quotations in order. A frame of hearsay or condition holds to the end of its sentence, and so does a date."""
        plain, out = masked(text), []
        for s, e in units(text):
            held, at, before, when = None, s, None, None
            for i in range(s, e + 1):
                if i < e and plain[i] not in self.lexicon.marks and plain[i] not in "。！？!?.\n":
                    continue
                if plain[at:i].strip():
                    c = self.clause(plain, at, i, (s, e), held)
                    held = c.extra.get("scope", held)
                    c.when = when = c.when or when
                    if c.subject is None and before is not None and c.verb and before.subject:
                        c.subject, c.carried = before.subject, True
                    if c.verb or c.subject:
                        out.append(c)
                        before = c
                at = i + 1
        return out


def said(text: str, c: Clause, **more) -> dict:
    part = lambda span: None if span is None else text[slice(*span)]
    return {"kind": c.kind, "polarity": c.polarity, "start": c.unit[0], "end": c.unit[1], "quote": part(c.unit), "subject_span": c.subject, "predicate_span": c.verb, "object_span": c.object, "relation_verified": False} | more


def roles(text: str, subject: tuple[str, ...], objects: tuple[str, ...] = (), lexicon: Lexicon = WORDS, names: tuple[str, ...] = ()) -> list[dict]:
    """What the subject does, in clauses that name it; with objects, only to these."""
    reader = Reader(lexicon, (*subject, *objects, *names))
    return [said(text, c) for c in reader.read(text) if c.kind and c.subject and not c.carried and not c.passive and text[slice(*c.subject)] in subject and (not objects or (c.object and text[slice(*c.object)] in objects))]


def referents(text: str, names: tuple[str, ...], lexicon: Lexicon = WORDS, others: tuple[str, ...] = ()) -> list[dict]:
    """Pronouns as objects with the name that they stand for: the one that the clause before acts upon, else the one that acts in it, never the clause's own subject. others: known
    names that no pronoun stands for (places)."""
    out, before = [], None
    for c in Reader(lexicon, (*names, *others)).read(text):
        if before and c.object and text[slice(*c.object)] in lexicon.pronouns and c.unit == before.unit and c.polarity == before.polarity == "asserted":
            own = text[slice(*c.subject)] if c.subject else None
            for span in (before.object, before.subject):
                if span and text[slice(*span)] in names and text[slice(*span)] != own:
                    out.append(said(text, c, mention=c.object, antecedent=span))
                    break
        before = c
    return out


def outcomes(text: str, place: str, names: tuple[str, ...], lexicon: Lexicon = WORDS, first: str = "attack", then: str = "repel") -> list[dict]:
    """Who was driven off from a place: the one who attacks it in the clause before, where the pronoun of the second clause leads to them."""
    out = []
    for r in referents(text, names, lexicon, (place,)):
        if r["kind"] == then:
            for c in Reader(lexicon, (*names, place)).read(text):
                if c.kind == first and c.subject == r["antecedent"] and c.object and text[slice(*c.object)] == place:
                    out.append(r | {"object_span": r["antecedent"]})
    return out


def captured(text: str, person: tuple[str, ...], names: tuple[str, ...] = (), lexicon: Lexicon = WORDS, captor: tuple[str, ...] = ()) -> list[dict]:
    """Captures of a person, with the place that they had come to last in the same sentence, if nobody else acts in between."""
    out, place = [], None
    for c in Reader(lexicon, (*person, *names)).read(text):
        own = c.subject and text[slice(*c.subject)] in person
        if not own or (place and place[1] != c.unit):
            place = None
        if own and c.kind == "travel" and c.polarity == "asserted":
            place = (c.object, c.unit)
        if own and c.passive and c.kind == "capture" and c.polarity == "asserted" and (not captor or (c.agent and text[slice(*c.agent)] in captor)):
            out.append(said(text, c, place_span=place[0] if place else None, agent_span=c.agent))
    return out


def executed(text: str, person: tuple[str, ...], names: tuple[str, ...] = (), lexicon: Lexicon = WORDS) -> list[dict]:
    """Sentences in which a person is put to death, with the date that the sentence begins with, if it has one."""
    out = []
    for c in Reader(lexicon, (*person, *names)).read(text):
        whom = c.subject if c.passive else c.object
        if c.kind == "kill" and c.polarity == "asserted" and whom and text[slice(*whom)] in person:
            out.append(said(text, c, date=c.when[1] if c.when else None, date_span=c.when[0] if c.when else None))
    return out


def career(text: str, person: str, offices: tuple[str, ...], names: tuple[str, ...] = (), lexicon: Lexicon = WORDS) -> list[dict]:
    """Appointments of the person whom a biography is about: clauses without a subject from its first naming clause on, until somebody else acts."""
    out, mine = [], False
    for c in Reader(lexicon, (person, *names)).read(text):
        who = text[slice(*c.subject)] if c.subject else None
        if who == person:
            mine = True
        elif who is not None:
            mine = False
        if mine and c.kind == "appoint" and c.polarity == "asserted" and c.object and text[slice(*c.object)] in offices:
            out.append(said(text, c, subject_omitted=who is None or c.carried, office=text[slice(*c.object)]))
    return out


def departures(text: str, person: tuple[str, ...], names: tuple[str, ...] = (), lexicon: Lexicon = WORDS) -> list[dict]:
    """Retirements of a person and refusals of an office (a denied appointment of theirs)."""
    out = []
    for c in Reader(lexicon, (*person, *names)).read(text):
        if c.subject and text[slice(*c.subject)] in person and (c.kind == "retire" or (c.kind == "appoint" and c.polarity == "denied")):
            out.append(said(text, c, event="departure" if c.kind == "retire" else "refusal"))
    return out


def advice(text: str, names: tuple[str, ...], reasons: tuple[str, ...] = ("恐", "以", "故"), lexicon: Lexicon = WORDS) -> list[dict]:
    """Quoted advice: a clause of urging that leads to a quotation, with who urges whom, and the sentences of the quotation that give a reason."""
    out, reader = [], Reader(lexicon, names)
    clauses = reader.read(text)
    for s, e, depth in quotes(text) or []:
        lead = [c for c in clauses if c.kind == "urge" and c.end <= s and not text[c.end : s].strip("：:， ")]
        if depth == 0 and lead and lead[-1].subject:
            c = lead[-1]
            whom = reader.word(text, c.verb[1], c.end, reader.names)
            inner = [(s + 1 + a, s + 1 + b) for a, b in units(text[s + 1 : e - 1])]
            out.append(said(text, c, speaker=text[slice(*c.subject)], addressee=text[c.verb[1] : whom] if whom else None, quotation=(s, e), reason_spans=[x for x in inner if any(r in text[slice(*x)] for r in reasons)]))
    return out


def followed(text: str, advised: list[dict], names: tuple[str, ...], lexicon: Lexicon = WORDS) -> list[bool | None]:
    """For each advice whether its addressee then acts in the same paragraph: true, false where the act is denied, null where nothing is said."""
    clauses = Reader(lexicon, names).read(text)
    out = []
    for a in advised:
        stop = text.find("\n", a["quotation"][1])
        later = [c for c in clauses if c.start >= a["quotation"][1] and (stop < 0 or c.start < stop) and c.subject and c.kind and text[slice(*c.subject)] == a["addressee"]]
        out.append(None if not later else later[0].polarity == "asserted" if later[0].polarity in ("asserted", "denied") else None)
    return out


def motives(text: str, speaker: tuple[str, ...], actions: tuple[str, ...], reasons: tuple[str, ...], names: tuple[str, ...] = (), lexicon: Lexicon = WORDS) -> list[dict]:
    """What speakers give as a reason in their own words before they act on it in the same paragraph: their account, not the narrator's."""
    out, clauses = [], Reader(lexicon, (*speaker, *names)).read(text)
    for turn in speeches(text):
        stop = text.find("\n", turn["end"])
        if turn["speaker"] in speaker and any(r in turn["text"] for r in reasons):
            acts = [c for c in clauses if turn["end"] <= c.start and (stop < 0 or c.start < stop) and c.kind in actions and c.polarity == "asserted" and c.subject and text[slice(*c.subject)] in speaker]
            out += [said(text, c, attribution="speaker", reason_span=(turn["start"] + 1, turn["end"] - 1)) for c in acts[:1]]
    return out


def other_names(text: str, person: str, lexicon: Lexicon = WORDS) -> list[str]:
    """Names that the opening sentence of a biography gives its person behind a word of naming."""
    opening = units(text)[:1]
    if not opening or not text[slice(*opening[0])].lstrip().startswith(person):
        return []
    rest = text[slice(*opening[0])].lstrip()[len(person) :]
    for mark in lexicon.marks + "。":
        rest = rest.replace(mark, "\n")
    parts = [p.strip() for p in rest.split("\n")]
    return [p[len(w) :] for p in parts for w in lexicon.naming if p.startswith(w) and 0 < len(p) - len(w) <= 3]


def introduced(text: str, at: int, short: str, names: tuple[str, ...]) -> Span | None:
    """Where the only full name of the paragraph that a short form at a place can stand for was last written out before it, outside quotations."""
    if not short or not text.startswith(short, at):
        return None
    plain, left = masked(text), text.rfind("\n", 0, at) + 1
    full = [n for n in names if n != short and n.endswith(short) and plain.find(n, left, at) >= 0]
    if len(full) != 1 or any(s < at < e for s, e, _ in quotes(text) or []):
        return None
    start = plain.rfind(full[0], left, at)
    return start, start + len(full[0])


#: What evidence can say of a statement, by what is there.
STATUSES = ("no_event", "no_reason", "other_roles", "undated", "other_party", "contradicted", "supported")


def adjudicated(found: list[dict], wanted: dict, pinned: bool = True) -> str:
    """One of STATUSES for a wanted statement: kind, and subject, object, reason and date where they are asked for (true asks for any).

    found: observations with the same keys as texts. Evidence whose source no longer has its pinned digest counts as none. Each step asks
    for more than the one before, and the answer names the first that fails.
    """
    same = [o for o in found if pinned and o.get("kind") == wanted["kind"]]
    if not same:
        return "no_event"
    fits = lambda o, k: k not in wanted or (o.get(k) is not None if wanted[k] is True else o.get(k) == wanted[k])
    for keys, status in ((("reason",), "no_reason"), (("subject",), "other_roles"), (("date",), "undated"), (("object",), "other_party")):
        same = [o for o in same if all(fits(o, k) for k in keys)]
        if not same:
            return status
    said_ = {o["polarity"] for o in same}
    return "supported" if "asserted" in said_ and "denied" not in said_ else "contradicted" if "denied" in said_ else "no_event"


OBSERVED = "kind string, polarity string, start int, end int, subject string, object string, quote string, relation_verified boolean"


def observed(candidates: DataFrame, key: str, text: str, subject: tuple[str, ...], objects: tuple[str, ...] = (), lexicon: Lexicon = WORDS, names: tuple[str, ...] = ()) -> DataFrame:
    """Observations of roles() for every candidate, one row each."""
    kind = candidates.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                for o in roles(t or "", subject, objects, lexicon, names):
                    part = lambda span, t=t: t[slice(*span)] if span else None
                    rows.append((k, o["kind"], o["polarity"], o["start"], o["end"], part(o["subject_span"]), part(o["object_span"]), o["quote"], False))
            yield pd.DataFrame(rows, columns=["key", *(c.split()[0] for c in OBSERVED.split(", "))])

    named = candidates.where(F.col(text).rlike("|".join(f"\\Q{s}\\E" for s in subject)))
    return named.select(key, text).mapInPandas(run, f"key {kind}, {OBSERVED}").withColumnRenamed("key", key)
