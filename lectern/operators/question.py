"""Questions: vocabulary, expansion into groups of terms, candidate pools, an explainable score, and events."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed weights of the score.
EXACT, MORE, PAIR, OWN_ALIAS, ALIAS, WEAK = 14.0, 9.5, 20.0, 14.0, 6.0, 2.0
STRONG, STRONG_MORE, STRONG_MOST, MILD, MILD_MOST, TOPIC = 8.0, 2.0, 14.0, 1.5, 4.5, 5.0
COMBO, COMBO_WEAK, COMBO_BARE, DURATION = 15.0, 6.0, 3.0, 20.0


@dataclass(frozen=True)
class Entity:
    name: str
    canonical: tuple[str, ...]
    alias: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()


@dataclass(frozen=True)
class Vocabulary:
    """What questions are read by: entities, and intents with the words that ask for them and the words that answer."""

    entities: tuple[Entity, ...] = ()
    asks: dict[str, tuple[str, ...]] = field(default_factory=dict)
    strong: dict[str, tuple[str, ...]] = field(default_factory=dict)
    mild: dict[str, tuple[str, ...]] = field(default_factory=dict)
    stop: frozenset[str] = frozenset()
    lasting: str = ""  # a pattern of what says how long something lasts; the intent that asks for it is `duration`


@dataclass(frozen=True)
class Question:
    text: str
    entities: tuple[Entity, ...]
    own: tuple[str, ...]  # forms that the question itself uses
    intents: tuple[str, ...]
    years: tuple[str, ...]
    strong: tuple[str, ...]
    mild: tuple[str, ...]
    topics: tuple[str, ...]
    lasting: str = ""


#: Forms of years: of a reign, before our era, and in digits. They are kept as they are written and never converted.
YEARS = re.compile(r"(?:公元)?前[0-9]{1,4}年?|(?:[㐀-鿿]{1,2}[公王帝侯])?(?:元|[一二三四五六七八九十百]+)年|[0-9]{3,4}")


def years(text: str) -> list[str]:
    return [m[0] for m in YEARS.finditer(text)]


def analyze(text: str, words: Vocabulary) -> Question:
    """Entities by their longest forms, intents in the vocabulary's order, years as they are written, and the rest as topics."""
    rest, found, own = text, [], []
    forms = sorted(((f, e) for e in words.entities for f in (*e.canonical, *e.alias)), key=lambda x: (-len(x[0]), x[0]))
    for form, entity in forms:
        if form in rest:
            rest = rest.replace(form, " ")
            own.append(form)
            if entity not in found:
                found.append(entity)
    intents = [name for name, asks in words.asks.items() if any(a in text for a in asks)]
    for name in intents:
        for a in words.asks[name]:
            rest = rest.replace(a, " ")
    rest = YEARS.sub(" ", rest)
    topics = tuple(dict.fromkeys(w for w in re.findall(r"\w{2,}", rest) if w not in words.stop and not w.isdigit()))
    pick = lambda table: tuple(dict.fromkeys(x for n in intents for x in table.get(n, ())))
    return Question(text, tuple(found), tuple(own), tuple(intents), tuple(years(text)), pick(words.strong), pick(words.mild), topics, words.lasting)


def _hits(text: Column, terms) -> Column:
    """Number of terms that occur."""
    return reduce(lambda a, b: a + b, (text.contains(t).cast("int") for t in terms), F.lit(0))


def _any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms), F.lit(False))


def scored(rows: DataFrame, q: Question, text: str = "text_orig") -> DataFrame:
    """rows with score and detail, an array of the parts that are not zero. All is one expression over the text."""
    x = F.coalesce(F.col(text), F.lit(""))
    n_exact = _hits(x, [f for e in q.entities for f in e.canonical])
    present = reduce(lambda a, b: a + b, (_any(x, (*e.canonical, *e.alias, *e.weak)).cast("int") for e in q.entities), F.lit(0))
    own, alias, weak = (_any(x, t) for t in ([f for e in q.entities for f in e.alias if f in q.own], [f for e in q.entities for f in e.alias], [f for e in q.entities for f in e.weak]))
    several = present >= 2
    exact = F.when(n_exact > 0, EXACT + MORE * (n_exact - 1)).otherwise(0.0)
    pair = F.when(several, PAIR).otherwise(0.0)
    by_alias = F.when(several | (n_exact > 0), 0.0).when(own, OWN_ALIAS).when(alias, ALIAS).otherwise(0.0)
    by_weak = F.when(several | (n_exact > 0) | alias, 0.0).when(weak, WEAK).otherwise(0.0)
    n_strong, n_mild = _hits(x, q.strong), _hits(x, q.mild)
    strong = F.when(n_strong > 0, F.least(F.lit(STRONG_MOST), STRONG + STRONG_MORE * (n_strong - 1))).otherwise(0.0)
    mild = F.least(F.lit(MILD_MOST), MILD * n_mild)
    topic = F.when(_any(x, q.topics), TOPIC).otherwise(0.0)
    firm = (n_exact > 0) | (by_alias > 0)
    combo = F.when((n_strong > 0) & firm, COMBO).when((n_strong > 0) & ((by_weak > 0) | several), COMBO_WEAK).when(firm | (by_weak > 0) | several, COMBO_BARE).otherwise(0.0)
    lasts = F.when(firm & x.rlike(q.lasting), DURATION).otherwise(0.0) if q.lasting and "duration" in q.intents else F.lit(0.0)
    parts = {"duration": lasts, "exact": exact, "pair": pair, "alias": by_alias, "weak": by_weak, "strong": strong, "mild": mild, "topic": topic, "combo": combo}
    detail = F.array_compact(F.array(*[F.when(v != 0, F.concat(F.lit(k + "="), v.cast("string"))) for k, v in parts.items()]))
    return rows.withColumns({"score": F.round(reduce(lambda a, b: a + b, parts.values()), 2), "detail": detail})


def pools(rows: DataFrame, first: Column, fallback: Column) -> DataFrame:
    """Rows of the first pool; those of the fallback only if the first has none. One scan for both and a one-row aggregate."""
    some = rows.agg(F.coalesce(F.max(first.cast("int")), F.lit(0)).alias("_some"))
    both = rows.withColumns({"_a": first, "_b": fallback}).where("_a or _b").crossJoin(F.broadcast(some))  # one row
    return both.where(F.when(F.col("_some") == 1, F.col("_a")).otherwise(F.col("_b"))).drop("_a", "_b", "_some")


def events(blocks: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Blocks of one place as an event: relevance, best rank, matches, blocks. The keys must name the file: sources are never merged."""
    return blocks.groupBy(source, *keys).agg(F.max("score").alias("relevance"), F.min("rank").alias("best_rank"), F.sum("match_count").alias("match_count"), F.count(F.lit(1)).alias("n_blocks"))


def by_source(events_: DataFrame, source: str) -> DataFrame:
    return events_.groupBy(source).agg(F.count(F.lit(1)).alias("n_events"), F.max("relevance").alias("best"))


def names_in_corpus(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """Full names that a pattern finds, with how often: name, short (without its first character), n."""
    found = rows.select(F.explode(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).alias("name"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", F.expr("substring(name, 2)").alias("short"), "n")


def short_forms(names: DataFrame, bare: DataFrame, least: int = 3) -> DataFrame:
    """Short forms that occur `least` times at least outside full names (bare: short, total): short, candidates, bare, unique."""
    by = names.groupBy("short").agg(F.count(F.lit(1)).alias("candidates"), F.sum("n").alias("_explained"))
    out = by.join(bare, "short").withColumn("bare", F.col("total") - F.col("_explained")).where(F.col("bare") >= least)
    return out.select("short", "candidates", "bare", (F.col("candidates") == 1).alias("unique"))


def resolved(shorts: DataFrame, names: DataFrame, curated: dict[str, str] | None = None) -> DataFrame:
    """What short forms stand for: short, name, method. shorts: short, context (the text around it); names: name, short, n.

    In turn: a curated alias, a full name of the corpus, the only full name with this end, the only one of them whose first character stands in the
    context, else unresolved.
    """
    known = F.create_map(*(F.lit(x) for p in (curated or {}).items() for x in p)) if curated else F.lit(None).cast("map<string,string>")
    by = names.groupBy("short").agg(F.array_sort(F.collect_set("name")).alias("_all"))
    full = names.select(F.col("name").alias("short"), F.col("name").alias("_full")).distinct()
    rows = shorts.join(by, "short", "left").join(full, "short", "left")
    near = F.filter("_all", lambda n: F.col("context").contains(F.substring(n, 1, 1)))
    steps = [("curated", known[F.col("short")]), ("full name", F.col("_full")), ("unique", F.when(F.size("_all") == 1, F.get("_all", F.lit(0)))), ("context", F.when(F.size(near) == 1, F.get(near, F.lit(0))))]
    name = F.coalesce(*(c for _, c in steps))
    method = F.coalesce(*(F.when(c.isNotNull(), m) for m, c in steps), F.lit("unresolved"))
    return rows.select("short", name.alias("name"), method.alias("method"))
