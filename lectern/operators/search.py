"""Keyword search over passages: query plan, hit set, BM25, and pages of results."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Fixed parameters of the ranking formula.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Plan:
    """The words of a query; path says how an index would answer it and how hits are ordered."""

    long: tuple[str, ...]
    short: tuple[str, ...]
    groups: tuple[tuple[str, ...], ...]
    path: str


def plan(query: str, table: dict[str, str] | None = None) -> Plan:
    """Words of three characters and more are long. With a conversion table each word stands for its spellings, and several spellings force a scan."""
    words = query.split()
    groups = tuple(tuple(T.variants(w, table)) if table else (w,) for w in words)
    long, short = tuple(w for w in words if len(w) >= 3), tuple(w for w in words if len(w) < 3)
    if any(len(g) > 1 for g in groups):
        path = "scan"
    else:
        path = "trigram" if long else "bigram" if words and all(len(w) == 2 for w in words) else "scan"
    return Plan(long, short, groups, path)


def hits(passages: DataFrame, plan_: Plan, text: str = "normalized_text") -> DataFrame:
    """Passages that have a spelling of every word; none for an empty query."""
    if not plan_.groups:
        return passages.limit(0)
    return passages.where(T.contains_all(text, [list(g) for g in plan_.groups]))


def gram_length(text: Column, n: int) -> Column:
    """Number of n-grams of a text."""
    return F.greatest(F.length(text) - (n - 1), F.lit(0))


def bm25(passages: DataFrame, terms: list[str], text: str = "normalized_text", n: int = 3, into: str = "score") -> DataFrame:
    """Passages that contain all terms with their summed BM25; the smaller, the better (as an index reports it).

    One scan: it writes the passages that have all terms, with their sizes and counts, and observes the totals on the way.
    """
    from pyspark.sql import Observation

    from lectern.sources.storage import stored

    x = F.col("_x")
    rows = passages.withColumn("_x", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumns({"_size": gram_length(x, n)} | {f"_tf{i}": T.occurrences(x, t.lower()) for i, t in enumerate(terms)})
    seen = Observation()
    some = {f"df{i}": F.count_if(F.col(f"_tf{i}") > 0) for i in range(len(terms))}
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.col("_size").cast("long")).alias("total"), *(c.alias(k) for k, c in some.items()))
    found = stored(rows.where(reduce(lambda a, b: a & b, (F.col(f"_tf{i}") > 0 for i in range(len(terms))))).drop("_x"))
    total = seen.get
    average = F.lit(float(total["total"] or 0) / max(1, total["n"]))
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = total[f"df{i}"], F.col(f"_tf{i}")
        idf = max(math.log((total["n"] - df + 0.5) / (df + 0.5)), LEAST_IDF)
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_size") / average))
    return found.withColumn(into, -score).drop("_size", *(f"_tf{i}" for i in range(len(terms))))


def search(passages: DataFrame, query: str, order: list, number: int = 1, size: int = 20, table: dict[str, str] | None = None, **equal: str) -> DataFrame:
    """A page of results: hits of the query among passages with the given column values, in order."""
    from lectern.operators.relational import page

    rows = passages
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return page(hits(rows, plan(query, table)), order, number, size)


def postings(passages: DataFrame, n: int, doc: str = "passage_id", text: str = "normalized_text") -> DataFrame:
    """gram, doc, tf: an inverted index of character n-grams, counted row by row where the rows lie, so nothing is shuffled before it is grouped by gram.
    Only needed where many queries share it; a single query is a scan. Rows of equal doc give postings each."""
    kind = passages.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, grams, counts = [], [], []
            for d, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                found = Counter(t[i : i + n] for i in range(len(t) - n + 1)) if t else {}
                docs += [d] * len(found)
                grams += found
                counts += found.values()
                if len(docs) > 200_000:
                    yield pd.DataFrame({"gram": grams, doc: docs, "tf": counts})
                    docs, grams, counts = [], [], []
            yield pd.DataFrame({"gram": grams, doc: docs, "tf": counts})

    return passages.select(doc, text).mapInPandas(run, f"gram string, {doc} {kind}, tf long")


def resolve_book(books: DataFrame, name: str, table: dict[str, str] | None = None) -> str:
    """The id of the book that has this id, title or short name (books: book_id, names); an unknown name raises an error with the known ids."""
    forms = T.variants(name, table) if table else [name]
    found = books.where(F.col("book_id").isin(forms) | F.arrays_overlap("names", F.array(*map(F.lit, forms)))).orderBy("book_id").first()
    if found is None:
        raise ValueError(f"no book {name!r}; known: {', '.join(r.book_id for r in books.select('book_id').orderBy('book_id').limit(100).collect())}")
    return found.book_id


def resolve_edition(name: str | None, known: tuple[str, ...] = ("tls", "sbck")) -> str | None:
    """A known edition; anything else means no restriction."""
    return name.lower() if name and name.lower() in known else None
