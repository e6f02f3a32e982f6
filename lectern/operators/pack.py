"""Evidence packs for a question: grounded words, planned searches, context, and a diverse selection within a budget."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Fixed bounds of a plan and of a pack.
ANCHORS, PROBES, TERMS, SEARCHES = 4, 20, 8, 6
ITEMS, CHARACTERS, SHARED, CANDIDATES = 10, 12_000, 0.6, 600


def probes(run: str) -> list[str]:
    """What a run is looked for by: itself, then its beginnings and endings of two characters and more, longer ones first."""
    shorter = range(len(run) - 1, 1, -1)
    return [run, *dict.fromkeys(part for n in shorter for part in (run[:n], run[-n:]))]


def grounded(passages: DataFrame, runs: list[str], text: str = "normalized_text") -> list[str]:
    """For each run the first of its probes that the corpus contains, ANCHORS at most. PROBES of them, dealt to the runs in turn, are answered by one scan."""
    turns = [p for n in range(max(map(len, runs), default=0) * 2) for r in runs for p in probes(r)[n : n + 1]]
    asked = list(dict.fromkeys(turns))[:PROBES]
    if not asked:
        return []
    there = passages.agg(*(F.max(T.contains(text, p)).alias(f"p{i}") for i, p in enumerate(asked))).first()
    known = {p for i, p in enumerate(asked) if there[f"p{i}"]}
    best = [min((p for p in probes(r) if p in known), key=probes(r).index, default=None) for r in runs]
    return list(dict.fromkeys(filter(None, best)))[:ANCHORS]


def searches(anchors: list[str], terms: list[str]) -> list[str]:
    """Planned searches: sets of anchors, the larger first, then each anchor with each word of the relation, the words in turn; SEARCHES at most."""
    sets = [" ".join(some) for n in range(len(anchors), 0, -1) for some in combinations(anchors, n)]
    return list(dict.fromkeys([*sets[: SEARCHES - 2], *(f"{a} {t}" for t in terms[:TERMS] for a in anchors), *sets]))[:SEARCHES]


def topics(text: str, stop: str, phrases: tuple[str, ...] = ()) -> list[str]:
    """What is left of a question without phrases and function characters, in pieces of four, three or two characters."""
    for p in phrases:
        text = text.replace(p, " ")
    out: list[str] = []
    for run in re.findall(f"[^\\W{re.escape(stop)}]+", text):
        if len(run) == 1:
            out.append(run)
        at = 0
        while at + 2 <= len(run):
            size = next(n for n in (4, 3, 2) if at + n <= len(run))
            out.append(run[at : at + size])
            at += size
    return list(dict.fromkeys(out))


def nearest_gap(text: Column, first: str, second: str) -> Column:
    """The smallest distance between an occurrence of one term and one of another; null if either is missing. Time grows with the length of the text."""

    def places(x: str, term: str) -> np.ndarray:
        out, at = [], x.find(term)
        while at >= 0:
            out.append(at)
            at = x.find(term, at + len(term))
        return np.array(out, dtype=np.int64)

    @F.pandas_udf("int")
    def gap(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            a, b = (places(x, t) if x else np.zeros(0, dtype=np.int64) for t in (first, second))
            if len(a) and len(b):
                at = np.searchsorted(b, a)
                out.append(int(np.minimum(np.abs(b[np.minimum(at, len(b) - 1)] - a), np.abs(a - b[np.maximum(at - 1, 0)])).min()))
            else:
                out.append(None)
        return pd.Series(out, dtype="Int32")

    return gap(text)


def features(rows: DataFrame, text: str, anchors: list[str], terms: list[str], near: int = 24) -> DataFrame:
    """rows with n_anchors, n_terms, gap (of the first anchor and any term), complete, and a transparent score."""
    x = F.col(text)
    n_anchors = reduce(lambda a, b: a + b, (x.contains(t).cast("int") for t in anchors), F.lit(0))
    n_terms = reduce(lambda a, b: a + b, (x.contains(t).cast("int") for t in terms), F.lit(0))
    gaps = [nearest_gap(x, anchors[0], t) for t in terms] if anchors else []
    gap = F.least(*gaps) if len(gaps) > 1 else gaps[0] if gaps else F.lit(None).cast("int")
    out = rows.withColumns({"n_anchors": n_anchors, "n_terms": n_terms, "gap": gap})
    complete = F.col("n_anchors") == len(anchors)
    score = F.col("n_anchors") * 18 + F.least("n_terms", F.lit(4)) * 2 + F.when(complete, 25).otherwise(-25) + F.when(F.coalesce(F.col("gap") <= near, F.lit(False)), 20).otherwise(0)
    return out.withColumns({"complete": complete, "score": score})


def selected(candidates: DataFrame, key: str, rows: str, size: str, firm: str | None = None) -> DataFrame:
    """The CANDIDATES best by score with their place and what becomes of them: taken, or why not: `unsupported` (others are firm and this one is not), `same context`
    (SHARED of the shorter list of rows is that of one taken), `no place left` (ITEMS) or `too long` (CHARACTERS). rows: an array of row ids.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", key], ascending=[False, True], kind="stable").reset_index(drop=True)
        sure = pdf[firm].fillna(False).astype(bool) if firm else pd.Series(True, index=pdf.index)
        holders: dict[int, list[int]] = {}  # row: the taken ones that hold it
        lengths: list[int] = []
        room, fates = CHARACTERS, []
        for i in pdf.index:
            own = set(pdf[rows][i])
            shared = Counter(j for r in own for j in holders.get(r, ()))
            same = any(n >= SHARED * min(len(own), lengths[j]) for j, n in shared.items())
            tests = {"unsupported": sure.any() and not sure[i], "same context": same, "no place left": len(lengths) == ITEMS, "too long": pdf[size][i] > room}
            fate = next((name for name, failed in tests.items() if failed), "taken")
            if fate == "taken":
                for r in own:
                    holders.setdefault(r, []).append(len(lengths))
                lengths.append(len(own))
                room -= pdf[size][i]
            fates.append(fate)
        return pd.DataFrame({key: pdf[key], "place": range(1, len(pdf) + 1), "decision": fates})

    kind = candidates.schema[key].dataType.simpleString()
    best = candidates.orderBy(F.desc("score"), key).limit(CANDIDATES)
    return best.groupBy(F.lit(1).alias("_one")).applyInPandas(choose, f"{key} {kind}, place int, decision string")


def clusters(hits: DataFrame, file: str, row: str, gap: int = 300) -> DataFrame:
    """Hits of a file in batches: a batch ends where a hit is more than `gap` rows from its first. file, row, batch."""
    kind = hits.schema[file].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row, kind="stable")
        batch, first, out = 0, None, []
        for r in pdf[row]:
            if first is None or r - first > gap:
                batch, first = batch + 1, r
            out.append(batch)
        return pdf[[file, row]].assign(batch=out)

    return hits.select(file, row).groupBy(file).applyInPandas(one, f"{file} {kind}, {row} {hits.schema[row].dataType.simpleString()}, batch int")


def bound_chunks(rows: DataFrame, file: str, order: str, boundary: str, text: str, most: int = 280, overlap: int = 48) -> DataFrame:
    """Chunks of whole rows within a file and boundary: file, n, first_row, last_row, chunk. A chunk holds up to `most` characters (a longer row is one
    of its own) and begins with as many of the last rows of the one before as have `overlap` characters at least, if they fit."""

    def cut(sizes: list[int]) -> Iterator[tuple[int, int]]:
        lo = 0
        while lo < len(sizes):
            hi, n = lo, sizes[lo]
            while hi + 1 < len(sizes) and n + sizes[hi + 1] <= most:
                hi, n = hi + 1, n + sizes[hi + 1]
            yield lo, hi
            if hi + 1 == len(sizes):
                return
            back, held = hi + 1, 0
            while back - 1 > lo and held < overlap:
                back, held = back - 1, held + sizes[back - 1]
            lo = back if held + sizes[hi + 1] <= most else hi + 1

    kind = rows.schema[file].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        same = (pdf[boundary].fillna("") != pdf[boundary].fillna("").shift()).cumsum()
        out = []
        for _, g in pdf.groupby(same):
            texts, places = g[text].fillna("").tolist(), g[order].tolist()
            out += [(g[file].iloc[0], places[a], places[b], "\n".join(texts[a : b + 1])) for a, b in cut(list(map(len, texts)))]
        made = pd.DataFrame(out, columns=[file, "first_row", "last_row", "chunk"])
        made.insert(1, "n", range(len(made)))
        return made

    return rows.select(file, order, boundary, text).groupBy(file).applyInPandas(one, f"{file} {kind}, n int, first_row int, last_row int, chunk string")


def reranked(candidates: DataFrame, query: str, text: str, scorer=None, limit: int = 120, characters: int = 1000) -> DataFrame:
    """Candidates, `limit` at most, with model_score. scorer: (query, texts) -> scores, run on executors in batches; without one, the part of the query's
    words that the text has, which is deterministic and needs no model."""
    head = candidates.limit(limit)
    if scorer is None:
        want = sorted(set(query.lower().split()))
        have = F.split(F.lower(F.substring(text, 1, characters)), r"\s+")
        return head.withColumn("model_score", F.size(F.array_intersect(have, F.array(*map(F.lit, want)))) / F.lit(float(len(want))))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, [t[:characters] for t in texts.fillna("")]), dtype="float64")

    return head.withColumn("model_score", score(F.col(text)))
