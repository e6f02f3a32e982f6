"""Document quality by ordinal cumulative-link regression on hashed text.

Ratings are ordered grades 0 < 1 < ... < k-1. One weight vector over hashed features gives a document's score s; ordered thresholds
t1 < ... < t(k-1) give P(grade >= j) = sigmoid(s - tj). Features whose rates below and from a grade on differ for no grade are left out; the
weights of the others and the thresholds are fitted together by L-BFGS with a ridge penalty. A document's expected grade is the sum of its
tail probabilities, and it is kept if the tail at the chosen grade is at least one half.

Labels of quality and toxicity become three grades, toxic below poor below good. Toxic words add up without bound, so they belong
at an end of the scale; between poor and good a text with several of them would fall out of its band.

Features, each present or not: the words without punctuation around them and their first and last bytes (so that forms of
one word share weights), hashed to 2**20 places, and bands of a few rates of the whole text (letters, capitals, digits,
punctuation, distinct words, word length, number of words). Rates of short texts are drawn to usual ones by 200 bytes or 20 words
of them.

The model is fitted on a bounded sample, the `sample` rated documents that come first in hash order of their ids (all, if there are
fewer), in one task; the weights, 4 MB, are broadcast. Scoring reads every document whole. Null text counts as empty.
Ratings with a null are left out, several ratings of one id count as the lowest grade; null ids are scored but not
rated. Without any rated document all are kept, at the highest grade. Repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW_KEY, as_bytes, keyed, scanned, slices, stored, without
from lectern.llm.tokens import hash_words

SAMPLE = 16_384
#: Bytes of texts whose features are made at a time, and features counted at a time: some arrays hold eight bytes for each.
PIECE = 1 << 20
PLACES = 1 << 20
STEPS, RIDGE, Z = 300, 0.3, 5.0
#: Bytes of a word that are features too: first ones, and last ones where negative.
AFFIXES = (4, 5)
_RATES, _BANDS = 7, 16
_LETTER = np.array([chr(i).isalpha() or i >= 128 for i in range(256)])
_CAPITAL = np.array([65 <= i <= 90 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_SPACE = np.array([i in (9, 10, 11, 12, 13, 32) for i in range(256)])


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which for integers is many times faster than its hashing."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, one after another, and where each text's begin."""
    found = hash_words(texts, True, AFFIXES)
    owner, n = found.owner(), np.diff(found.first)

    def places(hashes):
        return distinct_sorted(owner * PLACES + (hashes >> np.uint64(64 - 20)).astype(np.int64))

    own = places(found.hashes)
    distinct = np.bincount(own // PLACES, minlength=len(texts))
    own = distinct_sorted(np.concatenate([own, *map(places, found.affixes)]))
    sizes = np.array([len(t) for t in texts])
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    first = np.cumsum(np.r_[0, sizes])

    def share(table, usual):
        sums = np.r_[0, np.cumsum(table[b])]
        return (sums[first[1:]] - sums[first[:-1]] + 200 * usual) / (sizes + 200)

    letter, capital, digit, space = (share(t, u) for t, u in ((_LETTER, 0.82), (_CAPITAL, 0.03), (_DIGIT, 0.0), (_SPACE, 0.15)))
    distinct = (distinct + 20) / (n + 20)
    length = np.bincount(owner, weights=found.stop - found.start, minlength=len(texts)) / np.maximum(n, 1)
    rates = [letter, capital, digit, 1 - letter - digit - space, distinct, np.minimum(length / 24, 1), np.minimum(np.log2(n + 1) / 20, 1)]
    bands = [PLACES + r * _BANDS + np.minimum((x * _BANDS).astype(np.int64), _BANDS - 1) for r, x in enumerate(rates)]
    each = np.stack([np.arange(len(texts)) * (PLACES + _RATES * _BANDS) + x for x in bands], axis=1).ravel()
    doc, word = own // PLACES, own % PLACES
    every = np.sort(np.concatenate([doc * (PLACES + _RATES * _BANDS) + word, each]))
    text = every // (PLACES + _RATES * _BANDS)
    return every % (PLACES + _RATES * _BANDS), np.searchsorted(text, np.arange(len(texts) + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def scores(weights: np.ndarray, feature: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.r_[0.0, np.cumsum(weights[feature])]
    return sums[first[1:]] - sums[first[:-1]]


def screened(feature: np.ndarray, of: np.ndarray, grade: np.ndarray, grades: int) -> np.ndarray:
    """Features whose rates below and from some grade on differ by Z standard errors. of: the grade of each feature's document."""
    size, n = PLACES + _RATES * _BANDS, max(1, len(grade))
    seen = np.zeros((grades, size), dtype=np.int64)
    for at in range(0, len(feature), PIECE):
        here, its = feature[at : at + PIECE], of[at : at + PIECE]
        for j in range(grades):
            seen[j] += np.bincount(here[its == j], minlength=size)
    every = seen.sum(axis=0)
    out = np.zeros(size, dtype=bool)
    for j in range(1, grades):
        share = (grade >= j).mean() if len(grade) else 0.0
        error = np.sqrt(np.maximum(every * share * (1 - share) * (1 - every / n), 1e-9))
        out |= (np.abs(seen[j:].sum(axis=0) - every * share) >= Z * error) & (every > 1)
    return out


def minimized(f, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking: f gives value and gradient."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y, r in reversed(pairs):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * y
        if pairs:
            s, y, r = pairs[-1]
            q *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(pairs, reversed(alphas)):
            q += (a - r * (y @ q)) * s
        slope, rate = grad @ q, 1.0 if pairs else min(1.0, 1 / max(np.abs(grad).max(), 1e-12))
        if slope <= 1e-12:
            break
        while True:
            new = x - rate * q
            v, g = f(new)
            if v <= value - 1e-4 * rate * slope or rate < 1e-8:
                break
            rate /= 2
        s, y = new - x, g - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - v < 1e-9 * max(1.0, abs(value))
        x, value, grad = new, v, g
        if done:
            break
    return x


def fit(feature: np.ndarray, first: np.ndarray, grade: np.ndarray, grades: int, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the negative log-likelihood plus ridge / 2 times the weights' sum of squares.

    Features that screened() leaves out get no weight. Thresholds stay in order, as they are written as a first one and the
    logarithms of the gaps.
    """
    n = len(grade)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    chosen = screened(feature, np.repeat(grade.astype(np.int32), np.diff(first)), grade, grades)[feature]
    owner, feature = owner[chosen], feature[chosen]
    used, at = np.unique(feature, return_inverse=True)
    p = len(used)

    def cuts(t):
        return np.r_[t[:1], t[0] + np.cumsum(np.exp(t[1:]))]

    def loss(x):
        w, t = x[:p], x[p:]
        s = np.bincount(owner, weights=w[at], minlength=n)
        c = np.r_[-np.inf, cuts(t), np.inf]
        upper, lower = _sigmoid(s - c[grade]), _sigmoid(s - c[grade + 1])
        chance = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        gw = np.bincount(at, weights=(dl - du)[owner], minlength=p) + ridge * w
        gc = (np.bincount(grade, weights=du, minlength=grades + 1) - np.bincount(grade + 1, weights=dl, minlength=grades + 1))[1:grades]
        gt = np.r_[gc.sum(), [gc[j:].sum() * np.exp(t[j]) for j in range(1, grades - 1)]][: grades - 1] + 1e-3 * t
        return -np.log(chance).sum() + ridge / 2 * (w @ w) + 5e-4 * (t @ t), np.r_[gw, gt]

    x = minimized(loss, np.r_[np.zeros(p), np.r_[-1.0, np.zeros(max(0, grades - 2))][: grades - 1]], steps)
    full = np.zeros(PLACES + _RATES * _BANDS, dtype=np.float32)
    full[used] = x[:p]
    return full, cuts(x[p:])


def rated(docs: DataFrame, ratings: DataFrame, sample: int, doc_id: str, text: str) -> DataFrame:
    """grade and text of the documents that the model is fitted on. ratings: id, grade."""
    ratings = ratings.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    known = ratings.join(docs.select(F.col(doc_id).alias("id")).where("id is not null").distinct(), "id", "left_semi")
    known = known.withColumn("order", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    n = known.count()
    if n > 2 * sample:  # what comes first in hash order lies below half more than its share; this spares the tasks a sample each
        known = known.where(F.col("order") < int((1 << 40) * 1.5 * sample / n))
    chosen = stored(known.orderBy("order", "id").limit(sample).drop("order"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id")  # `sample` rows are broadcast
    return rows.groupBy("id").agg(F.min(F.struct("grade", "text")).alias("x")).select("x.grade", "x.text")  # one row for each id, however often it is there


def train(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds."""

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, PIECE):
                feature, first = features(as_bytes(batch.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["grade", "feature"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade, parts, sizes = [], [], []
        for batch in batches:
            lists = batch.column(1)
            grade += batch.column(0).to_pylist()
            parts.append(lists.flatten().to_numpy())
            sizes.append(np.diff(lists.offsets.to_numpy()))
        if grade:
            first = np.cumsum(np.r_[0, np.concatenate(sizes)])
            feature = np.concatenate(parts)
            parts.clear()
            w, cut = fit(feature, first, np.array(grade), grades)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([cut.tobytes()], pa.binary())], names=["w", "cut"])

    rows = rated(docs, ratings, sample, doc_id, text).selectExpr("cast(grade as int) as grade", "text")
    shaped = stored(rows.mapInArrow(shape, "grade int, feature array<int>"))
    model = shaped.orderBy("grade", F.xxhash64("feature")).coalesce(1).mapInArrow(learn, "w binary, cut binary").first()
    if model is None:
        return np.zeros(PLACES + _RATES * _BANDS, dtype=np.float32), np.full(grades - 1, -40.0)
    return np.frombuffer(model.w, dtype=np.float32), np.frombuffer(model.cut)


def score(docs: DataFrame, weights: np.ndarray, cut: np.ndarray, grade: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ROW_KEY, id, expected_grade, tail_probability (of `grade` or better), kept."""
    rows = keyed(docs, id=doc_id, text=text)
    shared = rows.sparkSession.sparkContext.broadcast((weights, cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c = shared.value
        for whole in batches:
            for batch in slices(whole, 3, PIECE):
                s = scores(w, *features(as_bytes(batch.column(3))))
                tail = _sigmoid(s[:, None] - c[None, :])
                cols = [pa.array(tail.sum(axis=1)), pa.array(tail[:, grade - 1]), pa.array(tail[:, grade - 1] >= 0.5)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=[*ROW_KEY, "id", "expected_grade", "tail_probability", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"{ROW_KEY[0]} long, {ROW_KEY[1]} long, id {kind}, expected_grade double, tail_probability double, kept boolean")


def grade_of(quality: Column, toxic: Column) -> Column:
    """Toxic, of low quality, good: 0, 1, 2."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's score by a model of the labels (doc_id, quality, toxic); good documents are kept."""
    ratings = labels.select(F.col("doc_id").alias("id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return score(docs, *train(docs, ratings, 3, doc_id=doc_id, text=text), grade=2, doc_id=doc_id, text=text)


def select_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs that are kept; all columns."""
    docs = scanned(docs)
    gone = classify(docs, labels, doc_id, text).where("not kept").select(*ROW_KEY)
    return without(docs, gone)
