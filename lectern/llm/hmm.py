"""A hidden Markov language model trained by Baum-Welch over all partitions, and exact scores by the scaled forward recursion.

Tokens are words and one end of text. A state emits a class, and a class a word. The OWN most frequent words are classes of
their own; other words share BUCKETS classes by their first and last two bytes, so that endings and beginnings, which tell
languages apart, still say something about the state. In such a class a word has the probability (c+1)/(C+V+1), where c counts the word,
C all words and V the distinct words of the class, all in training text; all unknown words of a class together have 1/(C+V+1).
So the probability of a text is a product of that of its classes, summed exactly over all state sequences, and of its words'.

Every training token is read in every pass. Each task sums its expected counts, one row for each class that it has seen, and
these rows are added in a shuffle; what reaches the driver and is broadcast is (OWN+BUCKETS+1) x STATES numbers, whatever the input.
Expected counts and scores are over whole texts; of a long one, pieces hand their forward and backward values on, which bounds the memory and changes
nothing. Exact counts of words cannot all be broadcast: the TIER most frequent ones are, ties in order of a hash, and the other words of a text meet their
counts in a shuffle, where no key is frequent any more. Words of more than LONG_WORD bytes are known by a digest with their first and last two bytes, so they are
words like any others, however long.

Null text counts as empty and has the end as its only token; a null id counts as the empty string where the held-out part is chosen. Repeated rows are
scored, and if in the training part counted, each. Without training texts every count is zero. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW_KEY, as_bytes, keyed, slices, stored, word_runs

STATES, PASSES = 8, 6
#: The E-step takes texts of up to WHOLE tokens as they are, GROUP_TOKENS at a time; longer ones in pieces of SEGMENT tokens, GROUP of them at a time.
WHOLE, GROUP_TOKENS, SEGMENT, GROUP = 2_048, 524_288, 512, 1_024
OWN, BUCKETS, TIER, LONG_WORD = 16_384, 4_096, 131_072, 64
#: The end of a text among words, and its class.
END, END_CLASS = b"", 0
CLASSES = 1 + OWN + BUCKETS
#: Pseudo-tokens by which a state's emissions lean on the overall distribution, and a state's successors on all states.
LEAN, LEAN_NEXT = 200.0, 1.0
FOLDS, HELD_OUT = 7, 2
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Cells of a hash in which the words of one bin of counts are told apart.
CELL_BITS = 12


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def bucket(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[:2] + b"|" + word[-2:]) % BUCKETS


def bucket_of(word: Column) -> Column:
    """bucket() of a column of words."""
    ends = F.concat(F.substring(word, 1, 2), F.lit(bytearray(b"|")), F.substring(word, -2, 2))
    return (F.crc32(ends) % BUCKETS + 1 + OWN).cast("int")


def runs(text: bytes) -> Iterator[list[bytes]]:
    """word_runs() with words of more than LONG_WORD bytes by their digests; 0xff stands in no UTF-8 text."""
    for part in word_runs(text):
        if max(map(len, part)) > LONG_WORD:
            part = [w if len(w) <= LONG_WORD else w[:2] + b"\xff" + hashlib.blake2b(w, digest_size=16).digest() + w[-2:] for w in part]
        yield part


def count_words(texts: DataFrame) -> DataFrame:
    """word, c: exact counts over one text column, with the end of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for whole in batches:
            for batch in slices(whole, 0):
                for text in as_bytes(batch.column(0)):
                    seen[END] += 1
                    for part in runs(text):
                        seen.update(part)
                    if len(seen) > COUNTED:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_bin(c: Column) -> Column:
    """Counts in bins of a thirty-second of a power of two, in order."""
    return F.floor(F.log2(c) * 32)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """`most` words at most, the most frequent ones: whole bins of counts, and of the bin that does not fit the words with the smallest hashes.
    Both cuts come from histograms, so no task and no driver sorts words."""
    binned = counts.withColumns({"bin": count_bin(F.col("c")), "cell": F.shiftrightunsigned(F.xxhash64("word"), 64 - CELL_BITS)})
    left, split = most, None
    for r in sorted(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.bin):  # 64 x 32 rows at most
        if r.n > left:
            split = r.bin
            break
        left -= r.n
    if split is None:
        return counts
    stop = 0
    for r in sorted(binned.where(F.col("bin") == split).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.cell):  # 2 ** CELL_BITS rows at most
        if r.n > left:
            break
        left, stop = left - r.n, r.cell + 1
    return binned.where((F.col("bin") > split) | ((F.col("bin") == split) & (F.col("cell") < stop))).select(*counts.columns)


class Tier:
    """Counts and classes of the most frequent words."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words, self.counts = words, counts
        self._prepare()

    def _prepare(self) -> None:
        self.place = {w: i for i, w in enumerate(self.words)}
        own = {w: 1 + i for i, w in enumerate(self.words[:OWN])}
        self.classes = np.array([own[w] if w in own else bucket(w) for w in self.words] + [0], dtype=np.int16)
        self.log = np.log10(np.array(self.counts + [0], dtype=np.float64) + 1)

    def __getstate__(self):
        return {"words": self.words, "counts": self.counts}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def encode(self, text: bytes) -> tuple[np.ndarray, int, float, float, Counter]:
        """Classes of a text's words, words that are known to the tier, sum of log10(c+1) over these, the same of those in shared classes, and the other words."""
        classes, known, total, shared, other = [], 0, 0.0, 0.0, Counter()
        for part in runs(text):
            at = np.fromiter(map(self.place.get, part, repeat(-1)), dtype=np.int32, count=len(part))
            own = self.classes[at]
            logs = self.log[at]
            gone = np.flatnonzero(at < 0)
            if len(gone):
                missing = [part[i] for i in gone.tolist()]
                own[gone] = [bucket(w) for w in missing]
                other.update(missing)
            known += len(part) - len(gone)
            total += float(logs.sum())
            shared += float(logs[own > OWN].sum())
            classes.append(own)
        return np.concatenate(classes) if classes else np.zeros(0, dtype=np.int16), known, total, shared, other


class Model:
    """Start, transition and class-emission probabilities; scale: what a class's emission is divided by for a word of it."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray, scale: np.ndarray):
        self.start, self.step, self.emit, self.scale = start, step, emit, scale

    @classmethod
    def begin(cls, unigram: np.ndarray, scale: np.ndarray, names: list[bytes]) -> Model:
        """States that differ by chance, but alike for classes with the same ending."""
        noise = np.empty((CLASSES, STATES))
        endings: dict[bytes, np.ndarray] = {}
        own = np.random.default_rng(11).normal(size=(CLASSES, STATES))
        for c in range(CLASSES):
            tail = names[c - 1][-2:] if 0 < c <= len(names) else b"#%d" % c
            if tail not in endings:
                endings[tail] = np.random.default_rng(zlib.crc32(tail)).normal(size=STATES)
            noise[c] = endings[tail] + 0.5 * own[c]
        emit = unigram[:, None] * np.exp(noise)
        emit[END_CLASS] = unigram[END_CLASS]
        step = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
        np.fill_diagonal(step, 0.9)
        return cls(np.full(STATES, 1 / STATES), step, emit / emit.sum(axis=0), scale)

    def update(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        """The M-step."""
        start = (start + LEAN_NEXT) / (start + LEAN_NEXT).sum()
        step = (step + LEAN_NEXT) / (step + LEAN_NEXT).sum(axis=1, keepdims=True)
        emit = (emit + LEAN * unigram[:, None]) / (emit.sum(axis=0) + LEAN)
        return Model(start, step, emit, self.scale)


def _ragged(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, in order of falling length, by time and then piece: observations, how many are there at each time, and where each time begins."""
    length = np.array([len(p) for p in pieces])
    most = int(length[0])
    padded = np.zeros((most, len(pieces)), dtype=np.int16)
    for i, p in enumerate(pieces):
        padded[: len(p), i] = p
    active = np.searchsorted(-length, -np.arange(most), side="left")
    return padded[np.arange(most)[:, None] < length[None, :]], active, np.r_[0, np.cumsum(active)]


def transfers(model: Model, pieces: list[np.ndarray]) -> np.ndarray:
    """Of each piece the matrix, up to a factor, that takes what states are likely before its first token to what they are after its last. Pieces in order of falling length."""
    obs, active, first = _ragged(pieces)
    step = model.step.astype(np.float32)
    e = model.emit.astype(np.float32)[obs]
    e /= e.max(axis=1, keepdims=True)
    out = np.zeros((len(pieces), STATES, STATES), dtype=np.float32)
    v = np.eye(STATES, dtype=np.float32)[None] * e[: len(pieces), None, :]
    for t, m in enumerate(active.tolist()):
        if t:
            v = v[:m].reshape(-1, STATES) @ step
            v = v.reshape(m, STATES, STATES)
            v *= e[first[t] : first[t + 1], None, :]
            if t % 8 == 0:  # often enough that nothing gets too small
                v /= v.sum(axis=(1, 2), keepdims=True)
        done = active[t + 1] if t + 1 < len(active) else 0
        if done < m:
            out[done:m] = v[done:m] / v[done:m].sum(axis=(1, 2), keepdims=True)
    return out


def expected(model: Model, pieces: list[np.ndarray], before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The E-step over pieces, in order of falling length: expected starts, transitions and emissions.

    before: for each piece the forward values at the token ahead of it, or zeros where a text starts; after: up to a factor, the backward values at its last token.
    Without them every piece is a text.
    """
    obs, active, first = _ragged(pieces)
    n, most = len(pieces), len(active)
    step = model.step.astype(np.float32)
    e = model.emit.astype(np.float32)[obs]
    gamma = np.empty_like(e)  # first the forward values
    start = np.broadcast_to(model.start.astype(np.float32), (n, STATES))
    starts = np.ones(n, dtype=bool)
    if before is not None:
        starts = ~before.any(axis=1)
        start = np.where(starts[:, None], start, before @ step)
    a = start
    for t, m in enumerate(active.tolist()):
        lo, hi = first[t], first[t + 1]
        a = a * e[lo:hi] if t == 0 else (a[:m] @ step) * e[lo:hi]
        z = a.sum(axis=1, keepdims=True)
        a /= z
        gamma[lo:hi] = a
        e[lo:hi] /= z  # scaled, as the backward values need it
    moves = np.zeros((STATES, STATES), dtype=np.float64)
    beta = np.ones((n, STATES), dtype=np.float32)
    if after is not None:
        last = first[np.array([len(p) for p in pieces]) - 1] + np.arange(n)
        beta = (after / (gamma[last] * after).sum(axis=1, keepdims=True)).astype(np.float32)
        gamma[last] *= beta
    back = np.ascontiguousarray(step.T)
    for t in range(most - 2, -1, -1):
        m = active[t + 1]
        lo = first[t]
        right = beta[:m] * e[first[t + 1] : first[t + 2]]
        moves += gamma[lo : lo + m].T @ right
        beta[:m] = right @ back
        gamma[lo : lo + m] *= beta[:m]
    if before is not None:
        moves += before.T @ (beta * e[:n])
    moves *= model.step
    counts = np.stack([np.bincount(obs, weights=gamma[:, j], minlength=CLASSES) for j in range(STATES)], axis=1)
    return gamma[:n][starts].sum(axis=0, dtype=np.float64), moves, counts


def expected_of_long(model: Model, texts: list[np.ndarray]) -> list[tuple]:
    """Parts of expected() of texts in pieces of SEGMENT tokens that hand their forward and backward values on: the same sums, in memory that a run of pieces bounds."""
    places = [(i, k) for i, x in enumerate(texts) for k in range(0, len(x), SEGMENT)]
    places.sort(key=lambda p: -min(SEGMENT, len(texts[p[0]]) - p[1]))
    pieces = [texts[i][k : k + SEGMENT] for i, k in places]
    at = {p: j for j, p in enumerate(places)}
    through = np.concatenate([transfers(model, pieces[j : j + GROUP]) for j in range(0, len(pieces), GROUP)]).astype(np.float64)
    before, after = np.zeros((len(pieces), STATES)), np.ones((len(pieces), STATES))
    for i, text in enumerate(texts):
        own = [at[i, k] for k in range(0, len(text), SEGMENT)]
        x = model.start
        for j, then in zip(own, own[1:]):
            x = x @ through[j]
            before[then] = x = x / x.sum()
            x = x @ model.step
        for j, then in zip(own[-2::-1], own[:0:-1]):
            x = model.step @ (through[then] @ after[then])
            after[j] = x / x.sum()
    return [expected(model, pieces[j : j + GROUP], before[j : j + GROUP].astype(np.float32), after[j : j + GROUP]) for j in range(0, len(pieces), GROUP)]


def expected_sums(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """expected() of any texts: whole up to WHOLE tokens, GROUP_TOKENS at a time, in pieces beyond."""
    parts = [(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)))]
    if long := [x for x in texts if len(x) > WHOLE]:
        parts += expected_of_long(model, long)
    group, size = [], 0
    for x in sorted((x for x in texts if 0 < len(x) <= WHOLE), key=len, reverse=True):
        if group and size + len(x) > GROUP_TOKENS:
            parts.append(expected(model, group))
            group, size = [], 0
        group.append(x)
        size += len(x)
    if group:
        parts.append(expected(model, group))
    return _sum(parts)


def _sum(parts: list[tuple]) -> tuple:
    return tuple(sum(x) for x in zip(*parts))


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each class sequence's probability, words' scales included, exactly over all state sequences."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    length = np.array([len(texts[i]) for i in order])
    out = np.zeros(len(texts))
    if not len(texts):
        return out
    flat = np.concatenate([texts[i] for i in order]) if length.sum() else np.zeros(0, dtype=np.int16)
    first = np.cumsum(length) - length
    emit = model.emit / model.scale[:, None]
    total = np.zeros(len(texts))
    a = None
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    for t, m in enumerate(active.tolist()):
        e = emit[flat[first[:m] + t]]
        a = model.start * e if a is None else (a[:m] @ model.step) * e
        z = a.sum(axis=1)
        a /= z[:, None]
        total[:m] += np.log10(z)
    out[order] = total
    return out


def _train(encoded: DataFrame, model: Model, unigram: np.ndarray, passes: int) -> Model:
    spark = encoded.sparkSession
    rows = encoded.where("not held_out").select("classes")
    names = [f"s{j}" for j in range(STATES)]
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            start, moves, counts = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
            for whole in batches:
                for batch in slices(whole, 0, 8 << 20):
                    s, m, c = expected_sums(own, [np.frombuffer(raw, dtype=np.int16) for raw in batch.column(0).to_pylist()])
                    start, moves, counts = start + s, moves + m, counts + c
            seen = np.flatnonzero(counts.any(axis=1))
            keys = np.r_[seen, -1, -2 - np.arange(STATES)]
            table = np.concatenate([counts[seen], start[None], moves])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(table[:, j]) for j in range(STATES))], names=["key", *names])

        sums = rows.mapInArrow(run, "key int, " + ", ".join(f"{x} double" for x in names)).groupBy("key").agg(*(F.sum(x).alias(x) for x in names))
        start, moves, counts = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
        for r in sums.collect():  # CLASSES + STATES + 1 rows at most
            if r.key >= 0:
                counts[r.key] = r[1:]
            elif r.key == -1:
                start[:] = r[1:]
            else:
                moves[-2 - r.key] = r[1:]
        model = model.update(start, moves, counts, unigram)
        shared.unpersist()
    return model


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """One row per input row: ROW_KEY, id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = keyed(docs, id=doc_id, text=text).select(*ROW_KEY, "id", (fold(F.col("id")) == HELD_OUT).alias("held_out"), "text")
    counts = stored(count_words(rows.where("not held_out").select("text")))
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    is_end = F.col("word") == F.lit(bytearray(END))
    ends = counts.where(is_end).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top = most_frequent(counts.where(~is_end), TIER).collect()  # TIER rows of LONG_WORD bytes at most
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    tier = Tier([bytes(r.word) for r in top], [r.c for r in top])
    names = tier.words[:OWN]
    own = spark.createDataFrame([(bytearray(w),) for w in names], "word binary")
    others = counts.where(~is_end).join(F.broadcast(own), "word", "left_anti")  # OWN rows are broadcast
    mass, scale = np.zeros(CLASSES), np.ones(CLASSES)
    mass[END_CLASS] = ends
    mass[1 : 1 + len(names)] = tier.counts[: len(names)]
    for r in others.groupBy(bucket_of(F.col("word")).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # BUCKETS rows at most
        mass[r.b], scale[r.b] = r.c, r.c + r.v + 1
    unigram = (mass + 1) / (mass + 1).sum()
    shared = spark.sparkContext.broadcast(tier)
    kind = rows.schema["id"].dataType.simpleString()
    log_end, end_known = float(np.log10(ends + 1)), int(ends > 0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        end = np.array([END_CLASS], dtype=np.int16)
        for whole in batches:
            for batch in slices(whole, 4):
                out = [[] for _ in range(7)]
                for raw in as_bytes(batch.column(4)):
                    classes, known, total, part, other = own.encode(raw)
                    row = (np.r_[classes, end].tobytes(), len(classes) + 1, known + end_known, total + log_end, part, list(other), list(other.values()))
                    for column, x in zip(out, row):
                        column.append(x)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, t) for c, t in zip(out, kinds))], names=[*ROW_KEY, "id", "held_out", "classes", "n_tokens", "known", "total", "part", "words", "times"])

    key = f"{ROW_KEY[0]} long, {ROW_KEY[1]} long"
    encoded = stored(rows.mapInArrow(encode, f"{key}, id {kind}, held_out boolean, classes binary, n_tokens long, known long, total double, part double, words array<binary>, times array<long>"))
    model = _train(encoded, Model.begin(unigram, scale, names), unigram, passes)
    rare = encoded.where(F.size("words") > 0).select(*ROW_KEY, F.explode(F.arrays_zip("words", "times")).alias("x")).select(*ROW_KEY, F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word").groupBy(*ROW_KEY).agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("more_known"))
    trained = spark.sparkContext.broadcast(model)

    def recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trained.value
        for whole in batches:
            for batch in slices(whole, 4, 4 << 20):
                found = forward(own, [np.frombuffer(x, dtype=np.int16) for x in batch.column(4).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *batch.columns[5:], pa.array(found)], names=[*ROW_KEY, "id", "held_out", "n_tokens", "known", "total", "part", "log"])

    found = encoded.select(*ROW_KEY, "id", "held_out", "classes", "n_tokens", "known", "total", "part")
    found = found.mapInArrow(recur, f"{key}, id {kind}, held_out boolean, n_tokens long, known long, total double, part double, log double")
    found = found.join(rare, [*ROW_KEY], "left")
    more = F.coalesce("more", F.lit(0.0))
    return found.select(
        *ROW_KEY, "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("total") + more - F.col("n_tokens") * F.log10(F.lit(float(tokens + kinds + 1)))).alias("base_score"), (F.col("log") + F.col("part") + more).alias("score"),
    )
