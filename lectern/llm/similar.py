"""Near copies: texts whose sets of ordered five-word shingles have a Jaccard similarity of 0.8 or more, none left out.

The sets are fingerprinted by SimHash, and the inverted index over byte positions with its count filter (simhash.py) proposes pairs of equal and of linked
fingerprints. Those whose whole sets are similar enough are links. They are not all: 64 bits of two texts at 0.8 differ in about ten, and no positional byte
is then sure to be equal. So an exact check follows that finds what fingerprints cannot, a set join with prefixes among texts that are not linked yet.
All shingles have one order, those frequent in a sample of documents last, the others by hash. Of two sets of which
one shares ceil(0.8 n) of its n members with the other, the first n - ceil(0.8 n) + 1 of both hold a common one; so each text is listed
under the first of its shingles only, and texts under one shingle are candidates if their sizes allow 0.8. The order does not change what is found.

Texts with equal sets count once. Lists of up to SHORT texts give all their pairs. In a longer one that is not one component yet the texts of different components meet in
the task, where sketches of the sets rule nearly all dissimilar pairs out, and none else. Of the others a spanning forest leaves the task, the likeliest
pair wherever it joins two components, then forests by other pairs as long as they turn out to be links. At last all pairs that sketches leave between
components are verified, so no link is lost, and a group of near copies costs a few pairs for each of its texts and list.
Candidates are verified on the whole sets, and components are found on tables.

Shingles and sets are known by 64-bit hashes. Null text counts as empty; texts without words are near copies of each other. Null ids come after
all others. Repeated rows are rows of their own. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW_KEY, as_bytes, few, keyed, scanned, scratch, shingles, shuffle_parts, slices, stored, without
from lectern.llm.graph import components
from lectern.llm.simhash import links, majorities, settled

SHINGLE, SEED = 5, 42
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Documents of the sample that tells which shingles are frequent, how often such a one is there, and how many are sent to all tasks.
SAMPLE, OFTEN, FREQUENT = 32_768, 3, 65_536
#: Texts in a list that meet pair by pair.
SHORT = 8
#: Cells of a sketch for each member of its set, at least, and cells at most.
CELLS, MOST_CELLS = 4, 16_384


def hashes(text: bytes) -> np.ndarray:
    """The set of a text's shingles as sorted hashes."""
    found = [np.fromiter(map(xxhash.xxh64_intdigest, run, repeat(SEED)), dtype=np.uint64, count=len(run)) for run in shingles(text, SHINGLE)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def name(own: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh64_digest(own.tobytes(), SEED)[::-1], dtype=np.int64)[0])


def prefix(own: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles under which a set is listed; often: frequent hashes, sorted, with their ranks."""
    n = len(own)
    if not n:
        return own
    ranks = np.zeros(n, dtype=np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        ranks = np.where(often[at] == own, rank[at], 0)
    return own[np.lexsort((own, ranks))[: n - -(-OVER * n // UNDER) + 1]]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> bytes:
    """Whether an odd number of the set's members falls into each of a power of two of cells, CELLS for each member at least. The cells in which two sketches
    differ are no more than the members that only one of the sets has, and hardly fewer."""
    cells = min(max(64, CELLS << max(0, len(own) - 1).bit_length()), MOST_CELLS)
    odd = np.bincount((own >> np.uint64(32)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _halved(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of words) with fewer cells: those of the same sets."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


class Sketches:
    """The sketches of a list's texts, by length."""

    def __init__(self, sketches: np.ndarray, sizes: np.ndarray):
        words = [np.frombuffer(x, dtype=np.uint64) for x in sketches]
        self.sizes, self.length, self.place, self.rows = sizes, np.array([len(x) for x in words]), np.zeros(len(words), dtype=np.int64), {}
        for n in np.unique(self.length):
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            self.rows[int(n)] = np.stack([words[i] for i in at])

    def room(self, one: int, others: np.ndarray) -> np.ndarray:
        """How far texts are from what their sketches rule out; below zero their sets cannot be similar enough."""
        out = np.zeros(len(others), dtype=np.int64)
        own = self.rows[int(self.length[one])][self.place[one]][None]
        length = self.length[others]
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            words = min(int(n), own.shape[1])
            apart = np.bitwise_count(_halved(self.rows[int(n)][self.place[others[at]]], words) ^ _halved(own, words)).sum(axis=1, dtype=np.int64)
            out[at] = (UNDER - OVER) * (self.sizes[others[at]] + self.sizes[one]) - (UNDER + OVER) * apart
        return out


def fits(x, y) -> np.ndarray:
    """Pairs whose sizes allow the similarity."""
    return UNDER * np.minimum(x, y) >= OVER * np.maximum(x, y)


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    step = max(1, -(-rows.count() // SAMPLE))
    sample = rows.where(F.pmod(F.xxhash64(*ROW_KEY), F.lit(step)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                own = np.concatenate([np.zeros(0, dtype=np.uint64), *map(hashes, as_bytes(batch.column(0)))])
                h, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    often, rank = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    by = np.argsort(often)
    return often[by], rank[by]


def _lists(rows: DataFrame, columns: str, work) -> DataFrame:
    """rows (key first) by key; work(whole lists of columns, starts of the lists) gives a batch."""
    rows = rows.repartition(shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(parts):
            cols = [np.concatenate(c) for c in zip(*parts)]
            return work(cols, np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]))

        held: list[list[np.ndarray]] = []  # of the last list, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut or (held and held[0][0][0] != cols[0][-1]):
                yield give([*held, [c[:cut] for c in cols]])
                held = []
            held.append([c[cut:].copy() for c in cols])
        if held:
            yield give(held)

    return rows.mapInArrow(run, columns)


def _first_pairs(cols: list[np.ndarray], starts: np.ndarray, short: int) -> pa.RecordBatch:
    """Pairs a, b of short lists; members of longer ones with b missing."""
    keys, nodes, sizes = cols
    ends = np.r_[starts[1:], len(keys)]
    n = ends - starts
    a, b = [], []
    for k in range(2, short + 1):
        at = starts[n == k]
        for i in range(k):
            for j in range(i + 1, k):
                ok = fits(sizes[at + i], sizes[at + j])
                a.append(nodes[at + i][ok])
                b.append(nodes[at + j][ok])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), dtype=np.int64)
    rest = np.repeat(n > short, n)
    none = np.zeros(int(rest.sum()), dtype=np.int64)
    missing = np.r_[np.zeros(len(pairs), dtype=bool), np.ones(len(none), dtype=bool)]
    out = [pa.array(np.r_[np.zeros(len(pairs), dtype=np.int64), keys[rest]]), pa.array(np.r_[pairs[:, 0], nodes[rest]]), pa.array(np.r_[pairs[:, 1], none], mask=missing), pa.array(np.r_[np.zeros(len(pairs), dtype=np.int64), sizes[rest]])]
    return pa.RecordBatch.from_arrays(out, names=["key", "a", "b", "size"])


def _more_pairs(cols: list[np.ndarray], starts: np.ndarray, forest: int | None) -> pa.RecordBatch:
    """Pairs a, b of different components (roots) in lists that may be similar enough: all, or a forest of them, the likeliest in forest 0 and any in the others."""
    keys, nodes, sizes, roots, sketches = cols
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for s, e in zip(starts, np.r_[starts[1:], len(nodes)]):
        at = np.random.default_rng([forest, int(keys[s]) & 0xFFFFFFFF]).permutation(np.arange(s, e)) if forest else np.arange(s, e)
        part = np.unique(roots[at], return_inverse=True)[1]
        own, n, drawn = nodes[at], sizes[at], Sketches(sketches[at], sizes[at])
        for c in range(len(own) - 1):
            ok = c + 1 + np.flatnonzero(fits(n[c + 1 :], n[c]) & (part[c + 1 :] != part[c]))
            room = drawn.room(c, ok)
            ok, room = ok[room >= 0], room[room >= 0]
            if forest is not None and len(ok):
                if not forest:
                    ok = ok[np.argsort(-room, kind="stable")]
                joined, first = np.unique(part[ok], return_index=True)
                ok = ok[first]
                part[np.isin(part, joined)] = part[c]
            b.append(own[ok])
            a.append(np.full(len(ok), own[c]))
    pairs = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _proposed(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of sets with equal fingerprints or with fingerprints that the index links. nodes: fp and print."""
    reps = stored(nodes.groupBy("print").agg(F.min("fp").alias("rep")))
    equal = nodes.join(reps, "print").where("fp <> rep").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    near = links(reps, "print")
    near = near.join(reps.select(F.col("print").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("print").alias("b"), F.col("rep").alias("y")), "b")
    return equal.union(near.select("x", "y")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs a, b that are in different components."""
    for k in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"of_{k}")), k, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b that sizes and sketches do not rule out, so that no sets are made of the others' texts. nodes: fp, size and sketch."""
    for k in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("fp").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")), k)
    pairs = pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches = np.stack([batch.column(i).to_numpy() for i in (2, 3)], axis=1), zip(*(batch.column(i).to_pylist() for i in (4, 5)))
            ok = [Sketches(two, n).room(0, np.array([1]))[0] >= 0 for two, n in zip(sketches, sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are similar enough, stored. nodes: fp and its first row; docs: ROW_KEY and text."""
    with scratch(docs.sparkSession) as lasting:
        return lasting(_similar(pairs, nodes, docs))


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    needed = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    at = few(nodes.join(needed, "fp").select("fp", *(F.col("first")[k].alias(k) for k in ROW_KEY)))
    texts = docs.join(at, [*ROW_KEY]).select("fp", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes(x).tobytes() for x in as_bytes(batch.column(1))], pa.binary())], names=["fp", "own"])

    own = stored(texts.mapInArrow(sets, "fp long, own binary"))
    both = pairs.join(own.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b").join(own.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [alike(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", short: int = SHORT) -> DataFrame:
    """One row per input row: ROW_KEY, id, fp (the name of its set), component_id, best (true for the row that stays)."""
    with scratch(docs.sparkSession) as lasting:
        return lasting(_groups(keyed(docs, id=doc_id, text=text), short))


def _listed(docs: DataFrame, kind: str) -> DataFrame:
    """Per row of docs (ROW_KEY, id, text) its set's name, size, first shingles, sketch and fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                own = [hashes(x) for x in as_bytes(batch.column(3))]
                keys = [prefix(x, *shared.value).view(np.int64) for x in own]
                sizes = [len(x) for x in own]
                cols = [pa.array([name(x) for x in own], pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(map(sketch, own), pa.binary()), pa.array(majorities(own, sizes).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=[*ROW_KEY, "id", "fp", "size", "keys", "sketch", "print"])

    return docs.mapInArrow(run, f"{ROW_KEY[0]} long, {ROW_KEY[1]} long, id {kind}, fp long, size long, keys array<long>, sketch binary, print long")


def _groups(docs: DataFrame, short: int) -> DataFrame:
    spark = docs.sparkSession
    order = F.struct(F.col("id").isNull().alias("none"), "id", *ROW_KEY)
    with scratch(spark) as lasting:
        whole = stored(_listed(docs, docs.schema["id"].dataType.simpleString()))
        rows = lasting(whole.select(*ROW_KEY, "id", "fp"))
        nodes = lasting(whole.groupBy("fp").agg(F.min(order).alias("first"), *(F.max(k).alias(k) for k in ("size", "sketch", "print"))))  # one sketch and fingerprint for each set
        copies = few(rows.join(nodes.select("fp", "first"), "fp").where(F.struct(*ROW_KEY) != F.struct(*(F.col("first")[k].alias(k) for k in ROW_KEY))).select(*ROW_KEY))
        listed = whole.select(*ROW_KEY, "keys", "fp", "size").join(copies, [*ROW_KEY], "left_anti").select(F.explode("keys").alias("key"), "fp", "size")
        met = lasting(_lists(listed, "key long, a long, b long, size long", partial(_first_pairs, short=short)))
    roots = stored(components(_verified(stored(_proposed(nodes)), nodes, docs)))

    def linked(pairs: DataFrame) -> DataFrame | None:
        """Components with those pairs that are similar enough, if there are any."""
        if pairs.isEmpty() or (new := _verified(pairs, nodes, docs)).isEmpty():
            return None
        held = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # what is linked stays so
        return stored(components(stored(held.union(new))))

    first = stored(_apart(met.where("b is not null").select("a", "b").distinct(), roots))
    more = linked(stored(_likely(first, nodes)))
    roots = roots if more is None else more
    long = met.where("b is null").select("key", F.col("a").alias("fp"), "size")
    forest = 0
    while True:
        rooted = long.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "size", F.coalesce("root", "fp").alias("root"))
        open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        rooted = rooted.join(open_, "key", "left_semi").join(nodes.select("fp", "sketch"), "fp").select("key", "fp", "size", "root", "sketch")
        pairs = stored(_lists(rooted, "a long, b long", partial(_more_pairs, forest=forest)).distinct())
        if pairs.isEmpty():
            break
        more = linked(pairs)
        roots = roots if more is None else more
        if forest is None:
            break
        forest = forest + 1 if more is not None or not forest else None
    return settled(rows, nodes.select("fp", "first"), roots)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that with its smallest id; all columns."""
    docs = scanned(docs)
    gone = near_groups(docs, doc_id, text).where("not best").select(*ROW_KEY)
    return without(docs, few(gone))
