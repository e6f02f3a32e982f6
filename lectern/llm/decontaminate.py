"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at seven chosen places of a window; the other places are ignored, so a substitution there does
no harm. MASKS is a fixed set such that any window of 13 words with up to two substitutions holds a seed that avoids them, so
every overlap of 13 words of which 11 agree gives a hit. Hits of training seeds on test seeds are grouped by diagonal, the overlap
along the diagonal is rated by windows of 13 words of which 11 must agree, and the words themselves are compared at the end.
An item of fewer than 13 words is one seed, all of its words, and must occur whole.

Where a seed repeats both in a text and in an item (runs of one word), the two are compared along all their diagonals, CELLS words at a time, so time is the
product of their lengths at most and memory is bounded.

The test set is taken in blocks of BLOCK_WORDS words or one item: one block is broadcast at a time and every document is
read against it; all but the last are written before the next is sent, so what is broadcast has a bound whatever the test set's size.

Null or empty texts and items have no overlaps. Equal items are reported each. Repeated documents give a row each for
every item. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW_KEY, as_bytes, keyed, scanned, slices, stored, without, words
from lectern.llm.tokens import hash_words, mix

WINDOW, AGREE = 13, 11
#: Fixed sets of places. For any two places of a window of 13, one of these masks fits somewhere in the window without them.
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 4, 6, 7, 8, 9), (0, 2, 3, 4, 7, 9, 10))
#: Words of test items that are broadcast at a time.
BLOCK_WORDS = 500_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)
_FILTER_BITS = 20
#: Hits of a batch up to which each is followed by itself, cells of texts and items that are compared at a time, and overlaps kept of each such part.
EXPANDED, CELLS, KEPT = 1 << 21, 1 << 21, 4


def seeds(h: np.ndarray, owner: np.ndarray, places: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that lie in one text: place of the first word, seed."""
    span = places[-1] + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    acc = np.full(n, len(places) * 131 + span, dtype=np.uint64)
    for i, p in enumerate(places):
        acc = acc * np.uint64(0x2545F4914F6CDD1D) + h[p : p + n] * _MULT[i % len(_MULT)]
    at = np.flatnonzero(owner[:n] == owner[span - 1 :])
    return at, mix(acc[at])


class Items:
    """A block of test items with its seeds in order."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.words = ids, [words(t) for t in texts]
        found = hash_words(texts)
        owner = found.owner()
        self.first, self.hashes = found.first, found.hashes
        size = np.diff(found.first)
        self.masks = list(MASKS) + [tuple(range(n)) for n in sorted({int(n) for n in size if 0 < n < WINDOW})]
        self.tables = []
        for m, places in enumerate(self.masks):
            at, seed = seeds(found.hashes, owner, places)
            whole = size[owner[at]]
            ok = whole >= WINDOW if m < len(MASKS) else whole == len(places)
            at, seed = at[ok], seed[ok]
            order = np.argsort(seed, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[(seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((seed[order], owner[at][order], (at - found.first[owner[at]])[order], bits))

    def hits(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows (text, item, diagonal), and rows (text, item) of which all diagonals are to be looked at because a seed repeats too often in both.
        A diagonal is the place, among all words of all texts, of the item's first word."""
        out, whole = [np.zeros((0, 3), dtype=np.int64)], [np.zeros((0, 2), dtype=np.int64)]
        for places, (table, item, offset, bits) in zip(self.masks, self.tables):
            if not len(table):
                continue
            at, seed = seeds(h, owner, places)
            maybe = bits[(seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
            at, seed = at[maybe], seed[maybe]
            lo, hi = np.searchsorted(table, seed, "left"), np.searchsorted(table, seed, "right")
            often = np.zeros(len(at), dtype=bool)
            if (hi - lo).sum() > EXPANDED:  # seeds that repeat within a text and within an item
                own = np.stack([owner[at], seed.view(np.int64)], axis=1)
                _, back, n = np.unique(own, axis=0, return_inverse=True, return_counts=True)
                often = (n[back.ravel()] > 1) & (hi - lo > 1)
                first = np.unique(back.ravel()[often], return_index=True)[1]
                which, entry = _expanded(lo[often][first], hi[often][first])
                whole.append(np.unique(np.stack([owner[at[often][first][which]], item[entry]], axis=1), axis=0))
            which, entry = _expanded(lo[~often], hi[~often])
            at = at[~often]
            out.append(np.unique(np.stack([owner[at[which]], item[entry], at[which] - offset[entry]], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0), np.unique(np.concatenate(whole), axis=0)

    def overlap(self, h: np.ndarray, start: int, end: int, item: int, diagonals: np.ndarray, word) -> tuple | None:
        """Of the overlaps of a text and an item along some diagonals that with most equal words, the first of these: first word in the text, number of words, of these equal."""
        size, base = len(self.words[item]), self.first[item]
        least, need = (WINDOW, AGREE) if size >= WINDOW else (size, size)
        ranks = []
        for i in range(0, len(diagonals), step := max(1, CELLS // size)):
            d = diagonals[i : i + step]
            at = d[:, None] + np.arange(size)
            inside = (at >= start) & (at < end)
            same = inside & (h[np.clip(at, start, end - 1)] == self.hashes[base : base + size])
            ahead = np.cumsum(same, axis=1, dtype=np.int32)
            ahead = np.concatenate([np.zeros((len(d), 1), dtype=np.int32), ahead], axis=1)
            good = (ahead[:, least:] - ahead[:, :-least] >= need) & inside[:, : size - least + 1] & inside[:, least - 1 :]
            rows = np.flatnonzero(good.any(axis=1))
            if not len(rows):
                continue
            cover = np.zeros((len(rows), size + 1), dtype=np.int32)
            cover[:, : size - least + 1] += good[rows]
            cover[:, least:] -= good[rows]
            cover = np.cumsum(cover, axis=1)[:, :-1] > 0
            equal = (cover & same[rows]).sum(axis=1)
            first = d[rows] + cover.argmax(axis=1) - start
            keep = np.lexsort((first, -equal))[:KEPT]
            ranks += zip((-equal[keep]).tolist(), first[keep].tolist(), d[rows][keep].tolist())
        for _, _, d in sorted(ranks):
            if hit := self.verified(start, end, item, d, least, need, word):
                return hit
        return None

    def verified(self, start: int, end: int, item: int, diagonal: int, least: int, need: int, word) -> tuple | None:
        """The overlap along a diagonal by the words themselves."""
        lo, hi = max(diagonal, start), min(diagonal + len(self.words[item]), end)
        same = np.array([word(i - start) == self.words[item][i - diagonal] for i in range(lo, hi)])
        good = np.flatnonzero(np.convolve(same, np.ones(least, dtype=np.int64), "valid") >= need)
        if not len(good):
            return None
        cover = np.zeros(len(same) + 1, dtype=np.int64)
        np.add.at(cover, good, 1)
        np.add.at(cover, good + least, -1)
        inside = np.flatnonzero(np.cumsum(cover)[:-1])
        return int(lo + inside[0] - start), len(inside), int(same[inside].sum())


def _expanded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in the ranges lo to hi, with the range that each is from."""
    n = hi - lo
    return np.repeat(np.arange(len(lo)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The items, in blocks of BLOCK_WORDS words or one item."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        raw = row.t.encode()
        n = len(words(raw))
        if ids and size + n > BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(raw)
        size += n
    if ids:
        yield Items(ids, texts)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document row and test item that overlap: ROW_KEY, id, item_id, first_word, n_words, n_equal, coverage (part of the item's words that are in the document)."""
    rows = keyed(docs, id=doc_id, text=text)
    kinds = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"{ROW_KEY[0]} long, {ROW_KEY[1]} long, id {kinds[0]}, item_id {kinds[1]}, first_word long, n_words long, n_equal long, coverage double"
    out, ahead = rows.sparkSession.createDataFrame([], schema), None
    for block in blocks(benchmark, item_id, item_text):
        if ahead is not None:  # that block is done with before the next one is sent
            out = out.union(stored(ahead))
            shared.unpersist()
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for whole in batches:
                for batch in slices(whole, 3, 4 << 20):
                    texts = as_bytes(batch.column(3))
                    found = hash_words(texts)
                    best: dict[tuple[int, int], tuple] = {}
                    hits, whole_pairs = items.hits(found.hashes, found.owner())
                    todo = {(d, i): None for d, i in whole_pairs.tolist()}
                    cuts = np.flatnonzero(np.any(hits[1:, :2] != hits[:-1, :2], axis=1)) + 1
                    for part in np.split(hits, cuts) if len(hits) else []:
                        todo.setdefault((int(part[0, 0]), int(part[0, 1])), part[:, 2])
                    for (d, item), diagonals in todo.items():
                        start, end = int(found.first[d]), int(found.first[d + 1])
                        if diagonals is None:
                            diagonals = np.arange(start - len(items.words[item]) + 1, end)
                        if hit := items.overlap(found.hashes, start, end, item, diagonals, lambda i, d=d: found.word(d, i)):
                            best[d, item] = hit
                    if best:
                        take = pa.array([d for d, _ in best])
                        cols = [batch.column(i).take(take) for i in range(3)]
                        cols.append(pa.array([items.ids[i] for _, i in best]))
                        hit = list(best.values())
                        cols += [pa.array([h[i] for h in hit], pa.int64()) for i in range(3)]
                        cols.append(pa.array([h[2] / len(items.words[i]) for (_, i), h in zip(best, hit)]))
                        yield pa.RecordBatch.from_arrays(cols, names=[*ROW_KEY, "id", "item_id", "first_word", "n_words", "n_equal", "coverage"])

        ahead = rows.mapInArrow(run, schema)
    return out if ahead is None else out.union(ahead)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """docs without those that overlap an item; all columns."""
    docs = scanned(docs)
    gone = overlaps(docs, benchmark, doc_id, text, **names).select(*ROW_KEY).distinct()
    return without(docs, gone)
