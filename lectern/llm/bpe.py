"""Byte-level BPE encoding and decoding in two tiers.

A pre-token that is itself a vocabulary entry is found by a minimal perfect hash over the vocabulary; any other one is
merged by a heap of candidate pairs over a doubly linked list of its bytes, O(n log n) in its length. Pre-tokens repeat,
so each worker keeps a bounded memo of short ones.

Null text counts as empty and gives no ids; lone or repeated rows, empty tables and extra columns make no difference:
every input row gives one output row. Only the vocabulary is broadcast, whose size does not depend on the input.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from lectern.llm.common import as_bytes, slices

#: Texts of more characters than this are split and encoded piece by piece.
LONG_TEXT = 1 << 20
#: Pre-tokens remembered by a worker, and the longest one that is.
MEMO, MEMO_BYTES = 500_000, 64


def load_ranks(path: str) -> list[bytes]:
    """The entries of a tiktoken rank file, by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash by hash and displace: n keys to the numbers below n, each number once."""

    def __init__(self, keys: list[bytes], load: int = 2):
        self.n = n = len(keys)
        self.buckets = max(1, n // load)
        self.shift = [0] * self.buckets
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        taken = bytearray(n)
        self.slot_key = [-1] * n
        free = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            group = members[b]
            if not group:
                break
            if len(group) == 1:  # whatever slot is left, stored as a negative displacement
                while taken[free]:
                    free += 1
                slots, self.shift[b] = [free], -free - 1
            else:
                d = 0
                while True:
                    slots = [self._slot(hashes[i], d) for i in group]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for s, i in zip(slots, group):
                taken[s], self.slot_key[s] = 1, i

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 32 & 0xFFFFFFFF) + d * (h >> 64 | 1)) % self.n

    def find(self, key: bytes) -> int:
        """The place of a key; of other strings, that of some key."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slot_key[-d - 1 if d < 0 else self._slot(h, d)]


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of all adjacent pairs the one with the lowest rank is merged, the leftmost on ties, until none has a rank."""
    n = len(piece)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if stop[i] < 0 or (j := after[i]) >= n or stop[j] != end:
            continue  # one of the two is gone or has grown
        stop[i], stop[j] = end, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : stop[k]])) is not None:
                heapq.heappush(heap, (r, i, stop[k]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder over one vocabulary and pre-token pattern."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary, self.pattern = vocabulary, pattern
        self.hash = PerfectHash(vocabulary)
        self._prepare()

    def _prepare(self) -> None:
        self.split = regex.compile(self.pattern)
        self.ranks = {t: i for i, t in enumerate(self.vocabulary)}
        self.digits = [str(i) for i in range(len(self.vocabulary))]
        self.memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "pattern": self.pattern, "hash": self.hash}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def pre_token(self, token: str) -> tuple[int, ...]:
        piece = token.encode("utf-8")
        i = self.hash.find(piece)
        ids = (i,) if self.vocabulary[i] == piece else tuple(heap_merge(piece, self.ranks))
        if len(piece) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = ids
        return ids

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in one list or, of a long text, several."""
        if len(text) <= LONG_TEXT:
            groups = [self.split.findall(text)]
        else:
            found = (m[0] for m in self.split.finditer(text))
            groups = iter(lambda: list(islice(found, 100_000)), [])
        memo, new = self.memo, self.pre_token
        for tokens in groups:
            yield list(chain.from_iterable([memo.get(t) or new(t) for t in tokens]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def digest(codec: Codec, text: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes."""
    count, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for ids in codec.encode(text):
        if ids:
            listed.update((("," if count else "") + ",".join(map(codec.digits.__getitem__, ids))).encode())
            decoded.update(codec.decode(ids))
            count += len(ids)
    return count, listed.hexdigest(), decoded.hexdigest()


def make_codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def encode(docs: DataFrame, codec: Codec, text: str = "text", into: str = "token_ids") -> DataFrame:
    """docs with one more column, the ids of its text (an array of int; empty for null or empty text). An own column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    docs = docs.drop(into)
    at, schema = docs.columns.index(text), docs.selectExpr("*", f"cast(null as array<int>) as `{into}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, at):
                ids = [list(chain.from_iterable(own.encode(x.decode("utf-8", "replace")))) for x in as_bytes(batch.column(at))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, codec: Codec, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """docs with one more column, the bytes that its ids stand for; null ids give empty bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    docs = docs.drop(into)
    at, schema = docs.columns.index(ids), docs.selectExpr("*", f"cast(null as binary) as `{into}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [own.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its number of ids and the digests of its ids and of what they decode to, without keeping the ids themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, 1):
                rows = [digest(own, x.decode("utf-8", "replace")) for x in as_bytes(batch.column(1))]
                n, ids, back = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its ids, their number, and the digests of these ids and of what they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    names = ["doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                rows = []
                for x in as_bytes(batch.column(1)):
                    parts, listed, decoded = [], hashlib.sha256(), hashlib.sha256()
                    for ids in own.encode(x.decode("utf-8", "replace")):
                        if ids:
                            listed.update((("," if parts else "") + ",".join(map(own.digits.__getitem__, ids))).encode())
                            decoded.update(own.decode(ids))
                            parts.append(np.array(ids, dtype=np.int32))
                    rows.append((np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), listed.hexdigest(), decoded.hexdigest()))
                ids, listed, decoded = zip(*rows)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), lists, pa.array(listed), pa.array(decoded)], names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string")
