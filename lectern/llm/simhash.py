"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint has eight byte positions. Two fingerprints with at most three differing bits differ in at most three bytes, so
they share five positional bytes at least: that is the guaranteed minimum of the count filter. Postings of single positional
bytes would hold n/256 fingerprints each and meet n*n/64 pairs, so a posting here is a set of four positions with their
bytes. The sets are the 14 blocks of the Steiner system S(3,4,8): any three positions lie in a block, and its complement is a
block too, so whichever three bytes differ, some posting consists of equal ones. No link is lost, and a posting of random
fingerprints holds n / 2**32 of them. In each posting the shared positional bytes of a pair are tallied, pairs below
five are dropped, and the others are verified bit by bit. The tally only spares work: whatever passes the check of its bits shares five bytes.

Equal fingerprints count once: rows are first gathered to distinct fingerprints with map-side partial sums, so groups of copies
never meet. Of a posting's links only a spanning forest leaves the task, one edge to the smallest member of each linked set;
for connectivity that loses nothing, and no task emits the pairs of a group. A very full posting is searched by flipping bits,
in time linear in its members. Components are then found on tables.

Null text counts as empty; empty texts and those without words have the fingerprint zero and link like others. Null ids come after
all others, so such an id is a component's only if all are null. Repeated rows are rows of their own. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW_KEY, as_bytes, keyed, scanned, shingles, shuffle_parts, slices, stored, without
from lectern.llm.graph import components

BITS, NEAR, SHINGLE, SEED = 64, 3, 3, 42
#: Positions of a posting: the four-element sets of 0..7 with exclusive-or zero, the planes of AG(3,2).
BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
#: Members from which a posting is searched by flipping bits instead of pair by pair.
FULL = 1 << 16
_LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text, as uint64: a bit is set if it is in over half of the shingles' XXH64 values."""
    hashes, counts = [], []
    for text in texts:
        n = 0
        for run in shingles(text, SHINGLE):
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, run, repeat(SEED)), dtype=np.uint64, count=len(run)))
            n += len(run)
        counts.append(n)
    return majorities(hashes, counts)


def majorities(hashes: list[np.ndarray], counts: list[int]) -> np.ndarray:
    """The bits that are set in over half of each text's hashes; counts: how many of the hashes, in order, are each text's."""
    out = np.zeros(len(counts), dtype=np.uint64)
    if not sum(counts):
        return out
    h, n = np.concatenate(hashes), np.array(counts)
    full = np.flatnonzero(n)
    ends = np.cumsum(n[full])
    starts = ends - n[full]
    # eight counters in the bytes of a word hold up to 255, so sums are taken over runs of 255 shingles first
    per = -(-n[full] // 255)
    first = np.cumsum(per) - per
    runs = np.repeat(starts, per) + 255 * (np.arange(per.sum()) - np.repeat(first, per))
    ones = np.empty((len(full), 8, 8), dtype=np.int64)  # text, byte, bit
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, runs).view(np.uint8).reshape(-1, 8)
        ones[:, :, bit] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    set_ = (2 * ones > n[full][:, None, None]).reshape(len(full), 64)
    out[full] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shared_bytes(x: np.ndarray, y) -> np.ndarray:
    """Tally of the byte positions in which fingerprints agree."""
    d = x ^ y
    return sum(((d >> np.uint64(8 * i)) & np.uint64(255) == 0).astype(np.int8) for i in range(8))


def near(x: np.ndarray, y) -> np.ndarray:
    """Pairs that pass the count filter and then the check of their bits."""
    ok = shared_bytes(x, y) >= 8 - NEAR
    ok[ok] = np.bitwise_count((x ^ y)[ok]) <= NEAR
    return ok


def linked_sets(members: np.ndarray) -> list[np.ndarray]:
    """The connected sets, of two or more, of one posting's distinct fingerprints."""
    rest, out = np.sort(members), []
    if len(rest) <= FULL:
        while len(rest) > 1:
            found, todo, rest = [rest[:1]], [rest[0]], rest[1:]
            while todo and len(rest):
                hit = near(rest, todo.pop())
                if hit.any():
                    found.append(rest[hit])
                    todo += list(rest[hit])
                    rest = rest[~hit]
            if len(found) > 1:
                out.append(np.concatenate(found))
        return out
    free = np.bitwise_or.reduce(members ^ members[0])
    bits = [1 << i for i in range(BITS) if int(free) >> i & 1]
    flips = np.array([sum(c) for k in range(1, NEAR + 1) for c in combinations(bits, k)], dtype=np.uint64)
    seen = np.zeros(len(rest), dtype=bool)
    for start in range(len(rest)):
        if seen[start]:
            continue
        seen[start], found, todo = True, [start], [start]
        while todo:
            around = rest[todo.pop()] ^ flips
            at = np.minimum(np.searchsorted(rest, around), len(rest) - 1)
            at = np.unique(at[rest[at] == around])
            at = at[~seen[at]]
            seen[at] = True
            found += at.tolist()
            todo += at.tolist()
        if len(found) > 1:
            out.append(rest[found])
    return out


def _forest(keys: np.ndarray, prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges (member, smallest of its set as a signed number) of whole postings, given in order of their keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    two = starts[sizes == 2]
    hit = near(prints[two], prints[two + 1])
    a, b = [prints[two][hit].view(np.int64)], [prints[two + 1][hit].view(np.int64)]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
        for found in linked_sets(prints[s : s + n]):
            signed = np.sort(found.view(np.int64))
            a.append(signed[1:])
            b.append(np.full(len(signed) - 1, signed[0]))
    return a, b


def links(nodes: DataFrame, column: str = "fp") -> DataFrame:
    """Edges a, b between distinct fingerprints that connect the same sets as all links do."""
    fp = F.col(column)

    def key(i: int, block: tuple[int, ...]):
        parts = [F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(255), 8 * k) for k, p in enumerate(block)]
        whole = parts[0]
        for x in parts[1:]:
            whole = whole.bitwiseOR(x)
        return whole.bitwiseOR(F.lit(i << 32).cast("long"))

    postings = nodes.select(F.explode(F.array(*(key(i, b) for i, b in enumerate(BLOCKS)))).alias("key"), fp.alias("fp"))
    postings = postings.repartition(shuffle_parts(nodes.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_p = [], []  # of the last posting, which may go on

        def edges(keys, prints):
            a, b = _forest(keys, prints)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held_k and held_k[0][0] != keys[-1]):
                yield edges(np.concatenate([*held_k, keys[:cut]]), np.concatenate([*held_p, prints[:cut]]))
                held_k, held_p = [], []
            held_k.append(keys[cut:].copy())
            held_p.append(prints[cut:].copy())
        if held_k:
            yield edges(np.concatenate(held_k), np.concatenate(held_p))

    return postings.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ROW_KEY, id, fp (the fingerprint as a signed long), component_id, best (true for the row that stays)."""
    rows = keyed(docs, id=doc_id, text=text)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                found = fingerprints(as_bytes(batch.column(3))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], names=[*ROW_KEY, "id", "fp"])

    rows = stored(rows.mapInArrow(run, f"{ROW_KEY[0]} long, {ROW_KEY[1]} long, id {kind}, fp long"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", *ROW_KEY)
    nodes = stored(rows.groupBy("fp").agg(F.min(order).alias("first")))
    return settled(rows, nodes, stored(components(links(nodes))))


def settled(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (ROW_KEY, id, fp) with component_id and best; nodes: fp and its first row, roots: node and root."""
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    member = member.select("fp", "root", "first").unionByName(nodes.join(roots.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").select("fp", F.col("fp").alias("root"), "first"))
    firsts = member.groupBy("root").agg(F.min("first").alias("chosen"))
    moved = member.join(firsts, "root").select("fp", "chosen")
    chosen = stored(nodes.join(moved, "fp", "left").select("fp", F.coalesce("chosen", "first").alias("chosen")))
    best = (F.col("chosen")[ROW_KEY[0]] == F.col(ROW_KEY[0])) & (F.col("chosen")[ROW_KEY[1]] == F.col(ROW_KEY[1]))
    return rows.join(chosen, "fp").select(*ROW_KEY, "id", "fp", F.col("chosen.id").alias("component_id"), best.alias("best"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that with its smallest id; all columns."""
    docs = scanned(docs)
    gone = near_groups(docs, doc_id, text).where("not best").select(*ROW_KEY)
    return without(docs, gone)
