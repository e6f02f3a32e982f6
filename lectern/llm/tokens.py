"""Words of many texts as arrays: a 64-bit hash for each word and where it lies, without a Python object for each.

Words are runs of other bytes than the six ASCII white-space characters, with A-Z lower-cased. A word's hash is a polynomial
in an odd base modulo 2**64, taken from prefix sums and mixed at the end. Equal words have equal hashes; whoever needs the
reverse compares the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The same with ASCII punctuation: for words without the marks around them.
_MARKS = _SPACE | np.array([33 <= i <= 47 or 58 <= i <= 64 or 91 <= i <= 96 or 123 <= i <= 126 for i in range(256)])
#: Bytes hashed at a time.
CHUNK = 2 << 20
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n-1) modulo 2**64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, CHUNK + 1024)
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all others (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash(raw: bytes, space: np.ndarray, affixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    b = np.frombuffer(raw, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, space[b], True].astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[b] * _power(_BASE, len(b)), out=sums[1:])
    back = _power(_INVERSE, len(b) + 1)
    part = lambda i, j, salt: mix((sums[j] - sums[i]) * back[i] + np.uint64(salt))
    ends = [part(start, np.minimum(start + n, stop), n) if n > 0 else part(np.maximum(stop + n, start), stop, 64 - n) for n in affixes]
    return part(start, stop, 0), start, stop, ends


@dataclass
class Words:
    """Hashes of the words of several texts, one text after another."""

    texts: list[bytes]
    hashes: np.ndarray
    start: np.ndarray  # byte positions in the word's own text
    stop: np.ndarray
    first: np.ndarray  # place of each text's first word, and the number of words at the end
    affixes: list[np.ndarray]  # hashes of the words' first n bytes, or last n where n is negative

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.texts)), np.diff(self.first))

    def word(self, text: int, i: int) -> bytes:
        at = self.first[text] + i
        return self.texts[text][self.start[at] : self.stop[at]].lower()


def hash_words(texts: list[bytes], marks: bool = False, affixes: tuple[int, ...] = ()) -> Words:
    """All words of all texts; with marks, ASCII punctuation separates words like white space. Short texts are hashed together, long ones in pieces cut at white space."""
    space = _MARKS if marks else _SPACE
    hashes, starts, stops, counts, ends = [], [], [], [], []
    group: list[bytes] = []
    size = 0

    def close():
        nonlocal group, size
        if not group:
            return
        h, start, stop, more = _hash(b"\n".join(group), space, affixes)
        ends.append(more)
        offsets = np.cumsum([0] + [len(t) + 1 for t in group])
        first = np.searchsorted(start, offsets)
        n = np.diff(first)
        shift = np.repeat(offsets[:-1], n)
        hashes.append(h)
        starts.append(start - shift)
        stops.append(stop - shift)
        counts.extend(n.tolist())
        group, size = [], 0

    for text in texts:
        if len(text) <= CHUNK:
            if size + len(text) > CHUNK:
                close()
            group.append(text)
            size += len(text) + 1
            continue
        close()
        at = n = 0
        while at < len(text):
            end = min(at + CHUNK, len(text))
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            h, start, stop, more = _hash(text[at:end], space, affixes)
            ends.append(more)
            hashes.append(h)
            starts.append(start + at)
            stops.append(stop + at)
            n, at = n + len(h), end
        counts.append(n)
    close()
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
    return Words(texts, join(hashes, np.uint64), join(starts, np.int64), join(stops, np.int64), np.cumsum([0] + counts), [join([e[i] for e in ends], np.uint64) for i in range(len(affixes))])
