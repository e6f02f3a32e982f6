"""License notices by conditional compression.

A notice's words may differ from its template's in a fifth of the template's words at most. So each template gets anchors, more of its rarer
words than may differ, and a notice holds at least one of them: stretches around anchors are the candidate blocks, and none is missed.
In a block, the stretches where enough of a template's words lie within its length are compressed alone and with each such template as a raw zstandard
dictionary, and the templates are ranked by how much they shorten the stretch. In that order they are aligned with it word by word, and the first whose
differing words are few enough wins, in the first of its best places; of templates that shorten it equally the one with the smallest part of differing words. The saving only ranks: it rules no template out. The rest, before and after the notice, is searched again. Numbers are equal to any others (versions and years), case and punctuation do
not matter.

Null or empty texts hold no notices. Repeated rows give their notices each. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lectern.llm.common import ROW_KEY, as_bytes, keyed, slices
from lectern.llm.tokens import hash_words

#: Part of a template's words that may differ.
DIFFER = 0.2
#: Fixed wordings of public license notices; 0 stands for any number.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 0.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY": ("Licensed under CC BY 0.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 0.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 0.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND": ("Licensed under CC BY-ND 0.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "all-rights-reserved": ("All rights reserved.",),
}
#: Words too common in other text to be anchors, as far as a template has enough others.
COMMON = frozenset(b"a an the of to in on at by is it or and any as be for from that this with you your not may can under all are its either above following".split())


def plain(words: list[bytes]) -> list[bytes]:
    return [b"0" if w.isdigit() else w for w in words]


def split(text: str) -> list[bytes]:
    found = hash_words([text.encode()], marks=True)
    return plain([found.word(0, i) for i in range(len(found.hashes))])


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


class Templates:
    def __init__(self, texts: dict[str, tuple[str, ...]] = TEMPLATES):
        self.texts = texts
        self._prepare()

    def _prepare(self) -> None:
        self.names = [n for n, forms in self.texts.items() for _ in forms]
        self.words = [split(x) for forms in self.texts.values() for x in forms]
        anchors: set[bytes] = set()
        for words in self.words:
            need = int(DIFFER * len(words)) + 1
            # longer words first; repeats don't count twice
            rare = sorted(set(words) - COMMON - {b"0"}, key=lambda w: (-len(w), w)) + sorted(set(words) & COMMON)
            while need and sum(words.count(w) for w in rare[:need]) < int(DIFFER * len(words)) + 1:
                need += 1
            anchors.update(rare[:need])
        self.anchors = np.unique(hash_words([b" ".join(sorted(anchors))], marks=True).hashes)
        self.longest = max(map(len, self.words))
        self.known = {w: i for i, w in enumerate(sorted({w for words in self.words for w in words}), 1)}
        self.member = np.zeros((len(self.words), len(self.known) + 1), dtype=bool)
        for i, words in enumerate(self.words):
            self.member[i, [self.known[w] for w in words]] = True
        self.alone = zstandard.ZstdCompressor(level=3)
        self.with_template = []
        for words in self.words:
            raw = zstandard.ZstdCompressionDict(b" ".join(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_template.append(zstandard.ZstdCompressor(level=3, dict_data=raw))

    def __getstate__(self):
        return {"texts": self.texts}

    def __setstate__(self, state):
        self.texts = state["texts"]
        self._prepare()

    def covered(self, i: int, ids: np.ndarray) -> np.ndarray:
        """Words in stretches that hold enough of the template's words for a notice; none of a notice's words is outside them."""
        m, n = len(self.words[i]), len(ids)
        differ = int(DIFFER * m)
        width = min(m + differ, n)
        total = np.r_[0, np.cumsum(self.member[i][ids])]
        ok = np.flatnonzero(total[width:] - total[: n - width + 1] >= m - differ)
        edges = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edges, ok, 1)
        np.add.at(edges, ok + width, -1)
        return np.cumsum(edges[:n]) > 0

    def ranked(self, words: list[bytes], among: list[int]) -> list[tuple[float, int]]:
        """Templates by the part of the stretch's compressed size that they save, best first; at the same size the longer template."""
        block = b" ".join(words)
        size = len(self.alone.compress(block))
        saved = [(1 - len(self.with_template[i].compress(block)) / size, len(self.words[i]), -i) for i in among]
        return [(x, -i) for x, _, i in sorted(saved, reverse=True)]

    def best(self, words: list[bytes], places: dict[int, list[tuple[int, int]]]) -> tuple | None:
        """The notice of the first template by rank that is confirmed at its places, of equal ranks that with the smallest part of differing words:
        (template, saved part, (first word, end, words that differ))."""
        found = None
        for saved, i in self.ranked(words, list(places)):
            if found and saved < found[1]:
                break
            hits = [(hit[0] + lo, hit[1] + lo, hit[2]) for lo, hi in places[i] if (hit := self.aligned(i, words[lo:hi]))]
            if hits:
                hit = min(hits, key=lambda h: len(h[2]))
                part = len(hit[2]) / len(self.words[i])
                if found is None or part < found[0]:
                    found = part, saved, i, hit
        return found and (found[2], found[1], found[3])

    def find(self, words: list[bytes], start: int = 0) -> list[tuple]:
        """Notices in a block: (first word, number of words, template, saved part, template's words that differ), in order.

        A block of more than four times the longest notice is searched in windows of that length; of each, the notices that begin in its first three quarters
        count, and the next window begins behind them.
        """
        ids = np.array([self.known.get(w, 0) for w in words], dtype=np.int64)
        most = self.longest + int(DIFFER * self.longest)
        out = []
        for lo, hi in [(0, len(words))] if len(words) <= 4 * most else self.stretches(ids):
            while lo < hi:
                end = min(lo + 4 * most, hi)
                stop = end if end == hi else lo + 3 * most
                found = [x for x in self.notices(words[lo:end], ids[lo:end]) if lo + x[0] < stop]
                out += [(start + lo + x[0], *x[1:]) for x in found]
                lo = max([stop, *(lo + x[0] + x[1] for x in found)])
        return out

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where notices can be."""
        inside = np.zeros(len(ids), dtype=bool)
        for i in range(len(self.words)):
            inside |= self.covered(i, ids)
        return runs(inside)

    def notices(self, words: list[bytes], ids: np.ndarray) -> list[tuple]:
        """find() of a short block: of each stretch the best notice, then the best ones before and after it, and so on."""
        out, todo = [], [(0, len(words))]
        while todo:
            lo, hi = todo.pop()
            if lo == hi:
                continue
            covers = {i: cover for i in range(len(self.words)) if (cover := self.covered(i, ids[lo:hi])).any()}
            for s, e in runs(np.logical_or.reduce([*covers.values(), np.zeros(hi - lo, dtype=bool)])):
                s, e = lo + s, lo + e
                if one := self.best(words[s:e], {i: places for i, cover in covers.items() if (places := runs(cover[s - lo : e - lo]))}):
                    i, saved, (first, end, differing) = one
                    out.append((s + first, end - first, i, saved, differing))
                    todo += [(s, s + first), (s + end, e)]
        return sorted(out, key=lambda x: x[0])

    def aligned(self, i: int, words: list[bytes]) -> tuple[int, int, list[bytes]] | None:
        """Where the template lies in the block with the fewest words inserted, left out or exchanged, if those are few enough."""
        want = self.words[i]
        m, n = len(want), len(words)
        cost = np.zeros((m + 1, n + 1), dtype=np.int32)
        cost[:, 0] = np.arange(m + 1)
        have = np.array(words, dtype=object)
        for r in range(1, m + 1):
            best = np.minimum(cost[r - 1, :-1] + (have != want[r - 1]), cost[r - 1, 1:] + 1)
            # inserted words: the running minimum of what is left after one per word
            run = np.minimum.accumulate(np.r_[cost[r, 0], best] - np.arange(n + 1)) + np.arange(n + 1)
            cost[r] = run
        end = int(cost[m].argmin())
        if cost[m, end] > int(DIFFER * m):
            return None
        r, c, differing = m, end, []
        while r > 0:
            if c > 0 and cost[r, c] == cost[r - 1, c - 1] + (words[c - 1] != want[r - 1]):
                if words[c - 1] != want[r - 1]:
                    differing.append(want[r - 1] + b">" + words[c - 1])
                r, c = r - 1, c - 1
            elif cost[r, c] == cost[r - 1, c] + 1:
                differing.append(b"-" + want[r - 1])
                r -= 1
            else:
                differing.append(b"+" + words[c - 1])
                c -= 1
        return c, end, differing[::-1]


def scan(docs: DataFrame, templates: Templates | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each notice: ROW_KEY, id, license, version (its numbers), first_word, n_words, n_differing, differing, saved."""
    rows = keyed(docs, id=doc_id, text=text)
    shared = rows.sparkSession.sparkContext.broadcast(templates or Templates())
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, 3, 4 << 20):
                found = hash_words(as_bytes(batch.column(3)), marks=True)
                owner = found.owner()
                at = np.flatnonzero(np.isin(found.hashes, own.anchors))
                take, out = [], []
                # anchors of one text that are near each other make one block
                cuts = np.flatnonzero((np.diff(at) > own.longest) | (np.diff(owner[at]) != 0)) + 1
                for group in np.split(at, cuts) if len(at) else []:
                    d = int(owner[group[0]])
                    start, end = int(found.first[d]), int(found.first[d + 1])
                    lo, hi = max(start, int(group[0]) - own.longest), min(end, int(group[-1]) + own.longest + 1)
                    raw = [found.word(d, i - start) for i in range(lo, hi)]
                    for first, n, i, saved, differing in own.find(plain(raw)):
                        numbers = [w.decode() for w in raw[first : first + n] if w.isdigit()]
                        take.append(d)
                        out.append((own.names[i], ".".join(numbers) or None, lo - start + first, n, len(differing), b" ".join(differing).decode("utf-8", "replace"), saved))
                if take:
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                    cols = [batch.column(i).take(pa.array(take)) for i in range(3)] + [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*ROW_KEY, "id", "license", "version", "first_word", "n_words", "n_differing", "differing", "saved"])

    return rows.mapInArrow(run, f"{ROW_KEY[0]} long, {ROW_KEY[1]} long, id {kind}, license string, version string, first_word long, n_words long, n_differing long, differing string, saved double")
