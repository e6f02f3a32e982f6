"""Result blocks: passages around hits, grown within bounds and merged where they meet.

Rows of a file are in order of (row_no). A block never leaves its file, layer and boundary key (section); rows that are no
passages are part of what is quoted but don't decide. Growth goes forwards and backwards in turn until the target size is
reached, a side closing at a boundary or where the block would become too large.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    target: int
    passages: int
    chars: int


#: Fixed sizes of the three block lengths.
LIMITS = {"short": Limits(120, 12, 260), "standard": Limits(420, 40, 900), "long": Limits(1200, 120, 2600)}
_MARKS, _EDGE = re.compile(r"<pb:[^>]*>|¶"), " \t\n\x0b\f\r　"
BLOCK = "block_id string, row_first int, row_last int, match_count int, score double, first_hit int, n_chars int, text string"


class File:
    """The rows of one file."""

    def __init__(self, rows: pd.DataFrame, limits: Limits):
        self.row = rows["row_no"].tolist()
        self.text = rows["text_orig"].fillna("").tolist()
        self.kind = rows["kind"].tolist()
        self.same = list(zip(rows["layer"].tolist(), rows["boundary"].fillna("").tolist()))
        self.ahead = list(accumulate(map(len, self.text), initial=0))  # characters before each row
        self.limits = limits

    def joins(self, anchor: int, i: int) -> bool:
        return 0 <= i < len(self.row) and (self.kind[i] != "passage" or self.same[i] == self.same[anchor])

    def size(self, lo: int, hi: int) -> int:
        return self.ahead[hi + 1] - self.ahead[lo]

    def fits(self, lo: int, hi: int) -> bool:
        return hi - lo + 1 <= self.limits.passages and self.size(lo, hi) <= self.limits.chars

    def grow(self, hit: int) -> tuple[int, int]:
        lo = hi = hit
        ahead = behind = True
        while (ahead or behind) and self.size(lo, hi) < self.limits.target:
            ahead = ahead and self.joins(hit, hi + 1) and self.fits(lo, hi + 1)
            hi += ahead
            if self.size(lo, hi) < self.limits.target:
                behind = behind and self.joins(hit, lo - 1) and self.fits(lo - 1, hi)
                lo -= behind
        return lo, hi

    def reach(self, lo: int, hi: int, want: int, hit: int) -> int:
        """The last row up to `want` that a block from lo can take."""
        while hi < want and self.joins(hit, hi + 1) and self.fits(lo, hi + 1):
            hi += 1
        return hi

    def blocks(self, hits: list[tuple[int, float]]) -> list[list]:
        """[lo, hi, matches, best score, first hit] in order; hits: (place, score) in order."""
        out: list[list] = []
        for at, score in hits:
            lo, hi = self.grow(at)
            if out and self.same[out[-1][4]] == self.same[at] and out[-1][1] >= lo - 1:
                last = out[-1]
                last[1] = self.reach(last[0], last[1], hi, last[4])
                if at <= last[1]:
                    last[2], last[3] = last[2] + 1, min(last[3], score)
                    continue
                lo = last[1] + 1
            elif out:
                lo = max(lo, out[-1][1] + 1)
            out.append([min(lo, at), hi, 1, score, at])
        return out


def assemble(rows: DataFrame, hits: DataFrame, length: str = "standard", file: str = "file_id") -> DataFrame:
    """Blocks of every file with hits. rows: file, row_no, kind, layer, boundary, text_orig; hits: file, row_no, score.

    Files without hits are dropped before the shuffle; one task then sees one file at a time.
    """
    limits = LIMITS[length]
    both = rows.join(hits.select(file, F.lit(True).alias("_x")).distinct(), file, "left_semi").join(hits.select(file, "row_no", F.col("score").alias("_score")), [file, "row_no"], "left")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no", kind="stable").reset_index(drop=True)
        f = File(pdf, limits)
        found = [(i, s) for i, s in enumerate(pdf["_score"].tolist()) if s == s and s is not None]
        out = [(key[0], f"{key[0]}:{f.row[lo]}", f.row[lo], f.row[hi], n, s, f.row[at], f.size(lo, hi), "\n".join(f.text[lo : hi + 1])) for lo, hi, n, s, at in f.blocks(found)]
        return pd.DataFrame(out, columns=[file, *(c.split()[0] for c in BLOCK.split(", "))])

    kind = rows.schema[file].dataType.simpleString()
    return both.select(file, "row_no", "kind", "layer", "boundary", "text_orig", "_score").groupBy(file).applyInPandas(one, f"{file} {kind}, {BLOCK}")


#: Section blocks that are listed after the text blocks, as a fixed bound.
SECTION_BLOCKS = 50


def over_files(files: DataFrame, term: str, length: str = "standard", file: str = "file_id", text: str = "text", opens: str | None = None, score: Callable[[str], float] = lambda line: 0.0) -> DataFrame:
    """Blocks around the lines of each file that contain the term, and, where `opens` is given, around the sections whose heading does: a line with `opens` is a
    heading and begins a section; its block starts from the first passage of the section. Blocks never cross sections.

    A file is a row, so it is split, searched and cut where it lies; nothing is shuffled. Adds match_type (text, section or both) to what assemble() gives.
    """
    limits = LIMITS[length]
    kind = files.schema[file].dataType.simpleString()
    names = [file, *(c.split()[0] for c in BLOCK.split(", ")), "match_type"]

    def one(key, lines: list[str]) -> list[tuple]:
        section, sections = 0, []
        for i, line in enumerate(lines):
            section = i + 1 if opens and opens in line else section
            sections.append(str(section))
        bare = [_MARKS.sub("", x).strip(_EDGE) for x in lines]
        f = File(pd.DataFrame({"row_no": range(1, len(lines) + 1), "text_orig": lines, "kind": ["passage" if b else "page" for b in bare], "layer": "main", "boundary": sections}), limits)
        hits = {i: [score(x), "text"] for i, x in enumerate(lines) if term in x and bare[i]}
        if opens:
            for i, x in enumerate(lines):
                if opens in x and term in x:
                    at = next((j for j in range(i, len(lines)) if sections[j] == sections[i] and bare[j]), None)
                    if at is not None:
                        hits[at] = [min(hits[at][0], score(x)), "both"] if at in hits else [score(x), "section"]
        out, at = [], sorted(hits)
        for lo, hi, n, s, first in f.blocks([(i, hits[i][0]) for i in at]):
            found = {hits[i][1] for i in at if lo <= i <= hi}
            both = "both" if "both" in found or len(found) > 1 else next(iter(found))
            out.append((key, f"{key}:{f.row[lo]}", f.row[lo], f.row[hi], n, s, f.row[first], f.size(lo, hi), "\n".join(f.text[lo : hi + 1]), both))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([b for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]) for b in one(k, t.split("\n"))], columns=names)

    return files.where(F.col(text).contains(term)).select(file, text).mapInPandas(run, f"{file} {kind}, {BLOCK}, match_type string")


def listed(blocks: DataFrame, file: str = "file_id") -> DataFrame:
    """Text blocks by matches, score and source order; then the first SECTION_BLOCKS section blocks in source order. place counts within either."""
    text = blocks.where("match_type <> 'section'").withColumn("part", F.lit(0))
    section = blocks.where("match_type = 'section'").orderBy(file, "row_first").limit(SECTION_BLOCKS).withColumn("part", F.lit(1))
    return text.unionByName(section).orderBy("part", F.when(F.col("part") == 0, -F.col("match_count")).otherwise(0), F.when(F.col("part") == 0, F.col("score")).otherwise(0.0), file, "row_first")


def ranked(blocks: DataFrame, file: str = "file_id") -> DataFrame:
    """Most matches first, then best score, then source order."""
    return blocks.orderBy(F.desc("match_count"), "score", file, "row_first")
