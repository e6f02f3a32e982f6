"""Marked-up source files: header, lines and records whose texts put together are the file's body again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import DIGITS, EDGE, UNITS

RECORD = "file_id long, seq int, row_no int, kind string, layer string, section string, text_orig string, char_start int, char_end int, page string, juan int, status string, normalized_text string"


def split_header(raw: Column) -> Column:
    """The leading lines that start with # as a map (`#+KEY: value`, others are kept under their number) and the rest."""
    lines = F.split(raw, "\n")
    rest = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~F.get(lines, i).startswith("#"))
    n = F.coalesce(F.array_min(rest), F.size(lines))
    head = F.slice(lines, F.lit(1), n)
    key = lambda x, i: F.when(x.rlike(r"^#\+?\w+:"), F.regexp_extract(x, r"^#\+?(\w+):", 1)).otherwise(i.cast("string"))
    value = lambda x: F.trim(F.regexp_replace(x, r"^#\+?(\w+:)?", ""))
    pairs = F.transform(head, lambda x, i: F.struct(key(x, i), value(x)))
    body = F.array_join(F.slice(lines, n + 1, F.greatest(F.size(lines) - n, F.lit(0))), "\n")
    return F.struct(F.map_from_entries(pairs).alias("header"), body.alias("body"))


def first_pattern(text: Column, patterns: list[tuple[str, str, float]]) -> Column:
    """The first of the named patterns (method, pattern, confidence) that a text matches, as a struct; null if none."""
    out = F.lit(None)
    for method, pattern, confidence in reversed(patterns):
        out = F.when(text.rlike(pattern), F.struct(F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Every text file below a folder: path, sha256, text (undecodable bytes become U+FFFD)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


_PAGE = re.compile(r"<pb:[^>]*>")
_PARTS = str.maketrans({"（": "(", "）": ")"})


def brackets(text: str) -> list[tuple[int, int, bool]]:
    """Pieces of a line: start, end, whether in brackets. A line with unbalanced or nested brackets is one piece."""
    plain = text.translate(_PARTS)
    pieces, at, depth = [], 0, 0
    for i, c in enumerate(plain):
        if c == "(":
            if depth:
                return [(0, len(text), False)]
            if i > at:
                pieces.append((at, i, False))
            at, depth = i, 1
        elif c == ")":
            if not depth:
                return [(0, len(text), False)]
            pieces.append((at, i + 1, True))
            at, depth = i + 1, 0
    if depth:
        return [(0, len(text), False)]
    if at < len(text):
        # what is only a line mark belongs to the piece before it
        if pieces and text[at:].strip() in ("", "¶"):
            s, _, b = pieces.pop()
            pieces.append((s, len(text), b))
        else:
            pieces.append((at, len(text), False))
    return pieces or [(0, len(text), False)]


def bare(text: str) -> str | None:
    """Without markers and outer white space, as functions.text.normalize has it; null if nothing is left."""
    return _PAGE.sub("", text).replace("¶", "").strip(EDGE) or None


def segment(text: str) -> Iterator[tuple]:
    """Records of a file's body in order: seq, row, kind, layer, section, text, char_start, char_end, page, juan, status, normalized text.

    A line is a page (only markers or blank), a comment (#), a part line (#+), a heading (* ...) or a passage; neighbouring comment lines are one
    record. A part line sets the layer, a heading the section, until the next one. Texts joined by line breaks, and by nothing within a
    line, are the body. A part line with a JUAN (`#+PROPERTY: JUAN 三`) sets the volume. A passage whose brackets are unbalanced or nested is pending, all else
    confirmed; the normalized text is null where nothing is left of it.
    """
    layer, section, page, juan, seq = "main", None, None, None, 0
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        found = _PAGE.findall(line)
        page = found[-1] if found else page
        if line.startswith("#") and not line.startswith("#+"):
            j = i
            while j < len(lines) and lines[j].startswith("#") and not lines[j].startswith("#+"):
                j += 1
            joined = "\n".join(lines[i:j])
            yield seq, i + 1, "comment", layer, section, joined, 0, len(joined), page, juan, "confirmed", bare(joined)
            seq, i = seq + 1, j
            continue
        if line.startswith("#+"):
            m = re.match(r"#\+PART:\s*(\w+)", line)
            layer, section = (m[1], None) if m else (layer, section)
            if v := re.match(r"#\+(?:PROPERTY:\s*)?JUAN:?\s+(\S+)", line):
                juan = number(v[1])
            rows = [("part", 0, len(line), layer)]
        elif m := re.match(r"\*+\s+(.*)", line):
            section = re.sub(r"\s+", " ", _PAGE.sub("", m[1]).replace("¶", "")).strip()
            rows = [("heading", 0, len(line), layer)]
        elif not _PAGE.sub("", line).replace("¶", "").strip(" \t　"):
            rows = [("page", 0, len(line), layer)]
        else:
            rows = [("passage", s, e, "commentary_candidate" if b else layer) for s, e, b in brackets(line)]
        open_ = rows[0][0] == "passage" and len(rows) == 1 and any(c in "()（）" for c in line) and brackets(line) == [(0, len(line), False)]
        for kind, s, e, own in rows:
            yield seq, i + 1, kind, own, section, line[s:e], s, e, page, juan, "pending" if open_ else "confirmed", bare(line[s:e])
            seq += 1
        i += 1


def parse(texts: DataFrame, file_id: str = "file_id", text: str = "text") -> DataFrame:
    """Records of every file; a file is one row, so files are parsed where they lie and nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            rows = [(f, *r) for f, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]) for r in segment(t or "")]
            yield pd.DataFrame(rows, columns=names)

    return texts.select(F.col(file_id).alias("file_id"), F.col(text).alias("text")).mapInPandas(run, RECORD)


def conserved(records: DataFrame, texts: DataFrame, file_id: str = "file_id", text: str = "text") -> DataFrame:
    """Files whose records don't make up their text: none, if the parser is right."""
    line = records.groupBy("file_id", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text_orig"))), lambda x: x["text_orig"]), "").alias("line"))
    body = line.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return texts.select(F.col(file_id).alias("file_id"), F.col(text).alias("_text")).join(body, "file_id", "left").where(~F.col("_text").eqNullSafe(F.col("body"))).select("file_id")


def number(text: str) -> int | None:
    """A Chinese or plain number; None for anything else."""
    if text.isascii() and text.isdigit():
        return int(text)
    if not text or any(c not in DIGITS and c not in UNITS for c in text):
        return None
    total, now = 0, None
    for c in text:
        if c in UNITS:
            total, now = total + (1 if now is None else now) * UNITS[c], None
        else:
            now = DIGITS[c] if now is None else now * 10 + DIGITS[c]
    return total + (now or 0)


def volume_title(line: str, title: str) -> tuple[int, str | None] | None:
    """The number, and part (上 中 下) if any, of a line that names a volume of the book: `title卷第三十二上`."""
    m = re.fullmatch(rf"[\s　]*{re.escape(title)}[\s　]*卷(?:第)?([〇零一二兩三四五六七八九十百千0-9]+)(?:之?([上中下]))?[\s　¶]*", _PAGE.sub("", line))
    n = number(m[1]) if m else None
    return (n, m[2]) if n is not None else None


def declared_titles(lines: list[str], names: list[str]) -> list[tuple[int, str]]:
    """Lines, from 1, that are titles among the declared names: a name counts once, alone on its line, and only where the line before it is blank, a marker or the beginning."""
    left, out, gate = list(dict.fromkeys(names)), [], True
    for i, line in enumerate(lines, 1):
        bare = _PAGE.sub("", line).replace("¶", "").strip(" \t　")
        if gate and bare in left:
            left.remove(bare)
            out.append((i, bare))
        gate = not bare or line.startswith("#")
    return out
