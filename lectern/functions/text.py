"""Text functions over columns; all are built-in expressions and stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed marker formats of the source texts: page marker, line mark, missing-glyph code, source line.
PAGE_MARKER = r"<pb:([^_<>]+)_([^_<>]+)_([^_<>-]+)-([0-9]+)([a-z]?)>"
ANY_PAGE_MARKER = r"<pb:[^>]*>"
LINE_MARK = "¶"
GLYPH_CODE = r"&KR[0-9]+;"
SOURCE_LINE = r"^# src: *(.*)$"
EDGE = " \t\n\x0b\f\r　"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed numerals and units of Chinese numbers.
DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(text: Column | str) -> Column:
    """Without page markers, line marks and outer white space (the ideographic space too); null if nothing is left."""
    bare = F.regexp_replace(col(text), f"{ANY_PAGE_MARKER}|{LINE_MARK}", "")
    bare = F.when(col(text).contains("<pb:") | col(text).contains(LINE_MARK), bare).otherwise(col(text))
    return F.nullif(F.btrim(bare, F.lit(EDGE)), F.lit(""))


def fold(text: Column | str) -> Column:
    """A-Z as a-z, other characters as they are: how substring search compares."""
    return F.translate(col(text), UPPER, LOWER)


def literal(term: str) -> str:
    """A pattern that matches the term itself."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def has_case(term: str) -> bool:
    return any("a" <= c <= "z" or "A" <= c <= "Z" for c in term)


def contains(text: Column | str, term: str) -> Column:
    """Substring test that ignores case; wildcards have no meaning. Terms without ASCII letters need no folding."""
    return F.lower(col(text)).contains(term.lower()) if has_case(term) else col(text).contains(term)


def contains_any(text: Column | str, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (contains(text, t) for t in terms), F.lit(False))


def contains_all(text: Column | str, groups: list[list[str]]) -> Column:
    """Every group has a term in the text."""
    return reduce(lambda a, b: a & b, (contains_any(text, g) for g in groups), F.lit(True))


def occurrences(text: Column | str, term: str) -> Column:
    """How often a term occurs, without overlaps."""
    x, term = (F.lower(col(text)), term.lower()) if has_case(term) else (col(text), term)
    return ((F.length(x) - F.length(F.replace(x, F.lit(term), F.lit("")))) / len(term)).cast("int")


def bare_mention(text: Column | str, name: str, before: str) -> Column:
    """The name occurs somewhere without one of the characters `before` in front of it."""
    return col(text).rlike(f"(?<![{before}])\\Q{name}\\E")


def page_marker(text: Column | str) -> Column:
    """The first page marker as a struct; the parts are null where it is malformed, all is null without one."""
    x = col(text)
    raw = F.nullif(F.regexp_extract(x, ANY_PAGE_MARKER, 0), F.lit(""))
    good = raw.rlike(f"^{PAGE_MARKER}$")
    names = ("book_id", "edition", "block", "page", "side")
    parts = [F.when(good, F.regexp_extract(raw, PAGE_MARKER, i)).alias(n) for i, n in enumerate(names, 1)]
    return F.when(raw.isNotNull(), F.struct(raw.alias("raw"), *parts))


def source_line(text: Column | str) -> Column:
    """A `# src:` line as a struct of its text, the first word and the rest."""
    body = F.trim(F.regexp_extract(col(text), SOURCE_LINE, 1))
    parts = F.split(body, r"\s+", 2)
    rest = F.when(F.size(parts) > 1, parts[1])
    return F.when(col(text).rlike(SOURCE_LINE), F.struct(body.alias("src_text"), parts[0].alias("prefix"), rest.alias("section_ref")))


def paragraph_code(text: Column | str) -> Column:
    """The first two levels of a leading dotted code (`Lun 3.12.4 ...` gives 3.12), else null."""
    code = F.regexp_extract(col(text), r"^[A-Za-z]*\s*([0-9]+(?:\.[0-9]+)+)", 1)
    return F.nullif(F.substring_index(code, ".", 2), F.lit(""))


def glyph_codes(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(f"({GLYPH_CODE})"), F.lit(1))


def chinese_number(text: Column | str) -> Column:
    """A Chinese or plain number as an integer; null where anything else is in it."""
    x = col(text)
    known = f"^[{''.join(DIGITS)}{''.join(UNITS)}]+$"
    digit = F.create_map(*[F.lit(v) for kv in DIGITS.items() for v in kv])
    unit = F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"), F.lit(False).alias("seen"))

    def step(acc: Column, c: Column) -> Column:
        u, d = unit[c], digit[c]
        ahead = F.when(acc["seen"], acc["now"]).otherwise(F.lit(1))
        after_unit = F.struct((acc["total"] + ahead * u).alias("total"), F.lit(0).alias("now"), F.lit(False).alias("seen"))
        after_digit = F.struct(acc["total"].alias("total"), F.when(acc["seen"], acc["now"] * 10 + d).otherwise(d).alias("now"), F.lit(True).alias("seen"))
        return F.when(u.isNotNull(), after_unit).otherwise(after_digit)

    value = F.aggregate(F.split(x, ""), start, step, lambda a: a["total"] + a["now"])
    return F.when(x.rlike("^[0-9]+$"), x.cast("int")).when(x.rlike(known), value)


def variants(term: str, table: dict[str, str]) -> list[str]:
    """A term, its form with the table applied and that with the table reversed, without repeats. The table maps single characters."""
    there, back = str.maketrans(table), str.maketrans({v: k for k, v in table.items()})
    return list(dict.fromkeys([term, term.translate(there), term.translate(back)]))


def converted(text: Column | str, table: dict[str, str]) -> Column:
    return F.translate(col(text), "".join(table), "".join(table.values()))


def changed_characters(a: Column, b: Column) -> Column:
    """In how many places two texts of one length differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def letters_only(text: Column | str, table: dict[str, str] | None = None) -> Column:
    """Letters and digits, converted and in lower case: the form in which punctuated text is searched."""
    x = F.regexp_replace(col(text), r"[^\p{L}\p{N}]", "")
    return F.lower(converted(x, table) if table else x)
