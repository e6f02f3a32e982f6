"""Checks of data and of results: leaks, quotations, rules, coverage, and reasons for empty results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaks(rows: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """Rows whose text matches a forbidden pattern, with the names of the patterns in order."""
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()])))
    return rows.select(key, found.alias("leaks")).where(F.size("leaks") > 0)


def quoted(items: DataFrame, texts: DataFrame, item_id: str, text_id: str, column: str = "text") -> DataFrame:
    """Pairs of an item and a text that contains it verbatim, in one pass over the texts.

    A word that stands between two others in an item is a word of every text that contains it, so the longest such word is the key of a hash join; the
    candidates are then compared. Items of fewer than three words have no such key: those, a stated set, are compared with every text.
    """
    words = F.split(F.col("_quote"), r"\s+")
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = items.select(F.col(item_id), F.col(column).alias("_quote")).where("_quote is not null").withColumn("_word", longest)
    rows = texts.select(text_id, F.col(column).alias("_text"))
    own = rows.select("*", F.explode(F.array_distinct(F.split("_text", r"\s+"))).alias("_word"))
    found = own.join(keyed.where("_word is not null"), "_word").where(F.col("_text").contains(F.col("_quote"))).select(item_id, text_id)
    short = rows.join(F.broadcast(keyed.where("_word is null")), F.col("_text").contains(F.col("_quote"))).select(item_id, text_id)
    return found.union(short)


def first_rule(rows: DataFrame, rules: list[tuple], keys: list[str], default: str, into: str = "layer") -> DataFrame:
    """The value of the first rule (order, key values or None for any, value) that fits a row."""
    value: Column = F.lit(default)
    for rule in sorted(rules, reverse=True):
        fits = reduce(lambda a, b: a & b, (F.col(k) == v for k, v in zip(keys, rule[1:-1]) if v is not None), F.lit(True))
        value = F.when(fits, rule[-1]).otherwise(value)
    return rows.withColumn(into, value)


def coverage(rows: DataFrame, marks: DataFrame, book: str, file: str, row: str, mark: str, warn: float = 0.9) -> DataFrame:
    """By book: rows, rows that come before their file's first section or whose file has none, and a status by the covered part."""
    first = marks.groupBy(file).agg(F.min(mark).alias("_first"))
    both = rows.join(first, file, "left")
    bare = F.count_if(F.col("_first").isNull() | (F.col(row) < F.col("_first")))
    out = both.groupBy(book).agg(F.count(F.lit(1)).alias("body_rows"), bare.alias("uncovered_rows"))
    part = 1 - F.col("uncovered_rows") / F.col("body_rows")
    return out.withColumn("status", F.when(part >= warn, "OK").when(F.col("uncovered_rows") < F.col("body_rows"), "WARN").otherwise("FAIL"))


def interval_gaps(spans: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Gaps between neighbouring intervals of a group: after, before."""
    from pyspark.sql import Window

    following = F.lead(start).over(Window.partitionBy(group).orderBy(start))
    return spans.select(group, F.col(end).alias("after"), following.alias("before")).where("before > after + 1")


def explain_empty(rows: DataFrame, term: str, scope: Column, text: str, searchable: str) -> DataFrame:
    """Why a term has no hits in a scope: one row of counts and a class, from one scan.

    hit, or nothing in scope (coverage), or in the original but not in the searchable text (normalization), or elsewhere only
    (scope), or nowhere (absent).
    """
    has, found = F.col(text).contains(term), F.coalesce(F.col(searchable).contains(term), F.lit(False))
    one = rows.agg(F.count_if(scope).alias("rows_in_scope"), F.count_if(scope & found).alias("hits"), F.count_if(scope & has).alias("raw_hits"), F.count_if(has).alias("anywhere"))
    kind = F.when(F.col("hits") > 0, "hit").when(F.col("rows_in_scope") == 0, "coverage").when(F.col("raw_hits") > 0, "normalization").when(F.col("anywhere") > 0, "scope").otherwise("absent")
    return one.select(F.lit(term).alias("term"), "*", kind.alias("reason"))


def scope_status(hits: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """By scope: hit, complete_no_hit, partial_no_hit or not_imported. known: key, expected, imported; hits: key, one row per hit."""
    n = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits"))
    out = known.join(n, key, "left").na.fill({"n_hits": 0})
    status = F.when(F.col("n_hits") > 0, "hit").when(F.col("imported") == 0, "not_imported").when(F.col("imported") < F.col("expected"), "partial_no_hit").otherwise("complete_no_hit")
    return out.select(key, "n_hits", status.alias("status"))


def volume_audit(measured: DataFrame, declared: Column) -> DataFrame:
    """Problem codes of measured volumes against a declared number. measured: n, gaps, split, ..."""
    n = F.col("n")
    codes = F.array_compact(F.array(F.when(n < declared, "missing"), F.when(n > declared, "surplus"), F.when(F.col("gaps") > 0, "gap"), F.when(F.col("split") > 0, "split")))
    return measured.withColumn("problems", F.array_join(codes, ",")).withColumn("level", F.when(n < declared, "FAIL").when(F.size(codes) > 0, "WARN").otherwise("OK"))


#: Layers in which a term can get lost, in their order, with the class of an empty result that ends there.
LAYERS = (("listed", "coverage"), ("imported", "coverage"), ("in_text", "absent"), ("in_index", "normalization"), ("found", "search"), ("assembled", "assembly"))


def attributed(books: DataFrame, rows: DataFrame, terms: list[str], book: str, text: str, searchable: str, passage: Column) -> DataFrame:
    """For each book and term the layer in which an empty result arises: book, term, reached (the last layer that still has it), reason (hit if all have).

    books: book, listed. Layers: the catalog lists the book; rows of it are there; the term is in the original text with other characters than letters and digits
    ignored; it is so in the searchable text; a search for it as it stands has hits; a hit is a passage, from which a block can grow. One scan answers all.
    """
    from lectern.functions.text import letters_only

    sums = [F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(terms):
        bare = "".join(c for c in t.lower() if c.isalnum())
        hit = F.coalesce(F.col(searchable).contains(t), F.lit(False))
        conditions = (letters_only(text).contains(bare), F.coalesce(letters_only(searchable).contains(bare), F.lit(False)), hit, hit & passage)
        sums += [F.count_if(c).alias(f"_{i}_{k}") for k, c in enumerate(conditions)]
    counted = books.select(book, "listed").join(rows.groupBy(book).agg(*sums), book, "full_outer")
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), *(F.coalesce(F.col(f"_{i}_{k}"), F.lit(0)).alias(f"_{k}") for k in range(4))) for i, t in enumerate(terms)))).alias("x")
    out = counted.select(book, F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("_n", F.lit(0)).alias("_n"), each).select(book, "listed", "_n", "x.*")
    there = [F.col("listed"), F.col("_n") > 0, *(F.col(f"_{k}") > 0 for k in range(4))]
    reason, reached = F.lit("hit"), F.lit(LAYERS[-1][0])
    for i in range(len(LAYERS) - 1, -1, -1):
        reason = F.when(~there[i], LAYERS[i][1]).otherwise(reason)
        reached = F.when(~there[i], LAYERS[i - 1][0] if i else "none").otherwise(reached)
    return out.select(book, "term", reached.alias("reached"), reason.alias("reason"))


def publishable(files: DataFrame, allowed: list[str], forbidden: list[str], texts: DataFrame | None = None) -> DataFrame:
    """What stands against publishing an export: path, problem. files: path, title, text; allowed: patterns of paths; forbidden: words of titles; texts: text, the
    published passages, of which every file's quotation must be a part."""
    from lectern.sources.storage import stored

    listed = reduce(lambda a, b: a | b, (F.col("path").rlike(p) for p in allowed), F.lit(False))
    barred = reduce(lambda a, b: a | b, (F.col("title").contains(w) for w in forbidden), F.lit(False))
    checks = F.array_compact(F.array(F.when(~listed, "file not allowed"), F.when(F.coalesce(barred, F.lit(False)), "forbidden title")))
    out = files.select("path", F.explode(checks).alias("problem"))
    if texts is not None:
        found = stored(quoted(files, texts.withColumn("_row", F.lit(1)), "path", "_row").select("path").distinct())
        out = out.unionByName(files.join(found, "path", "left_anti").select("path", F.lit("quotation without source").alias("problem")))
    return out
