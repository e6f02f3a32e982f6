"""Relational operators of the engine: range, as-of and interval joins, merges, profiles, paging and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_before_first(rows: DataFrame, marks: DataFrame, group: str = "file_id", row: str = "row_no", mark: str = "first_row") -> DataFrame:
    """Rows of a group that come before its first mark; groups without marks have none. Only one row per group is joined."""
    first = marks.groupBy(group).agg(F.min(mark).alias("_first"))
    return rows.join(first, group).where(F.col(row) < F.col("_first")).drop("_first")


def as_of(rows: DataFrame, marks: DataFrame, group: str, row: str, mark: str, take: list[str]) -> DataFrame:
    """Each row with the columns `take` of the last mark of its group at or before it, null before the first.

    Rows and marks are interleaved and the last mark is carried forward: one shuffle, no product of rows and marks.
    """
    held = [c for c in rows.columns if c != group]
    left = rows.select(group, F.col(row).alias("_at"), F.lit(1).alias("_kind"), F.struct(*held).alias("_row"), F.lit(None).cast(marks.select(F.struct(*take)).schema[0].dataType).alias("_mark"))
    right = marks.select(group, F.col(mark).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct(*take).alias("_mark"))
    w = Window.partitionBy(group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("_mark", F.last("_mark", ignorenulls=True).over(w)).where("_kind = 1")
    return out.select(group, "_row.*", *[F.col("_mark")[c].alias(c) for c in take])


def intervals(marks: DataFrame, group: str, mark: str, stop: str = "stop") -> DataFrame:
    """marks with the start of the next one of the group (null for the last)."""
    return marks.withColumn(stop, F.lead(mark).over(Window.partitionBy(group).orderBy(mark)))


def in_interval(rows: DataFrame, spans: DataFrame, group: str, row: str, start: str, stop: str, take: list[str]) -> DataFrame:
    """Rows with the interval that holds them; intervals of a group don't overlap, so the last one that starts is the only candidate."""
    found = as_of(rows, spans, group, row, start, [start, stop, *take])
    return found.where(F.col(start).isNotNull() & (F.col(stop).isNull() | (F.col(row) < F.col(stop))))


def first_occurrence(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, with the smallest order."""
    return rows.select(*keys, *order).groupBy(*keys).agg(F.min(F.struct(*[c for c in rows.select(*order).columns])).alias("_f")).select(*keys, "_f.*")


def left_merge(base: DataFrame, more: DataFrame, key: str, other_key: str, defaults: dict) -> DataFrame:
    """base with the columns of more, defaults where it has no row."""
    more = more.withColumnRenamed(other_key, key) if key != other_key else more
    return base.join(more, key, "left").na.fill(defaults)


def reconcile(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of two counts (expected, declared) with a status."""
    e, d = F.col("expected"), F.col("declared")
    status = F.when(e.isNull(), "unregistered").when(d.isNull(), "missing").when(e == d, "complete").when(d > e, "surplus").otherwise("partial")
    return expected.join(found, keys, "full_outer").select(*keys, "expected", "declared", status.alias("status"))


def conditional_counts(rows: DataFrame, keys: list[str], total: str, tests: dict[str, str]) -> DataFrame:
    """Rows by key, and how many of them pass each test, in one pass."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(total), *[F.count_if(F.expr(t)).alias(n) for n, t in tests.items()])


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values and longest value of each column: what dictionary encoding is decided on."""
    one = rows.agg(*[F.countDistinct(c).alias(f"n_{i}") for i, c in enumerate(columns)], *[F.max(F.length(c)).alias(f"l_{i}") for i, c in enumerate(columns)])
    parts = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"n_{i}").alias("n_distinct"), F.col(f"l_{i}").cast("long").alias("longest")) for i, c in enumerate(columns)])
    return one.select(F.explode(parts).alias("x")).select("x.*")


def code_histogram(rows: DataFrame, file: str, text: str, pattern: str) -> DataFrame:
    codes = rows.select(F.col(file).alias("_file"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("_file").alias("first_file"))


def corpus_counts(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Rows that contain each term, all terms in one scan; terms without a row are left out."""
    one = rows.agg(*[F.count_if(F.lower(text).contains(t.lower())).alias(f"t{i}") for i, t in enumerate(terms)])
    parts = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("n")) for i, t in enumerate(terms)])
    return one.select(F.explode(parts).alias("x")).select("x.*").where("n > 0")


def measure_volumes(rows: DataFrame, book: str, number: str, file: str) -> DataFrame:
    """By book: span of volume numbers, how many there are, how many are split over files, and the numbers that are missing in the span."""
    by = rows.groupBy(book, number).agg(F.countDistinct(file).alias("_files"))
    by = by.groupBy(book).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("_files") > 1).alias("split"), F.collect_set(number).alias("_have"))
    missing = F.array_join(F.array_sort(F.array_except(F.sequence("lo", "hi"), "_have")), ",")
    return by.select(book, "lo", "hi", "n", "split", (F.col("hi") - F.col("lo") + 1 - F.col("n")).alias("gaps"), missing.alias("missing"))


def recall_metrics(rows: DataFrame, dimension: str, outcome: str, outcomes: list[str]) -> DataFrame:
    return rows.groupBy(dimension).pivot(outcome, outcomes).count().na.fill(0, outcomes)


def page(rows: DataFrame, order: list, number: int, size: int, most: int = 100) -> DataFrame:
    """One page of an ordered result; pages count from 1. Sizes below 1 or above `most` are taken as these bounds, as the service does."""
    if number < 1:
        raise ValueError("pages count from 1")
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def capped(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows in order, and whether that left any out."""
    total = rows.limit(most + 1).agg((F.count(F.lit(1)) > most).alias("truncated"))
    return rows.orderBy(*order).limit(most).crossJoin(total)  # one row


def union_first(frames: list[DataFrame], keys: list[str], rank: str) -> DataFrame:
    """Union of pools; of equal keys the one of the earliest pool stays, numbered from 1."""
    parts = [f.select(*keys).withColumn(rank, F.lit(i)) for i, f in enumerate(frames, 1)]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.min(rank).alias(rank))


def match_types(text: DataFrame, section: DataFrame, key: str) -> DataFrame:
    both = text.select(key, F.lit(1).alias("_t"), F.lit(0).alias("_s")).unionByName(section.select(key, F.lit(0).alias("_t"), F.lit(1).alias("_s")))
    both = both.groupBy(key).agg(F.max("_t").alias("_t"), F.max("_s").alias("_s"))
    return both.select(key, F.when(F.col("_t") + F.col("_s") == 2, "both").when(F.col("_t") == 1, "text").otherwise("section").alias("match_type"))


def is_subset(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    return a.join(b, a.columns, "left_anti").agg((F.count(F.lit(1)) == 0).alias(name))


def key_report(rows: DataFrame, name: str, key: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("repeated")).select(F.lit(name).alias("name"), "n", "repeated")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two builds of a table have equal rows, whatever their order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
