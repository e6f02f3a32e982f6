"""Operators over rows in reading order: runs, sticky context, neighbours, paging from a place, quotas and interleaving."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, group: str, order: str, key: Column, into: str = "run") -> DataFrame:
    """Rows with the number, from 1, of their run of equal keys (nulls are equal to each other)."""
    w = Window.partitionBy(group).orderBy(order)
    fresh = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.lag(key).over(w).eqNullSafe(key)).cast("int"))
    return rows.withColumn("_new", fresh).withColumn(into, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged_runs(rows: DataFrame, group: str, order: str, member: Column, text: str) -> DataFrame:
    """Neighbouring rows that are members as one row each: group, first and last row, number, texts joined by line breaks."""
    marked = runs(rows.withColumn("_m", member), group, order, F.col("_m")).where("_m")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(text).alias("_t"))))
    out = marked.groupBy(group, "run").agg(F.min(order).alias("first_row"), F.max(order).alias("last_row"), F.count(F.lit(1)).alias("n"), parts.alias("_p"))
    return out.select(group, "first_row", "last_row", "n", F.array_join(F.transform("_p", lambda x: x["_t"]), "\n").alias("text"))


def sticky(rows: DataFrame, group: str, order: str, value: Column, into: str) -> DataFrame:
    """Rows with the last value that is not null at or before them."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(w))


def spans(rows: DataFrame, group: str, order: str, code: Column) -> DataFrame:
    """Intervals [first_row, stop) of equal neighbouring codes; rows without a code belong to the one before; stop is null for the last."""
    held = rows.withColumn("_c", code).where("_c is not null")
    w = Window.partitionBy(group).orderBy(order)
    first = held.withColumn("_p", F.lag("_c").over(w)).where("_p is null or _p <> _c")
    return first.select(group, F.col("_c").alias("code"), F.col(order).alias("first_row"), F.lead(order).over(w).alias("stop"))


def closed(marks: DataFrame, rows: DataFrame, group: str, start: str, order: str) -> DataFrame:
    """Section marks with their last row: the one before the next mark, or the last of the group."""
    last = rows.groupBy(group).agg(F.max(order).alias("_last"))
    following = F.lead(start).over(Window.partitionBy(group).orderBy(start))
    return marks.withColumn("_next", following).join(last, group).withColumn("last_row", F.coalesce(F.col("_next") - 1, F.col("_last"))).drop("_next", "_last")


def context(rows: DataFrame, anchors: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """For each anchor (group, order) the up to n rows before and after it in reading order, with their distance.

    Places are numbered within the group and an anchor names the 2n+1 places it wants, so the join is on equal keys.
    """
    n = min(n, 10)
    placed = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    wanted = placed.join(anchors.select(group, order), [group, order], "left_semi").select(group, F.col(order).alias("anchor"), F.col("_rn").alias("_at"))
    wanted = wanted.select(group, "anchor", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("distance"), "_at").withColumn("_rn", (F.col("_at") + F.col("distance")).cast("int"))
    return placed.join(wanted, [group, "_rn"]).drop("_rn", "_at")


def onward(rows: DataFrame, group: str, order: str, anchor: Column, boundary: Column, most: int) -> DataFrame:
    """Rows after the anchor of their group, up to `most` and not beyond the first boundary row; reaches_end tells whether nothing is left."""
    after = rows.where(F.col(order) > anchor)
    w = Window.partitionBy(group).orderBy(order)
    after = after.withColumn("_b", F.max(boundary.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w))
    total = F.max("_rn").over(Window.partitionBy(group))
    open_ = after.withColumn("_total", total).where((F.col("_b") == 0) & (F.col("_rn") <= most))
    last = F.max("_rn").over(Window.partitionBy(group))
    return open_.withColumn("reaches_end", last == F.col("_total")).drop("_b", "_rn", "_total")


def quotas(rows: DataFrame, item: str, channel: str, order: list, most: int) -> DataFrame:
    """Items admitted by any channel within its quota: item, best rank, and channel:rank of each in order."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(channel).orderBy(*order))).where(F.col("_r") <= most)
    votes = F.array_join(F.array_sort(F.collect_list(F.concat(F.col(channel), F.lit(":"), F.col("_r").cast("string")))), ",")
    return ranked.groupBy(item).agg(F.min("_r").alias("best_rank"), votes.alias("votes"))


def interleaved(rows: DataFrame, item: str, list_no: str, rank: str, most: int) -> DataFrame:
    """Several ranked lists in turn, first by rank, then by list; a repeated item counts where it comes first. item, place from 1."""
    first = rows.groupBy(item).agg(F.min(F.struct(F.col(rank).alias("_r"), F.col(list_no).alias("_l"))).alias("_k"))
    top = first.orderBy("_k", item).limit(most)  # `most` rows are numbered
    return top.withColumn("place", F.row_number().over(Window.orderBy("_k", item))).select(item, "place")


def windows(rows: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """Overlapping pieces of a text: keys, n, start (from 0), piece. The last piece ends with the text; an empty text has none."""
    step = size - overlap
    x = F.col(text)
    starts = F.when(F.length(x) > 0, F.sequence(F.lit(0), F.greatest(F.ceil((F.length(x) - overlap) / F.lit(step)) - 1, F.lit(0)).cast("int")))
    return rows.select(*keys, x.alias("_x"), F.explode(starts).alias("n")).select(*keys, "n", (F.col("n") * step).alias("start"), F.substring("_x", F.col("n") * step + 1, F.lit(size)).alias("piece"))


#: Ends of sentences at which chunks are preferred to end.
BREAKS = "。！？；.!?;\n"


def cut(text: str, size: int = 240, overlap: int = 40) -> Iterator[tuple[int, int]]:
    """Chunks [start, end) of a text: at most `size` characters, ending after the last break in the second half if there is one, the next starting `overlap` before."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            half = start + size // 2
            stop = max((text.rfind(b, half, end) for b in BREAKS), default=-1)
            end = stop + 1 if stop >= half else end
        yield start, end
        if end >= len(text):
            return
        start = max(end - overlap, start + 1)


def chunks(texts: DataFrame, key: str, text: str, size: int = 240, overlap: int = 40) -> DataFrame:
    """key, n, start, end, chunk. Each text is cut where it lies; nothing is shuffled."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, s, e, t[s:e]) for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]) if t for n, (s, e) in enumerate(cut(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["key", "n", "start", "end", "chunk"])

    return texts.select(key, text).mapInPandas(run, f"key {kind}, n int, start int, end int, chunk string").withColumnRenamed("key", key)
