"""Exact deduplication with a heavy-hitter split.

1. Every row becomes a narrow one, id, row key and digest, stored once in the shared folder.
2. Misra-Gries summaries of k counters, one per task, are summed by digest. A digest with 2/k of the rows or more keeps a
   summed count of n/k at least, and at most k digests can reach that: these are the candidates.
3. Their exact counts and winners come from a second pass with map-side partial sums, and are broadcast: k rows at most,
   whatever the input. Rows of these groups are settled where they lie, so a group of a third of all rows meets in no task.
4. The remaining digests have under 2n/k rows each and meet in an ordinary shuffle.

The row with the largest id stays. Null text counts as empty, a null id is smaller than any other, and of rows with the
same id and text the one that comes last in the files stays. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ROW_KEY, keyed, scanned, stored, without

#: Counters of a task's summary, and the bound of what is broadcast.
COUNTERS = 1024


class MisraGries:
    """k counters that miss no item with over n/(k+1) of n occurrences; each count is too low by n/(k+1) at most."""

    def __init__(self, k: int):
        self.k, self.counts = k, {}

    def add(self, item, times: int = 1) -> None:
        counts = self.counts
        if item in counts:
            counts[item] += times
        elif len(counts) < self.k:
            counts[item] = times
        else:
            least = min(times, min(counts.values()))
            self.counts = {x: c - least for x, c in counts.items() if c > least}
            if times > least:
                self.add(item, times - least)


def summaries(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Misra-Gries counters of every task (key, count), and a row with null and the number of rows that it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = MisraGries(k), 0
        for batch in batches:
            n += batch.num_rows
            for pair in batch.column(0).value_counts().to_pylist():
                sketch.add(pair["values"], pair["counts"])
        yield pa.RecordBatch.from_arrays([pa.array([*sketch.counts, None], pa.string()), pa.array([*sketch.counts.values(), n], pa.int64())], names=["key", "count"])

    return rows.select(key).mapInArrow(run, "key string, count long")


def frequent(rows: DataFrame, key: str, k: int = COUNTERS) -> list[str]:
    """At most k keys, among them each that has 2/k of the rows."""
    summed = summaries(rows, key, k).groupBy("key").agg(F.sum("count").alias("count"))
    total = summed.where("key is null").agg(F.sum("count")).first()[0] or 0
    return [r.key for r in summed.where(F.col("key").isNotNull() & (F.col("count") >= max(2, total / k))).collect()]


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ROW_KEY, id, text_sha256, keep_id, group_size, kept."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = stored(keyed(docs, id=doc_id, text=text).select(*ROW_KEY, "id", digest.alias("text_sha256")))
    own = F.struct("id", *ROW_KEY)
    hot = rows.sparkSession.createDataFrame([(x,) for x in frequent(rows, "text_sha256", counters)], "text_sha256 string")
    winners = rows.join(F.broadcast(hot), "text_sha256").groupBy("text_sha256").agg(F.max(own).alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = stored(winners.coalesce(1))  # `counters` rows at most
    settled = rows.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    rest = rest.withColumns({"best": F.max(own).over(group), "group_size": F.count(F.lit(1)).over(group)})
    wins = (F.col("best")[ROW_KEY[0]] == F.col(ROW_KEY[0])) & (F.col("best")[ROW_KEY[1]] == F.col(ROW_KEY[1]))
    return settled.unionByName(rest).select(*ROW_KEY, "id", "text_sha256", F.col("best.id").alias("keep_id"), "group_size", wins.alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that repeat another's text; all its columns."""
    docs = scanned(docs)
    gone = exact_groups(docs, doc_id, text).where("not kept").select(*ROW_KEY)
    return without(docs, gone)
