"""What the operators share: reading text columns as bytes, stable row keys, and tables in the shared folder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.storage import scratch, shared_dir, stored  # noqa: F401

#: Columns that name a row of the input: a hash of its file's path and its place in that file.
ROW_KEY = ("__source_file", "__source_row")
#: Texts that Python workers take from Arrow at a time, so that a batch of long texts still fits.
BATCH_BYTES = 16 << 20
#: Rows of a narrow table up to which it is broadcast, so that the table of texts that it meets is not shuffled.
FEW = 500_000


def scanned(df: DataFrame) -> DataFrame:
    """df if it is a scan of Parquet files, with columns and filters at most, so that rows have a place in a file; else df stored and read again."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    if node.nodeName() == "LogicalRelation" and node.relation().toString() == "parquet":
        return df
    return stored(df)


def _key(df: DataFrame, names: tuple[str, str]) -> DataFrame:
    place = df.metadataColumn("_metadata")  # also where a column has that name
    return df.select("*", F.xxhash64(place["file_path"]).alias(names[0]), place["row_index"].alias(names[1]))


def keyed(df: DataFrame, **columns: str) -> DataFrame:
    """ROW_KEY, which stays the same however often a task runs, and the named columns of df under new names, whatever else df has.
    Callers that key a frame twice pass it through scanned() first."""
    return _key(scanned(df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))), ROW_KEY).select(*ROW_KEY, *columns)


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of df, a scan, whose ROW_KEY is not in gone; all columns of df, whatever their names."""
    names = tuple(next(n for k in range(len(df.columns) + 1) if (n := f"{x}{k or ''}").lower() not in {c.lower() for c in df.columns}) for x in ROW_KEY)
    left = _key(df, names).join(gone.select(*(F.col(x).alias(n) for x, n in zip(ROW_KEY, names))), [*names], "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in df.columns))


def few(df: DataFrame) -> DataFrame:
    """df stored, and broadcast in joins if it has FEW rows at most. Its size is known before the other side of a join runs, which may then stay where it is."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= FEW else df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A text column as UTF-8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, text: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces with about `limit` bytes in column `text`, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def words(text: bytes) -> list[bytes]:
    """Words between the six ASCII white-space characters, with A-Z lower-cased and other letters as they are."""
    return text.lower().split()


def sha256_hex(parts: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for x in parts:
        h.update(x)
    return h.hexdigest()


#: Bytes of a text that are split into words at a time.
RUN_BYTES = 8 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_runs(text: bytes, limit: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """words() of a text in order; of a text over `limit` bytes in several lists, cut between words. No list for a text without words."""
    start = 0
    while start < len(text):
        stop = len(text)
        if stop - start > limit:
            m = _SPACE.search(text, start + limit)
            stop = m.start() if m else stop
        if run := words(text[start:stop]):
            yield run
        start = stop


def shingles(text: bytes, n: int) -> Iterator[list[bytes]]:
    """Runs of n words, joined by spaces, in order and with repeats; of fewer words the whole sequence; none of no words."""
    tail: list[bytes] = []
    found = False
    for run in word_runs(text):
        tail += run
        if len(tail) >= n:
            yield list(map(b" ".join, zip(*(tail[i:] for i in range(n)))))
            tail, found = tail[len(tail) - n + 1 :], True
    if tail and not found:
        yield [b" ".join(tail)]
