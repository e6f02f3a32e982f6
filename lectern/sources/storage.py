"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path in the session's spark.checkpoint.dir. Where that is unset a local session gets a folder of its own, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set, and {master} needs a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lectern-shared-")  # one machine, one process
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


#: Paths that the scratch() at work removes.
_scratch: ContextVar[list[str] | None] = ContextVar("_scratch", default=None)
#: With this setting (Spark 4.1) the shuffle files of a query leave the disks when it ends, without it when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: this cuts its lineage and outlives executors."""
    path = path or shared_dir(df.sparkSession)
    if (held := _scratch.get()) is not None:
        held.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that stored() writes inside are removed at the end, and shuffle files at the end of each query inside. Gives a stored() for tables that outlast it."""
    outer, own = _scratch.get(), []

    def lasting(df: DataFrame) -> DataFrame:
        inner = _scratch.set(outer)
        try:
            return stored(df)
        finally:
            _scratch.reset(inner)

    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    token = _scratch.set(own)
    try:
        yield lasting
    finally:
        _scratch.reset(token)
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, own):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_jsonl(records: DataFrame, path: str, book: str = "book_id") -> None:
    """Records as lines of JSON, a folder for each book; an existing build is replaced."""
    records.write.mode("overwrite").partitionBy(book).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of all books. The schema names every column, the book's too."""
    return spark.read.schema(schema).json(path)


def unregistered(inputs: DataFrame, manifest: DataFrame, key: str, digest: str) -> DataFrame:
    """Inputs that the manifest does not name, or names with another digest: key, reason."""
    known = manifest.select(key, F.col(digest).alias("_want"))
    both = inputs.join(known, key, "left")
    reason = F.when(F.col("_want").isNull(), "unregistered").when(F.col("_want") != F.col(digest), "changed")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def dictionary_columns(rows: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """Columns that are worth a dictionary: whose values repeat `least` times on average. c, n_distinct, chosen."""
    from lectern.operators.relational import profile

    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return profile(rows, columns).crossJoin(n).select("c", "n_distinct", (F.col("n_distinct") * least <= F.col("_n")).alias("chosen"))  # one row


def vector_faults(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    """How many vectors are missing, of another size, or hold no numbers."""
    v = F.col(vector)
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.size(v) != size).alias("other_size"), F.count_if(F.exists(v, lambda x: F.isnan(x) | x.isNull())).alias("no_numbers"))


def _field(name: str):
    return lambda r: r[name]


def packed(rows: DataFrame, group: str, order: str, columns: list[str], dictionary: list[str]) -> tuple[DataFrame, DataFrame]:
    """A columnar export: per group one row with an array for each column, in order, dictionary columns as codes; and the dictionaries (c, code, value).

    Codes number a column's values in their order, from 0; null has the code -1. A dictionary column has few values (see dictionary_columns), which are broadcast
    only if Spark finds them small.
    """
    values = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("value")) for c in dictionary))).alias("x")).select("x.*").where("value is not null").distinct()
    codes = stored(values.withColumn("code", F.row_number().over(Window.partitionBy("c").orderBy("value")) - 1).select("c", "code", "value"))
    out = rows
    for c in dictionary:
        own = codes.where(F.col("c") == c).select(F.col("value").alias(f"_{c}"), F.col("code").alias(f"_code_{c}"))
        out = out.join(own, F.col(c).cast("string") == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_code_{c}", F.lit(-1))).drop(f"_{c}", f"_code_{c}")
    lists = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *(F.col(c) for c in columns))))
    whole = out.groupBy(group).agg(lists.alias("_rows"))
    return whole.select(group, F.size("_rows").alias("n_rows"), *(F.transform("_rows", _field(c)).alias(c) for c in columns)), codes


def unpacked(whole: DataFrame, codes: DataFrame, group: str, columns: list[str], dictionary: list[str]) -> DataFrame:
    """The rows of an export again, with their place in the group; an array of another length than n_rows is an error."""
    even = [F.when(F.size(c) == F.col("n_rows"), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} has another length"))).alias(c) for c in columns]
    rows = whole.select(group, *even).select(group, F.posexplode(F.arrays_zip(*columns)).alias("place", "r")).select(group, "place", "r.*")
    for c in dictionary:
        own = codes.where(F.col("c") == c).select(F.col("code").alias(f"_code_{c}"), F.col("value").alias(f"_{c}"))
        rows = rows.join(own, F.col(c) == F.col(f"_code_{c}"), "left").withColumn(c, F.col(f"_{c}")).drop(f"_{c}", f"_code_{c}")
    return rows


def trace(rows: DataFrame, path: str, day: Column | None = None) -> None:
    """Appends rows (one per query) to a log of JSON lines with a folder for each day, so old days can be removed as folders. Nothing is rewritten."""
    rows.withColumn("day", day if day is not None else F.current_date()).write.mode("append").partitionBy("day").json(path)


def keep_traces(spark: SparkSession, path: str, days: int) -> list[str]:
    """Removes all but the last `days` folders of a log; returns what it removed."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("day="))
    gone = found[: max(0, len(found) - days)]
    for name in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, name), True)
    return gone
