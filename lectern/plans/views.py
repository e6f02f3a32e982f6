"""The corpus views that the operators work on, built from the tables at hand, in Spark and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Makes a passage's id from its file and line, so that no global numbering is needed. A line's number is an int, so ids of two files never meet.
STRIDE = 1 << 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of a document: the document is the file, its source the book, its language the edition's family."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("book_id"), F.col("lang").alias("family"), F.posexplode(F.split("text", "\n")).alias("pos", "text_orig"))
    rows = rows.withColumn("row_no", F.col("pos") + 1).withColumn("normalized_text", T.normalize("text_orig"))
    kind = F.when(F.col("normalized_text").isNull(), "page").otherwise("passage")
    return rows.select("file_id", "book_id", "family", "row_no", (F.col("file_id") * STRIDE + F.col("row_no")).alias("passage_id"), kind.alias("kind"), "text_orig", "normalized_text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files whose rows have a layer."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("row_no"), F.col("role").alias("layer"), F.col("text").alias("text_orig"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings: a line with an 'and' opens a section that lasts until the next of its file. file_id, first_row, label."""
    return passages(spark, sf_dir).where("text_orig like '%and%'").select("file_id", F.col("row_no").alias("first_row"), F.substring("text_orig", 1, 12).alias("label"))


NORMAL = r"nullif(regexp_replace(regexp_replace(t, '<pb:[^>]*>|¶', '', 'g'), '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g'), '')"
PASSAGES = f"""lines AS (
  SELECT doc_id AS file_id, source AS book_id, lang AS family, unnest(string_split(text, chr(10))) AS t,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS row_no FROM documents
), passages AS (
  SELECT file_id, book_id, family, row_no, file_id * {STRIDE} + row_no AS passage_id, CASE WHEN {NORMAL} IS NULL THEN 'page' ELSE 'passage' END AS kind,
         t AS text_orig, {NORMAL} AS normalized_text FROM lines
)"""
SECTIONS = f"""{PASSAGES}, sections AS (SELECT file_id, row_no AS first_row, substr(text_orig, 1, 12) AS label FROM passages WHERE text_orig LIKE '%and%')"""
TURNS = "turns AS (SELECT conv_id AS file_id, turn AS row_no, role AS layer, text AS text_orig FROM conversations)"
