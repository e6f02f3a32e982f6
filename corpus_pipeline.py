"""A corpus pipeline in five stages: good documents, one of each exact text, one of each near-duplicate group, none with benchmark passages, as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and gives the next stage what it
reads back, so a stage is never computed twice and a lost executor costs no more than the tasks of the stage at work.

Null and empty texts are equal to each other, so one of them stays; a null id counts as an id, smaller than others in exact_dedup and after all others in near_dedup.
Repeated rows are copies. Without labels every document is good. Empty tables give empty results; other columns, whatever their names, pass through all stages but the
last, which gives doc_id, n_tokens, token_ids and two digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, decontaminate, exact_dedup, quality, similar
from lectern.llm.common import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.deduplicate(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bpe.make_codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.tokenized(docs, codec)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", dissimilar), ("decontamination", uncontaminated), ("byte_bpe", tokens)]

#: SQL can express neither the classifier nor the token ids; the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
