"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.hmm import score

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr("id as doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.wrappers import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.exact_dedup import exact_groups

    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.selectExpr("id as doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import warc
    from lectern.llm.common import shared_dir

    pages, path = spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark)
    warc.write(pages, path)
    found = warc.payloads(warc.read(spark, path), pages.schema["page_id"].dataType.simpleString())
    return found.selectExpr("row_id as page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.simhash import near_groups

    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.selectExpr("id as doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.url_rules import judge

    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    rules = spark.createDataFrame(rules, "host string, path string, action string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, "page_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality import classify

    scored = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.selectExpr("id as doc_id", "expected_grade", "tail_probability", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.decontaminate import overlaps

    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.selectExpr("id as doc_id", "item_id", "first_word", "n_words", "n_equal", "coverage")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.licenses import scan

    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr("id as doc_id", "license", "version", "first_word", "n_words", "n_differing", "differing", "saved")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lectern.llm.bpe import make_codec, round_trip

    codec = make_codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), codec)


def queries() -> dict:
    return {f.__name__: f for f in (op1_hmm, op2_html_text, op3_exact_dedup, op4_warc, op5_simhash, op6_url_filter, op7_quality, op8_decontamination, op9_licenses, op10_byte_bpe)}


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

URL_SQL = """
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(rule, h, p, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT u.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": EXACT_SQL, "op6_url_filter": URL_SQL}
