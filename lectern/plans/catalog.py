"""Registry of the engine's own queries and of the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import annals, corpus, inquiry, more, registry, relational, retrieval, sequence  # noqa: F401  registers on import
from lectern.plans.relational import O08_paging


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over passages, a page of results in source order."""
    return O08_paging(spark, sf_dir)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
