"""The catalog of books: its checks, on a table with one row per book."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed witnesses of a book's number of volumes.
WITNESSES = ("corpus", "declared", "none")


def problems(books: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, problem: ids that occur twice, and each check that a book fails. A check is a condition that must hold; null fails."""
    twice = books.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.lit("duplicate id").alias("problem"))
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return twice.unionByName(books.select(key, F.explode(failed).alias("problem")))


def standard_checks() -> dict[str, Column]:
    """What must hold for dir, volume_witness, expected_volumes and declared_volumes."""
    return {
        "no folder": F.length("dir") > 0,
        "unknown witness": F.col("volume_witness").isin(*WITNESSES),
        "bad number of volumes": F.coalesce(F.col("expected_volumes") > 0, F.lit(True)),
        "declared without number": (F.col("volume_witness") != "declared") | F.col("declared_volumes").isNotNull(),
    }


def require(books: DataFrame, key: str = "book_id") -> DataFrame:
    """The catalog itself, if it has no problems; else an error that lists the first of them."""
    found = problems(books, key, standard_checks()).orderBy(key, "problem").limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r[key]}: {r.problem}" for r in found))
    return books


def union_of_layers(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Fixed names of a book's states.
STATES = ("verified", "partial", "warning", "failed", "imported", "planned")


def reconciled(catalog: DataFrame, held: DataFrame, key: str = "book_id") -> DataFrame:
    """Each book of the catalog or of the store with its state: key, status, catalog_gap (held, but not in the catalog).

    catalog: key, recall_verified; held: key, coverage (OK, WARN or FAIL), indexed (the index finds the book's own text), volumes (complete, partial or unknown).
    A book that is not held is planned; one that fails its coverage or its index has failed; then come a low coverage, missing volumes, and books that were
    checked against their queries.
    """
    both = catalog.select(key, "recall_verified", F.lit(True).alias("_listed")).join(held.select(key, "coverage", "indexed", "volumes", F.lit(True).alias("_held")), key, "full_outer")
    status = (
        F.when(F.col("_held").isNull(), "planned").when((F.col("coverage") == "FAIL") | ~F.coalesce("indexed", F.lit(False)), "failed").when(F.col("coverage") == "WARN", "warning")
        .when(F.col("volumes") == "partial", "partial").when(F.coalesce("recall_verified", F.lit(False)), "verified").otherwise("imported")
    )
    return both.select(key, status.alias("status"), F.col("_listed").isNull().alias("catalog_gap"))
