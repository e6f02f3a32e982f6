"""Dense retrieval and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed constant of reciprocal rank fusion, and the part of the shorter span from which two results count as the same.
FUSION, OVERLAP = 60, 0.8
#: Fixed bounds of a result list and of the candidates that are compared with each other.
MOST, CANDIDATES = 100, 600


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k vectors with the largest inner product among those that pass the filter; ties by key. key, score."""
    if not 1 <= k <= MOST:
        raise ValueError(f"k must lie between 1 and {MOST}, not {k}")
    rows = vectors if where is None else vectors.where(where)
    scored = rows.select(key, inner_product(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def ranked(rows: DataFrame, order: list, into: str = "rank") -> DataFrame:
    """A short list with ranks from 1. For lists that a limit has already bounded."""
    return rows.withColumn(into, F.row_number().over(Window.orderBy(*order)))


def fuse(lists: dict[str, DataFrame], key: str, limit: int) -> DataFrame:
    """Reciprocal rank fusion of short lists (key, rank): key, score, channels."""
    votes = reduce(DataFrame.unionByName, (f.select(key, (1.0 / (FUSION + F.col("rank"))).alias("_v"), F.lit(name).alias("_c")) for name, f in lists.items()))
    out = votes.groupBy(key).agg(F.sum("_v").alias("score"), F.array_join(F.array_sort(F.collect_set("_c")), ",").alias("channels"))
    return out.orderBy(F.desc("score"), key).limit(limit)


def without_overlaps(rows: DataFrame, order: str, source: str, start: str, end: str, limit: int = 20) -> DataFrame:
    """Results in order, leaving out each that shares OVERLAP of the shorter span with one before it. The first CANDIDATES by order are looked at."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        for i, r in pdf.iterrows():
            inside = lambda j: pdf[source][j] == r[source] and min(pdf[end][j], r[end]) - max(pdf[start][j], r[start]) >= OVERLAP * max(1, min(pdf[end][j] - pdf[start][j], r[end] - r[start]))  # noqa: E731, B023
            if not any(inside(j) for j in kept):
                kept.append(i)
            if len(kept) == limit:
                break
        return pdf.iloc[kept]

    names = rows.columns
    return rows.orderBy(order).limit(CANDIDATES).groupBy(F.lit(1).alias("_one")).applyInPandas(lambda pdf: keep(pdf)[names], rows.schema)


def encoded(texts: DataFrame, encoder, text: str, into: str = "embedding", tokens: int = 512, size: int | None = None) -> DataFrame:
    """texts with their vectors from a model. encoder: a picklable object with load() -> a function of a list of texts to a list of vectors, called once for each worker
    and then by Arrow batch; tokens: white-space separated words, beyond which a text is refused rather than cut (as the model would cut it silently)."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder.load()
        for batch in batches:
            own = batch.fillna("").tolist()
            for t in own:
                if len(t.split()) > tokens:
                    raise ValueError(f"a text of {len(t.split())} words is longer than the encoder's {tokens}")
            vectors = [list(map(float, v)) for v in model(own)] if own else []
            if size and any(len(v) != size for v in vectors):
                raise ValueError(f"the encoder's vectors have not {size} numbers")
            yield pd.Series(vectors, index=batch.index, dtype=object)

    return texts.withColumn(into, run(F.col(text)))
