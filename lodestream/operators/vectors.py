"""Cosine search over an array column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def top_k(df: DataFrame, vector_col: str, id_col: str, query: Sequence[float], k: int = 5, least: float | None = None) -> DataFrame:
    """The k rows nearest to one query vector: a projection and a distributed top-k, no shuffle of the table."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.select(id_col, cosine(F.col(vector_col), q).alias("similarity"))
    if least is not None:
        scored = scored.where(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)
