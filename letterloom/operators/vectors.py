"""Exact vector search by squared L2 distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.operators.filters import filtered


def distance(vector: Column, query: Sequence[float] | Column) -> Column:
    """Squared L2 distance in double precision, in the JVM. The query travels as one literal array."""
    if not isinstance(query, Column):
        query = F.lit([float(x) for x in query])
    return F.aggregate(F.zip_with(vector, query, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, query: Sequence[float] | Column, k: int, key: str = "email_id", vector: str = "subject_vector", test: Column | None = None) -> DataFrame:
    """The k nearest rows with distance, ties by key; the filter comes before the distance, and each task keeps k rows."""
    return filtered(rows, test).withColumn("distance", distance(F.col(vector), query)).orderBy("distance", key).limit(k)


def similar(rows: DataFrame, key_value, k: int, key: str = "email_id", vector: str = "subject_vector") -> DataFrame:
    """The k rows nearest to the one with the given key, itself left out."""
    own = rows.where(F.col(key) == key_value).limit(1).select(vector).first()
    if own is None or own[0] is None:
        return rows.withColumn("distance", F.lit(0.0)).limit(0)
    return nearest(rows.where(F.col(key) != key_value), list(own[0]), k, key, vector)


def best_per_mail(hits: DataFrame, key: str = "email_id") -> DataFrame:
    """Of ranked chunk hits (key, rank, ...) the best of each mail."""
    rest = [c for c in hits.columns if c not in (key, "rank")]
    best = F.min_by(F.struct(*rest), "rank") if rest else None
    out = hits.groupBy(key).agg(F.min("rank").alias("rank"), *([best.alias("_best")] if rest else []))
    return out.select(key, "rank", "_best.*") if rest else out
