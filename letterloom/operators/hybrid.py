"""Hybrid ranking: weighted reciprocal-rank fusion of subject, chunk and full-text hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    k: int = 60
    subject: float = 1.2
    body: float = 1.0
    fulltext: float = 0.4


def overfetch(limit: int) -> tuple[int, int, int]:
    """How many subject, chunk and full-text hits to rank for a result of limit."""
    return max(2 * limit, 20), max(5 * limit, 80), max(3 * limit, 30)


def ranked(hits: DataFrame, *order) -> DataFrame:
    """hits, already limited to a few, with rank from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(subject: DataFrame, body: DataFrame, fulltext: DataFrame, limit: int, weights: Weights = Weights()) -> DataFrame:
    """Each input has (key, rank), body one row for each chunk hit. A mail's vector part is the better of its subject
    and its best chunk; the full-text part adds to it. One union and one aggregate; ties go by key. shown says which
    hit represents the mail."""
    sources = [(subject, "s"), (body, "b"), (fulltext, "f")]
    every = None
    for rows, source in sources:
        part = rows.select("key", "rank", F.lit(source).alias("source"))
        every = part if every is None else every.unionByName(part)

    def best(source: str):
        return F.min(F.when(F.col("source") == source, F.col("rank")))

    grouped = every.groupBy("key").agg(best("s").alias("subject_rank"), best("b").alias("body_rank"), best("f").alias("fts_rank"))

    def score(weight: float, rank: str):
        return F.coalesce(F.lit(float(weight)) / (weights.k + F.col(rank)), F.lit(0.0))

    s, b, f = score(weights.subject, "subject_rank"), score(weights.body, "body_rank"), score(weights.fulltext, "fts_rank")
    shown = F.when(F.col("body_rank").isNotNull() & (b >= s), "body").when(F.col("subject_rank").isNotNull(), "subject").otherwise("fulltext")
    out = grouped.select("key", (f + F.greatest(s, b)).alias("score"), F.least("subject_rank", "body_rank").alias("vector_rank"), "fts_rank", shown.alias("shown"))
    return out.orderBy(F.desc("score"), "key").limit(limit)
