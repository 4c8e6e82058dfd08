"""The joins that ingest needs: vectors to mail, what is missing, what is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skip_existing(rows: DataFrame, stored: DataFrame, key: str = "email_id") -> DataFrame:
    return rows.join(stored.select(key), key, "left_anti")


def with_subject_vectors(mails: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mail with subject_vector and chunk_count, null where the store lacks them."""
    return mails.join(vectors.select("email_id", "subject_vector", "chunk_count"), "email_id", "left")


def missing_vectors(mails: DataFrame, vectors: DataFrame) -> DataFrame:
    return skip_existing(mails.select("email_id"), vectors)


def with_chunk_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("email_id", "chunk_index", "chunk_vector"), ["email_id", "chunk_index"], "left")


def chunk_count_mismatches(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """email_id, text_chunks, vector_chunks of mail whose numbers differ, mail on one side only included."""
    texts = chunks.groupBy("email_id").agg(F.count(F.lit(1)).alias("text_chunks"))
    stored = vectors.groupBy("email_id").agg(F.count(F.lit(1)).alias("vector_chunks"))
    both = texts.join(stored, "email_id", "full_outer")
    return both.select("email_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("text_chunks", "vector_chunks")]).where("text_chunks <> vector_chunks")


def ordered_chunk_vectors(vectors: DataFrame) -> DataFrame:
    """email_id and its chunk vectors in order."""
    pairs = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_vector")))
    return vectors.groupBy("email_id").agg(pairs.alias("p")).select("email_id", F.col("p.chunk_vector").alias("chunk_vectors"))
