"""Duplicate statistics, keep-first dedupe, upserts and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_stats(rows: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """total, unique, duplicate_keys and duplicate_rows in one row; counted in two stages, partial sums first."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def top_duplicates(rows: DataFrame, key: str | Sequence[str], limit: int = 5) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), *keys).limit(limit)


def _ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return _ranked(rows, keys, order, 1)


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """At most n rows of each key; planned with a group limit before the shuffle."""
    return _ranked(rows, keys, order, n)


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stored with the batch's rows in place of those with equal keys. Within the batch, keys must be unique."""
    return stored.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)


def sample_sequential(rows: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def sample_random(rows: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows drawn without replacement, the same for the same seed and rows."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)
