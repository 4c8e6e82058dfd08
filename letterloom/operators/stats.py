"""Counts over mail and over the stages that made it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.operators.filters import filtered


def count_where(mails: DataFrame, test: Column | None = None) -> DataFrame:
    return filtered(mails, test).agg(F.count(F.lit(1)).alias("n"))


def top_senders(mails: DataFrame, year: int | None = None, limit: int = 10) -> DataFrame:
    """Exact counts, the most first, equal ones by address."""
    rows = mails if year is None else mails.where(F.col("year") == year)
    return rows.groupBy("from_address").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_address").limit(limit)


def count_by_year(mails: DataFrame) -> DataFrame:
    return mails.where(F.col("year").isNotNull() & (F.col("year") != 0)).groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy("year")


def by_period(messages: DataFrame) -> DataFrame:
    return messages.groupBy("period").agg(F.count(F.lit(1)).alias("emails"), F.sum("length").alias("bytes")).orderBy("period")


def histogram(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n")).orderBy(reason)


def spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    """mean, min, max and sample deviation of a value by group, for rates and timings."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("deviation"))


def summary_text(source: str, clean: int, reasons: dict[str, int], errors: int, original_bytes: int, clean_bytes: int, spam_bytes: int) -> str:
    """The cleanup report: counts, spam reasons in order, sizes and the reduction in percent."""
    spam = sum(reasons.values())
    reduction = (1 - clean_bytes / original_bytes) * 100 if original_bytes else 0.0
    rows = [f"Cleanup of {source}", f"processed: {clean + spam + errors}", f"clean: {clean}", f"spam: {spam}", f"errors: {errors}"]
    rows += [f"  {reason}: {n}" for reason, n in sorted(reasons.items())]
    rows += [f"original bytes: {original_bytes}", f"clean bytes: {clean_bytes}", f"spam bytes: {spam_bytes}", f"reduction: {reduction:.1f}%"]
    return "\n".join(rows) + "\n"
