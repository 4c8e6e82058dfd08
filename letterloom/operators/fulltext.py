"""BM25 full-text search over stored postings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Scores are rounded before they are ranked: sums differ in their last digits with the order of summation.
DIGITS = 9
COLUMNS = ("subject", "body_plain", "from_name", "from_address", "to_addresses_str", "cc_addresses_str", "labels_str")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass
class Index:
    """postings(term, key, tf, len), terms(term, df) and the one row of totals(docs, avg_len): tables, so that they can be
    stored and read. A posting knows its row's length, so a search reads the postings of its terms and nothing else."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame

    def write(self, path: str) -> None:
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        Index.of(self.postings.sparkSession.read.parquet(f"{path}/postings"), self.totals).terms.sort("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def of(postings: DataFrame, totals: DataFrame) -> Index:
        return Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals)

    @staticmethod
    def read(spark, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "totals")))


def build(rows: DataFrame, key: str = "email_id", columns: Sequence[str] = COLUMNS) -> Index:
    """Term counts are taken inside each row, so the postings leave the text once and already combined."""
    held = rows.select(F.col(key).alias("key"), tokens(F.concat_ws(" ", *columns)).alias("t"))
    postings = held.select("key", F.size("t").cast("long").alias("len"), F.explode("t").alias("term")).groupBy("term", "key", "len").agg(F.count(F.lit(1)).alias("tf"))
    return Index.of(postings, held.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t")).alias("avg_len")))


def _terms(query: str | Sequence[str]) -> list[str]:
    return sorted({t for t in re.findall(r"[^\W_]+", query.lower())} if isinstance(query, str) else {t.lower() for t in query})


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term)).cast("long")


def _part(tf: Column, df: Column) -> Column:
    """A term's part of the score; docs, avg_len and len are columns of the row."""
    idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def scan(rows: DataFrame, query: str | Sequence[str], k: int, key: str = "email_id", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """search() without an index: two scans, no shuffle of text or postings; terms are counted inside each row."""
    terms = _terms(query)
    held = rows.select(F.col(key).alias("key"), tokens(F.concat_ws(" ", *columns)).alias("t"))
    counted = held.select("key", F.size("t").cast("long").alias("len"), *[_times(F.col("t"), term).alias(f"tf{i}") for i, term in enumerate(terms)])
    totals = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = sum((_part(F.col(f"tf{i}"), F.col(f"df{i}")) for i in range(len(terms))), F.lit(0.0))
    found = F.lit(False)
    for i in range(len(terms)):
        found = found | (F.col(f"tf{i}") > 0)
    scored = counted.where(found).join(F.broadcast(totals)).select("key", F.round(score, DIGITS).alias("score"))  # totals: one row
    return scored.orderBy(F.desc("score"), "key").limit(k)


def search(index: Index, query: str | Sequence[str], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """key and score of the k best, ties by key; any of the terms may match. allowed: the keys to search among."""
    terms = _terms(query)
    wanted = F.col("term").isin(terms) if terms else F.lit(False)
    hits, df = index.postings.where(wanted), index.terms.where(wanted)
    if allowed is not None:
        hits = hits.join(allowed.select(F.col(allowed.columns[0]).alias("key")), "key", "left_semi")
    # One row for each term of the query, and one row of totals: bounded by the query.
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(index.totals))
    return scored.groupBy("key").agg(F.round(F.sum(_part(F.col("tf"), F.col("df"))), DIGITS).alias("score")).orderBy(F.desc("score"), "key").limit(k)
