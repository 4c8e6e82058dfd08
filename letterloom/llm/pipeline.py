"""The corpus pipeline: documents to a weighted training mix, stage by stage, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import scratch, table, unused
from letterloom.llm.decontaminate import decontaminate
from letterloom.llm.linededup import dedup_lines
from letterloom.llm.mixing import DOMAINS, copies, mix
from letterloom.llm.neardup import keep_one_similar
from letterloom.llm.quality import fit, keep_good

#: A document that holds a window of one benchmark item is leaked; the operator's own query asks for two.
LEAKED_ITEMS = 1


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are judged as empty ones; repeated rows and null ids
    are judged row by row; an empty table gives none; other columns, whatever their names, stay as they are."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs are deleted from the texts, and n_chars follows; a document that has only such runs goes.

    Null and empty texts have no runs and stay. A null id comes last. Rows equal in id and text are one document and keep
    their runs. An empty table gives none. Other columns, whatever their names, stay as they are."""
    names = unused(docs.columns, "deleted_lines", "deleted_words", "emptied")
    left = dedup_lines(docs, added=names).where(~F.col(names[2]))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of texts whose five-word shingles have a similarity of 0.8 or more, the one with the
    smallest id (a null id last). Null and wordless texts are one group; of repeated rows one stays; an empty table gives
    none; other columns, whatever their names, stay as they are."""
    return keep_one_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null and empty texts hold none; repeated rows go or stay together; null
    ids make no difference; an empty table gives none; other columns, whatever their names, stay as they are."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=LEAKED_ITEMS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the rate, and the whole copies, that bring the domains to their target weights.

    Added: n_tokens, p_ of every domain, rate, n_copies; columns of docs that have these names give way. Null and empty
    texts have no tokens and the posterior of an empty text; repeated rows share a rate, null ids keep their rows; an empty
    table gives none."""
    added = ["n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "n_copies"]
    kept = [c for c in docs.columns if c.lower() not in (*added, "_shares", "_tokens", "_rate")]
    mixed = mix(docs, table(spark, sf_dir, "labels"), keep=kept)
    posterior = [F.col("_shares")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return mixed.select(*kept, F.col("_tokens").alias("n_tokens"), *posterior, F.col("_rate").alias("rate"), copies(F.col("_rate"), "doc_id", F.xxhash64("text")).alias("n_copies"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: No stage's classifier or fingerprint can be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages' tables stay in the scratch folder until the driver's Python ends."""
    root = f"{scratch(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{root}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
