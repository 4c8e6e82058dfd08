"""An inbox that grows: cleaned mail as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from letterloom.functions.embed import EmbeddingProvider
from letterloom.plans.stages import ingest
from letterloom.plans.store import Store
from letterloom.sources.mailjson import record_of, to_emails


def clean_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.jsonl").text(folder)
    return lines.select(F.try_parse_json("value").alias("v")).where("v is not null").select(record_of(F.col("v")).alias("r")).select("r.*")


def follow(spark: SparkSession, folder: str, store: Store, by: EmbeddingProvider, checkpoint: str) -> StreamingQuery:
    """Ingests each new file once; the checkpoint remembers which, and a repeated batch stores nothing twice."""

    def batch(rows: DataFrame, _: int) -> None:
        ingest(store, rows, by)

    return clean_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def daily_counts(mails: DataFrame, late: str = "2 days") -> DataFrame:
    """Mails by day and sender, late ones within the watermark included."""
    timed = mails.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day"), "from_address").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "from_address", "n")


def daily_sender_stream(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    return daily_counts(to_emails(clean_stream(spark, folder)), late)
