"""One entry for mail inputs: JSON lines by suffix, anything else as MBOX; counts and raw bytes of many messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from letterloom.sources.mailjson import read_clean, read_lines
from letterloom.sources.mbox import read_mbox


def is_json(path: str) -> bool:
    return path.lower().endswith((".jsonl", ".json"))


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """Clean records of a JSON-lines path, raw messages of any other; several paths are a union in the caller."""
    return read_clean(spark, path)[0] if is_json(path) else read_mbox(spark, path)


def count_mail(spark: SparkSession, path: str) -> int:
    """Messages of a mailbox, or non-blank lines of a JSON-lines file."""
    return read_lines(spark, path).count() if is_json(path) else read_mbox(spark, path).select("offset").count()


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows with a counter that fills while they are written: no second pass for a stage's statistics."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def raw_messages(spark: SparkSession, mailbox: str, wanted: DataFrame) -> DataFrame:
    """email_id and raw bytes of many index rows at once: the index joined to the scan by file and place."""
    raw = read_mbox(spark, mailbox).select("mbox_file", "offset", "raw")
    return raw.join(wanted.select("email_id", "mbox_file", "offset"), ["mbox_file", "offset"]).select("email_id", "raw")


def head_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines of a text file; Spark reads a file's lines in order and stops when it has them."""
    return spark.read.text(path).limit(n)


def clean_names(mailbox: str, out_dir: str) -> dict[str, str]:
    """Where the clean, spam and summary outputs of a mailbox go."""
    stem = mailbox.rstrip("/").rpartition("/")[2].removesuffix(".mbox")
    return {"clean": f"{out_dir}/{stem}.clean.jsonl", "spam": f"{out_dir}/{stem}.spam.jsonl", "summary": f"{out_dir}/{stem}.summary.txt"}
