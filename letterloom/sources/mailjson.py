"""Cleaned mail as JSON lines: reading with error rows, and turning records into mail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.functions import headers as H
from letterloom.functions.ids import email_id, thread_id
from letterloom.functions.text import strip
from letterloom.operators.validate import kind_of
from letterloom.schemas import CLEAN

_LOCAL = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?"
_RFC = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?)(?:\s+([+-]\d{4}|[A-Z]{1,4}))?"
# The zone names that RFC 2822 gives, and their offsets.
ZONES = {
    "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (text) of the non-blank lines; a folder means its *.clean.jsonl files."""
    reader = spark.read
    if not path.rstrip("/").endswith((".jsonl", ".json")) and "*" not in path:
        reader = reader.option("pathGlobFilter", "*.clean.jsonl")
    return reader.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1, blank lines counted), line. Lines are counted by block of a file, and only these counts are
    added up, so no file goes through one task."""
    reader = spark.read
    if not path.rstrip("/").endswith((".jsonl", ".json")) and "*" not in path:
        reader = reader.option("pathGlobFilter", "*.clean.jsonl")
    block = ["file", "start"]
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"))
    counts = lines.groupBy(*block).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*block, "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(counts, block).select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), (F.col("before") + F.col("id") - F.col("first") + 1).alias("number"), "line")


def read_clean(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): records in the clean schema with their raw line; lines that are no JSON go to errors, with their
    number in the file and a message."""
    parsed = read_lines(spark, path).withColumn("v", F.try_parse_json("line"))
    good = parsed.where("v is not null").select("file", "line", record_of(F.col("v")).alias("r")).select("file", "line", "r.*")
    bad = numbered_lines(spark, path).where((F.trim("line") != "") & F.try_parse_json("line").isNull())
    return good, bad.select(F.lit("json_decode").alias("kind"), "file", "number", F.concat(F.lit("line "), F.col("number").cast("string"), F.lit(" is no JSON")).alias("error"), F.col("line").alias("raw"))


def record_of(v: Column) -> Column:
    """A VARIANT record in the clean schema. A sender or recipient may be an object or text, recipients and references a
    list or one text, and the place in the mailbox an object or mbox_file, mbox_offset and mbox_length of the record."""

    def text(path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def one(a: Column) -> Column:
        given = F.struct(F.try_variant_get(a, "$.name", "string").alias("name"), F.lower(F.try_variant_get(a, "$.email", "string")).alias("email"))
        return F.when(kind_of(a) == "OBJECT", given).when(kind_of(a) == "STRING", H.address(F.try_variant_get(a, "$", "string")))

    def several(path: str) -> Column:
        a = F.try_variant_get(v, path, "variant")
        listed = F.filter(F.transform(F.try_variant_get(a, "$", "array<variant>"), one), lambda x: x.isNotNull())
        return F.when(kind_of(a) == "ARRAY", listed).when(kind_of(a) == "STRING", H.address_list(F.try_variant_get(a, "$", "string")))

    refs = F.try_variant_get(v, "$.headers.references", "variant")
    listed = F.transform(F.try_variant_get(refs, "$", "array<variant>"), lambda r: F.trim(F.try_variant_get(r, "$", "string")))
    references = F.filter(F.when(kind_of(refs) == "ARRAY", listed).when(kind_of(refs) == "STRING", F.split(F.trim(F.try_variant_get(refs, "$", "string")), r"\s+")), lambda r: r != "")
    made = F.struct(
        F.struct(
            one(F.try_variant_get(v, "$.headers.from", "variant")).alias("from"), several("$.headers.to").alias("to"), several("$.headers.cc").alias("cc"),
            *[text(f"$.headers.{n}").alias(n) for n in ("subject", "date", "message_id", "in_reply_to")], references.alias("references"),
            *[text(f"$.headers.{n}").alias(n) for n in ("thread_id", "list_id")],
        ).alias("headers"),
        F.try_variant_get(v, "$.tags", "array<string>").alias("tags"),
        F.transform(F.try_variant_get(v, "$.content", "array<variant>"), lambda b: F.struct(F.try_variant_get(b, "$.type", "string").alias("type"), F.try_variant_get(b, "$.body", "string").alias("body"))).alias("content"),
        F.transform(F.try_variant_get(v, "$.attachments", "array<variant>"), lambda f: F.struct(F.try_variant_get(f, "$.filename", "string").alias("filename"), F.try_variant_get(f, "$.content_type", "string").alias("content_type"), F.try_variant_get(f, "$.size", "bigint").alias("size"))).alias("attachments"),
        F.struct(*[F.coalesce(F.try_variant_get(v, f"$.mbox.{n}", t), F.try_variant_get(v, f"$.mbox_{n}", t)).alias(n) for n, t in (("file", "string"), ("offset", "bigint"), ("length", "bigint"))]).alias("mbox"),
    )
    return made.cast(T.StructType.fromDDL(CLEAN))


def wall_clock(date: Column) -> Column:
    """The date text's own wall clock, whatever its offset; null for text that is no date."""
    iso = F.concat_ws(" ", F.regexp_extract(date, _LOCAL, 1), F.coalesce(F.nullif(F.regexp_extract(date, _LOCAL, 2), F.lit("")), F.lit("00:00:00")))
    rfc = F.regexp_extract(date, _RFC, 1)
    seconds = F.when(rfc.rlike(":.*:"), rfc).otherwise(F.concat(rfc, F.lit(":00")))
    return F.coalesce(
        F.when(date.rlike(_LOCAL), iso.try_cast("timestamp_ntz")),
        F.when(date.rlike(_RFC), F.try_to_timestamp(seconds, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")),
    )


def iso_text(date: Column) -> Column:
    """A date in ISO form with its offset, as text; RFC 2822 dates too. An unknown zone and -0000 give no offset."""
    zone = F.regexp_extract(date, _RFC, 2)
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), zone)
    offset = F.when(zone == "-0000", "").when(zone.rlike("^[+-]"), F.regexp_replace(zone, "^(...)(..)$", "$1:$2")).otherwise(F.coalesce(named, F.lit("")))
    rfc = F.concat(F.date_format(wall_clock(date), "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return F.when(date.rlike(_LOCAL), F.regexp_replace(date, "Z$", "+00:00")).when(date.rlike(_RFC), rfc)


def addresses(list_: Column) -> Column:
    return F.transform(F.filter(list_, lambda a: F.coalesce(a["email"], F.lit("")) != ""), lambda a: a["email"])


def to_emails(records: DataFrame) -> DataFrame:
    """Mail rows of clean records: missing texts become empty, the body is the text blocks, whole, joined by a blank line."""
    h = F.col("headers")
    blocks = F.filter("content", lambda b: (b["type"] == "text") & (strip(F.coalesce(b["body"], F.lit(""))) != ""))
    body = F.array_join(F.transform(blocks, lambda b: strip(b["body"])), "\n\n")
    date = wall_clock(h["date"])
    subject, sender = F.coalesce(h["subject"], F.lit("")), F.coalesce(h["from"]["email"], F.lit(""))
    labels = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t) != "")
    files = F.coalesce("attachments", F.array().cast("array<struct<filename:string,content_type:string,size:bigint>>"))
    return records.select(
        email_id(h["message_id"], sender, iso_text(h["date"]), subject).alias("email_id"),
        F.coalesce(h["message_id"], F.lit("")).alias("message_id"),
        subject.alias("subject"),
        sender.alias("from_address"),
        F.coalesce(h["from"]["name"], F.lit("")).alias("from_name"),
        F.concat_ws(",", addresses(h["to"])).alias("to_addresses_str"),
        F.concat_ws(",", addresses(h["cc"])).alias("cc_addresses_str"),
        date.alias("date"),
        F.coalesce(body, F.lit("")).alias("body_plain"),
        (F.size(files) > 0).alias("has_attachment"),
        F.transform(files, lambda f: f["filename"]).alias("attachment_names"),
        F.transform(files, lambda f: f["content_type"]).alias("attachment_types"),
        F.concat_ws(",", labels).alias("labels_str"),
        h["in_reply_to"].alias("in_reply_to"),
        thread_id(h["thread_id"], h["references"], h["in_reply_to"], subject).alias("thread_id"),
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.col("mbox.file").alias("mbox_file"),
        F.col("mbox.offset").alias("mbox_offset"),
        F.col("mbox.length").alias("mbox_length"),
    )
