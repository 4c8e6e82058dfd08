"""The build path: mailboxes to cleaned, indexed, embedded and stored mail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import headers as H
from letterloom.functions import text as X
from letterloom.functions.chunks import CHUNK_CHARS, OVERLAP_CHARS, exploded
from letterloom.functions.embed import EmbeddingProvider, embedded
from letterloom.functions.ids import email_id
from letterloom.functions.mime import body_of
from letterloom.operators import joins
from letterloom.operators.validate import validated
from letterloom.plans.store import Store, embedding_meta
from letterloom.schemas import CLEAN, columns
from letterloom.sources.mailjson import iso_text, record_of, to_emails

#: Of a body so much is stored with its mail; chunks hold all of it.
BODY_CHARS = 10_000
STAGES = ("model", "split", "preprocess", "vectorize", "ingest")
ALIASES = {"download": "model", "clean": "preprocess", "index": "preprocess"}


def stage_set(text: str | None) -> list[str]:
    """Stages of a comma list, aliases resolved, in running order; all of them for nothing or `all`."""
    wanted = [s.strip().lower() for s in (text or "all").split(",") if s.strip()]
    if wanted == ["all"]:
        return list(STAGES)
    found = {ALIASES.get(s, s) for s in wanted}
    if unknown := found - set(STAGES):
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    return [s for s in STAGES if s in found]


def write_split(messages: DataFrame, path: str, years: list[int] | None = None) -> DataFrame:
    """Messages into period= folders; returns the counts by period. A period spreads over as many tasks as its
    size asks for."""
    rows = messages if not years else messages.where(F.col("year").isin(years))
    rows.hint("rebalance", F.col("period")).write.mode("overwrite").partitionBy("period").parquet(path)
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("emails"), F.sum("length").alias("bytes"))


@dataclass
class Preprocessed:
    clean: DataFrame
    spam: DataFrame
    index: DataFrame
    parsed: DataFrame


def _index_id(h: Column) -> Column:
    sender = H.address(H.header(h, "from"))["email"]
    return email_id(H.message_id(H.header(h, "message-id")), F.coalesce(sender, F.lit("")), iso_text(H.header(h, "date")), F.coalesce(H.header(h, "subject"), F.lit("")))


def preprocess(messages: DataFrame, keep: bool = True) -> Preprocessed:
    """Clean records, spam rows and the byte index of raw messages. Headers are parsed once; bodies only of mail that
    isn't spam, for the spam test stands between the two Python steps. keep caches the parsed rows for several outputs."""
    parsed = messages.select("mbox_file", "offset", "length", "raw", H.headers_of("raw").alias("h")).withColumn("reason", H.spam_reason(F.col("h")))
    parsed = parsed.persist(StorageLevel.MEMORY_AND_DISK) if keep else parsed
    h = F.col("h")

    def get(name: str) -> Column:
        return H.header(h, name)

    spam = parsed.where("reason is not null").select(*[F.coalesce(get(n), F.lit("")).alias(n) for n in ("from", "subject", "date")], "reason")
    ident = H.message_id(get("message-id"))
    index = parsed.select(_index_id(h).alias("email_id"), ident.alias("message_id"), F.lower(ident).alias("message_id_lower"), "mbox_file", "offset", "length")
    bodies = parsed.where("reason is null").withColumn("b", body_of("raw"))
    text = F.coalesce(X.normalize_body(F.col("b.plain")), X.html_to_text(F.col("b.html")), F.lit(""))
    body = X.remove_signature(X.clean_text(text))

    def none_if_empty(list_: Column) -> Column:
        return F.when(F.size(list_) > 0, list_)

    clean = bodies.withColumn("body", body).select(
        F.struct(
            H.address(get("from")).alias("from"), none_if_empty(H.address_list(get("to"))).alias("to"), none_if_empty(H.address_list(get("cc"))).alias("cc"),
            F.nullif(F.trim(get("subject")), F.lit("")).alias("subject"), F.nullif(get("date"), F.lit("")).alias("date"), ident.alias("message_id"),
            H.message_id(get("in-reply-to")).alias("in_reply_to"), none_if_empty(H.reference_list(get("references"))).alias("references"),
            F.nullif(F.trim(F.coalesce(get("x-gm-thrid"), get("thread-id"))), F.lit("")).alias("thread_id"), H.list_id(get("list-id")).alias("list_id"),
        ).alias("headers"),
        none_if_empty(H.comma_list(get("x-gmail-labels"))).alias("tags"),
        F.when(F.col("body") != "", F.array(F.struct(F.lit("text").alias("type"), F.col("body").alias("body")))).otherwise(F.array().cast("array<struct<type:string,body:string>>")).alias("content"),
        none_if_empty(F.col("b.attachments")).alias("attachments"),
        F.struct(F.col("mbox_file").alias("file"), "offset", "length").alias("mbox"),
    )
    return Preprocessed(clean.select(*columns(CLEAN)), spam, index, parsed)


def find(index: DataFrame, email_id: str | None = None, message_id: str | None = None) -> DataFrame:
    """The first index row by mailbox place that has the id; message ids also match in lower case, after exact ones."""
    if (email_id is None) == (message_id is None):
        raise ValueError("give exactly one of email_id and message_id")
    test = F.col("email_id") == email_id if email_id else (F.col("message_id") == message_id) | (F.col("message_id_lower") == message_id.lower())
    exact = F.lit(True) if email_id else F.col("message_id") == message_id
    return index.where(test).orderBy(F.desc(F.coalesce(exact, F.lit(False))), "mbox_file", "offset").limit(1)


def build_index(messages: DataFrame) -> DataFrame:
    """The byte index of raw messages alone: headers are parsed, bodies not."""
    h, ident = F.col("h"), H.message_id(H.header(F.col("h"), "message-id"))
    rows = messages.select("mbox_file", "offset", "length", H.headers_of("raw").alias("h"))
    return rows.select(_index_id(h).alias("email_id"), ident.alias("message_id"), F.lower(ident).alias("message_id_lower"), "mbox_file", "offset", "length")


def first_mails(mails: DataFrame, limit: int | None) -> DataFrame:
    """The first mails by place in the mailboxes; all without a limit."""
    return mails if limit is None else mails.orderBy("mbox_file", "mbox_offset", "email_id").limit(limit)


def good_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of raw JSON lines: valid ones in the clean schema; the others with their issues."""
    checked = validated(lines)
    good = checked.where(F.col("record").isNotNull() & (F.size("issues") == 0)).select(record_of(F.col("record")).alias("r")).select("r.*")
    bad = checked.where(F.col("record").isNull() | (F.size("issues") > 0))
    kind = F.when(F.col("record").isNull(), "json_decode").otherwise("validation")
    return good, bad.select(kind.alias("kind"), F.col("line").alias("raw"), "issues")


def vectorize(mails: DataFrame, by: EmbeddingProvider, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(email_vectors, chunk_vectors) of mail rows, or the first of them: the subject's vector, and one for each chunk of the
    cleaned body, the whole of it."""
    mails = first_mails(mails, limit)
    subject = embedded(F.trim(F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")))), by)
    chunks = exploded(mails.select("email_id", X.clean_for_embedding(F.col("body_plain")).alias("body")), F.col("body"), size, overlap)
    counts = chunks.groupBy("email_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    vectors = mails.select("email_id", subject.alias("subject_vector")).join(counts, "email_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return vectors, chunks.select("email_id", "chunk_index", embedded(F.col("chunk_text"), by).alias("chunk_vector"))


def ingest(store: Store, records: DataFrame, by: EmbeddingProvider, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, skip_existing: bool = True, repair: bool = True, limit: int | None = None) -> int:
    """Stores clean records, or the first of them: mails and chunks with their vectors, those in the embedding tables where
    they are and fit, fresh ones (repair) or an error where not. Chunks are made of whole bodies; of a body itself BODY_CHARS
    are stored. Running it twice stores nothing twice: chunks come first, those that are there passed over, and a mail is
    stored once its chunks are. Returns the mails stored."""
    store.ensure_meta(embedding_meta(by, size, overlap))
    mails = first_mails(to_emails(records), limit)
    if skip_existing and store.exists("emails"):
        mails = joins.skip_existing(mails, store.read("emails"))
    mails = mails.persist(StorageLevel.MEMORY_AND_DISK)
    body = X.clean_for_embedding(F.col("body_plain"))
    chunks = exploded(mails.select("*", body.alias("_body")), F.col("_body"), size, overlap)
    have, have_chunks = store.read("email_vectors"), store.read("chunk_vectors")
    lacking = joins.missing_vectors(mails, have).unionByName(joins.chunk_count_mismatches(chunks.select("email_id", "chunk_index"), joins_semi(have_chunks, mails)).select("email_id")).distinct()
    if not lacking.isEmpty():
        if not repair:
            raise ValueError("mail without stored vectors, or with vectors for other chunks")
        again = mails.join(lacking, "email_id", "left_semi")
        vectors, chunk_vectors = vectorize(again, by, size, overlap)
        have = joins.skip_existing(have, lacking).unionByName(vectors)
        have_chunks = joins.skip_existing(have_chunks, lacking).unionByName(chunk_vectors)
    rows = joins.with_subject_vectors(mails, have)
    parts = joins.with_chunk_vectors(chunks, have_chunks).select("*", F.col("chunk_vector").alias("body_vector"), F.concat("email_id", F.lit(":"), F.col("chunk_index").cast("string")).alias("chunk_id"))
    n = mails.count()
    if skip_existing and store.exists("email_chunks"):
        parts = joins.skip_existing(parts, store.read("email_chunks"), "chunk_id")
    store.append(parts.withColumn("chunk_text", F.left("chunk_text", F.lit(5000))), "email_chunks")
    store.append(rows.withColumn("body_plain", F.left("body_plain", F.lit(BODY_CHARS))), "emails")
    mails.unpersist()
    return n


def joins_semi(vectors: DataFrame, mails: DataFrame) -> DataFrame:
    return vectors.join(mails.select("email_id"), "email_id", "left_semi")
