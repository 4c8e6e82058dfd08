"""Schemas of the stored tables, as DDL texts: they can be read without a session, in a data source's worker too."""

from __future__ import annotations

RAW_MESSAGES = "mbox_file string, offset bigint, length bigint, raw binary, year int, month int, period string"

ADDRESS = "struct<name:string,email:string>"
CLEAN = (
    f"headers struct<from:{ADDRESS},to:array<{ADDRESS}>,cc:array<{ADDRESS}>,subject:string,date:string,message_id:string,"
    "in_reply_to:string,references:array<string>,thread_id:string,list_id:string>, "
    "tags array<string>, content array<struct<type:string,body:string>>, "
    "attachments array<struct<filename:string,content_type:string,size:bigint>>, "
    "mbox struct<file:string,offset:bigint,length:bigint>"
)
SPAM = "`from` string, subject string, date string, reason string"
MBOX_INDEX = "email_id string, message_id string, message_id_lower string, mbox_file string, offset bigint, length bigint"
EMAIL_VECTORS = "email_id string, subject_vector array<float>, chunk_count int"
CHUNK_VECTORS = "email_id string, chunk_index int, chunk_vector array<float>"

_MAIL = "subject string, from_address string, from_name string, to_addresses_str string, cc_addresses_str string, date timestamp_ntz"
_REST = "has_attachment boolean, attachment_names array<string>, attachment_types array<string>, labels_str string, in_reply_to string"
_PLACE = "year int, month int, mbox_file string, mbox_offset bigint, mbox_length bigint"
EMAILS = f"email_id string, message_id string, {_MAIL}, body_plain string, {_REST}, thread_id string, {_PLACE}, subject_vector array<float>"
EMAIL_CHUNKS = f"chunk_id string, email_id string, message_id string, thread_id string, chunk_index int, chunk_text string, {_MAIL}, {_REST}, {_PLACE}, body_vector array<float>"


def columns(schema: str) -> list:
    """The schema's columns , cast to its types and in its order."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    return [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)]
