"""Message and thread identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash16(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def email_id(message_id: Column, from_address: Column, date_iso: Column, subject: Column) -> Column:
    """By the message id; without one by sender, ISO date and the first 100 characters of the subject."""
    fallback = F.concat_ws("|", F.coalesce(from_address, F.lit("")), F.coalesce(date_iso, F.lit("")), F.substring(F.coalesce(subject, F.lit("")), 1, 100))
    return hash16(F.coalesce(F.nullif(message_id, F.lit("")), fallback))


def thread_id(given: Column, references: Column, in_reply_to: Column, subject: Column) -> Column:
    """The header's own, else by the first reference, the message replied to, or the subject without a reply prefix."""

    def of(text: Column) -> Column:
        return hash16(F.nullif(text, F.lit("")))

    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(subject, F.lit("")))), r"^(re:|fwd?:)\s*", "")
    return F.coalesce(F.nullif(given, F.lit("")), of(F.get(references, 0)), of(in_reply_to), of(bare))
