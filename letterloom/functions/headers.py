"""Header parsing. Unfolding and RFC 2047 decoding are one Arrow function; what follows are column expressions."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from datetime import datetime
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

# Senders and mailers that mark bulk mail.
SPAM_SENDERS = ("discard-report@pobox.com", "mailer-daemon@", "postmaster@")
BULK_MAILERS = (
    "cheetahmailer", "mailchimp", "sailthru", "constant contact", "sendgrid", "exacttarget", "marketo", "hubspot",
    "campaign monitor", "xyzmailer", "wiredmessenger",
)

#: Bytes of raw messages that a Python worker holds as Python objects at a time.
SLICE_BYTES = 4 << 20

_ENCODED = re.compile(r"=\?([^?]*)\?([BbQq])\?([^?]*)\?=")
_LATIN = {"iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252", "us-ascii"}
_DECODED = ("subject", "from", "to", "cc")


def decode_bytes(data: bytes, charset: str | None) -> str:
    """Latin-1 for its aliases, else UTF-8 with replacement characters."""
    if (charset or "").strip().lower() in _LATIN - {"us-ascii"}:
        return data.decode("latin-1")
    return data.decode("utf-8", "replace")


def decode_base64(text: str | bytes) -> bytes:
    """Characters outside the alphabet are skipped; an incomplete group of four at the end is dropped."""
    raw = text.encode("ascii", "ignore") if isinstance(text, str) else text
    raw = re.sub(rb"[^A-Za-z0-9+/=]", b"", raw)
    try:
        return base64.b64decode(raw[: len(raw) // 4 * 4])
    except binascii.Error:
        return b""


def decode_words(value: str) -> str:
    """RFC 2047 words decoded; white space between neighbours stays; a word that can't be decoded stays as it is."""

    def word(m: re.Match) -> str:
        charset, kind, data = m.groups()
        if kind in "Bb":
            return decode_bytes(decode_base64(data), charset)
        raw = re.sub(rb"=([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), data.replace("_", " ").encode("utf-8", "replace"))
        return decode_bytes(raw, charset)

    return _ENCODED.sub(word, value).strip()


def split_message(raw: bytes) -> tuple[bytes, bytes]:
    """Header block and body: apart at the first empty CRLF line, or else at the first empty LF line."""
    for gap in (b"\r\n\r\n", b"\n\n"):
        at = raw.find(gap)
        if at >= 0:
            return raw[:at], raw[at + len(gap) :]
    return raw, b""


def header_map(block: bytes | str, envelope: bool = True) -> dict[str, str]:
    """Lower-cased names to unfolded values, the last of equal names; a line without a colon is passed over."""
    text = block.decode("utf-8", "replace") if isinstance(block, bytes) else block
    rows = text.replace("\r\n", "\n").split("\n")
    if envelope and rows and rows[0].startswith("From "):
        rows = rows[1:]
    out: dict[str, str] = {}
    name = None
    for row in rows:
        if not row.strip() if not envelope else row == "":
            break
        if row[0] in " \t":
            if name is not None:
                out[name] += " " + row.strip()
        elif ":" in row:
            key, _, value = row.partition(":")
            name = key.strip().lower()
            out[name] = value.strip()
    return out


def normal_date(value: str | None) -> str | None:
    """RFC 2822 or ISO dates as ISO with the offset; anything else as it is."""
    if not value:
        return None
    text = decode_words(value)
    try:
        return parsedate_to_datetime(text).isoformat()
    except (ValueError, TypeError, IndexError):
        pass
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).isoformat()
    except ValueError:
        return text


def parsed_headers(raw: bytes) -> dict[str, str]:
    found = header_map(split_message(raw)[0])
    for key in _DECODED:
        if key in found:
            found[key] = decode_words(found[key])
    if found.get("date"):
        found["date"] = normal_date(found["date"])
    return found


def slices(batches: Iterator[pa.Array], max_bytes: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The batches' values in slices of at most max_bytes (one longer message is taken alone), however many rows a batch has."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch).to_pylist()):
            if i > start and held + (n or 0) > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        yield batch.slice(start)


def _headers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for raw in slices(batches):
        yield pa.array([None if r is None else list(parsed_headers(r).items()) for r in raw.to_pylist()], pa.map_(pa.string(), pa.string()))


def headers_of(raw: Column | str) -> Column:
    """Header names to values of raw messages, RFC 2047 and dates already decoded."""
    return F.arrow_udf(_headers, "map<string,string>")(raw)


def header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def message_id(value: Column) -> Column:
    """Without one leading and one trailing angle bracket; text with only a leading one stays whole; empty is null."""
    bare = F.trim(value)
    both = F.regexp_replace(bare, "^<?(.*)>$", "$1")
    return F.nullif(F.when(bare.endswith(">"), both).otherwise(bare), F.lit(""))


def address(value: Column) -> Column:
    """struct<name, email> of `Name <mail>` or a bare address; null without an @."""
    text = F.trim(value)
    named = text.rlike(r"^[^<]*<[^>]*>")
    name = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, "^([^<]*)<", 1)), '^"+|"+$', ""))
    mail = F.lower(F.trim(F.regexp_extract(text, "<([^>]*)>", 1)))
    both = F.struct(F.nullif(name, F.lit("")).alias("name"), mail.alias("email"))
    bare = F.struct(F.lit(None).cast("string").alias("name"), F.lower(text).alias("email"))
    return F.when(named & (mail != ""), both).when(~named & text.contains("@"), bare)


def address_list(value: Column) -> Column:
    """Addresses of a comma list; parts without one are dropped."""
    return F.filter(F.transform(F.split(value, ","), address), lambda a: a.isNotNull())


def reference_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(value), r"\s+"), message_id), lambda r: r.isNotNull())


def comma_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def list_id(value: Column) -> Column:
    inside = F.regexp_extract(value, "<([^>]*)>", 1)
    return F.nullif(F.when(inside != "", F.trim(inside)).otherwise(F.trim(value)), F.lit(""))


def spam_reason(headers: Column) -> Column:
    """The first rule that a header map meets: labels, senders, mailers, then bulk precedence without a list."""

    def low(name: str) -> Column:
        return F.lower(F.coalesce(header(headers, name), F.lit("")))

    labels = low("x-gmail-labels")
    rules = [(labels.contains(mark), f"label:{name}") for mark, name in (("\\spam", "spam"), ("\\trash", "trash"), ("category_promotions", "promotions"))]
    rules += [(low("from").contains(s), f"sender:{s}") for s in SPAM_SENDERS]
    rules += [(low("x-mailer").contains(m), f"mailer:{m}") for m in BULK_MAILERS]
    rules.append((low("precedence").contains("bulk") & header(headers, "list-id").isNull(), "precedence:bulk"))
    first, *rest = rules
    return reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rest, F.when(first[0], F.lit(first[1])))
