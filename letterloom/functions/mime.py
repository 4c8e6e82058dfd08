"""Bodies and attachments of raw messages: an Arrow function that is local to the row."""

from __future__ import annotations

import quopri
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions.headers import decode_base64, decode_words, header_map, slices, split_message

# Part types that are binary, and the name of a nameless attachment.
BINARY_TYPES = ("image/", "audio/", "video/", "application/")
UNNAMED = "unnamed"

BODY = "plain string, html string, attachments array<struct<filename:string,content_type:string,size:bigint>>"
_FILE = pa.struct([("filename", pa.string()), ("content_type", pa.string()), ("size", pa.int64())])
_BODY = pa.struct([("plain", pa.string()), ("html", pa.string()), ("attachments", pa.list_(_FILE))])


def param(value: str, name: str) -> str | None:
    m = re.search(rf'(?i)(?:^|;)\s*{name}\*?\s*=\s*("[^"]*"|[^;]*)', value)
    return m[1].strip().strip('"').strip() or None if m else None


def decoded(data: bytes, encoding: str) -> bytes:
    how = encoding.strip().lower()
    if how == "base64":
        return decode_base64(data) or data
    return quopri.decodestring(data) if how == "quoted-printable" else data


def parts_of(body: bytes, boundary: str) -> list[bytes]:
    out, held = [], None
    mark = b"--" + boundary.encode()
    for line in body.splitlines(keepends=True):
        bare = line.rstrip()
        if bare == mark or bare == mark + b"--":
            if held is not None:
                out.append(b"".join(held))
            if bare != mark:
                return out
            held = []
        elif held is not None:
            held.append(line)
    return [*out, b"".join(held)] if held else out


def extract(headers: dict[str, str], body: bytes) -> tuple[list[str], list[str], list[dict]]:
    """Plain parts, HTML parts and attachments; a nested multipart is entered."""
    kind = headers.get("content-type", "")
    low = kind.lower()
    if low.lstrip().startswith("multipart/") and (boundary := param(kind, "boundary")):
        plain, html, files = [], [], []
        for part in parts_of(body, boundary):
            block, inner = split_message(part if part[:1] not in (b"\n", b"\r") else b"\n" + part)
            p, h, f = extract(header_map(block, envelope=False), inner)
            plain += p
            html += h
            files += f
        return plain, html, files
    disposition = headers.get("content-disposition", "")
    attached = "attachment" in disposition.lower()
    name = param(disposition, "filename") or param(kind, "name")
    mime = low.split(";")[0].strip()
    data = decoded(body, headers.get("content-transfer-encoding", ""))
    if (attached or mime.startswith(BINARY_TYPES)) and (attached or name):
        return [], [], [{"filename": decode_words(name) if name else UNNAMED, "content_type": mime or "application/octet-stream", "size": len(data.rstrip(b"\r\n") if not attached else data)}]
    text = data.decode("utf-8", "replace")
    if mime == "text/html":
        return [], [text], []
    return ([text] if mime in ("", "text/plain") else []), [], []


def _bodies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for raw in slices(batches):
        rows = []
        for r in raw.to_pylist():
            block, body = split_message(r or b"")
            plain, html, files = extract(header_map(block), body)
            text = "\n\n".join(p.strip() for p in plain if p.strip())
            rows.append({"plain": text or None, "html": None if text else "\n\n".join(html) or None, "attachments": files})
        yield pa.array(rows, _BODY)


def body_of(raw: Column | str) -> Column:
    """struct<plain, html, attachments> of raw messages; html only where no plain part is."""
    return F.arrow_udf(_bodies, BODY)(raw)
