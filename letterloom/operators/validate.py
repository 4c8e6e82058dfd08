"""Validation of mail records of unknown shape, over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "struct<code:string,field:string,message:string,value:string>"


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, ... or null for a missing or null value."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull() | F.is_variant_null(v), None).otherwise(F.regexp_extract(s, "^[A-Z]+", 0))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _filled(v: Column) -> Column:
    return F.coalesce((kind_of(v) == "STRING") & (F.trim(_text(v)) != ""), F.lit(False))


def _issue(code: str, field: Column | str, message: str, value: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"), (F.lit(field) if isinstance(field, str) else field).alias("field"), F.lit(message).alias("message"),
        (F.lit(None).cast("string") if value is None else value.cast("string")).alias("value"),
    ).cast(ISSUE)


def _when(test: Column, issue: Column) -> Column:
    none = F.array().cast(f"array<{ISSUE}>")
    return F.when(F.coalesce(test, F.lit(False)), F.array(issue)).otherwise(none)


def _each(list_: Column, bad, issue) -> Column:
    """Issues of the items of an array VARIANT (none for anything else)."""
    items = F.when(kind_of(list_) == "ARRAY", F.try_variant_get(list_, "$", "array<variant>"))
    numbered = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda e: bad(e["x"])), lambda e: issue(e["x"], e["i"]))


def _has_address(v: Column) -> Column:
    given = F.when(kind_of(v) == "OBJECT", F.trim(F.coalesce(_text(_at(v, "$.email")), F.lit(""))) != "")
    return F.coalesce(given, (kind_of(v) == "STRING") & _text(v).rlike(r"\S"), F.lit(False))


def _is_date(v: Column) -> Column:
    t = _text(v)
    iso = F.regexp_replace(t, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz").isNotNull() & t.rlike(r"^\d{4}-\d{2}-\d{2}")
    rfc = t.rlike(r"(?i)^\s*([a-z]{3},\s*)?\d{1,2}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{2,4}\s+\d{1,2}:\d{2}(:\d{2})?(\s.*)?$")
    return F.coalesce((kind_of(v) == "STRING") & (iso | rfc), F.lit(False))


def issues(record: Column) -> Column:
    """array<struct<code, field, message, value>> of a VARIANT record, in the order of the record's parts."""
    headers = F.when(kind_of(_at(record, "$.headers")) == "OBJECT", _at(record, "$.headers"))
    content, tags, files = _at(record, "$.content"), _at(record, "$.tags"), _at(record, "$.attachments")

    def h(name: str) -> Column:
        return _at(headers, f"$.{name}")

    def name(field: str, i: Column, tail: str = "") -> Column:
        return F.concat(F.lit(f"{field}["), i.cast("string"), F.lit(f"]{tail}"))

    def variant_size(v: Column) -> Column:
        return F.coalesce(F.when(kind_of(v) == "ARRAY", F.size(F.try_variant_get(v, "$", "array<variant>"))), F.lit(0))

    has_files = variant_size(files) > 0
    refs = h("references")
    out = [
        _when(F.coalesce(kind_of(_at(record, "$.headers")) != "OBJECT", F.lit(True)), _issue("headers.type", "headers", "headers must be an object", kind_of(_at(record, "$.headers")))),
        _when(F.coalesce(kind_of(content) != "ARRAY", F.lit(True)), _issue("content.type", "content", "content must be a list", kind_of(content))),
        _when(kind_of(tags) != "ARRAY", _issue("tags.type", "tags", "tags must be a list of strings", kind_of(tags))),
        _each(tags, lambda x: ~_filled(x), lambda x, i: _issue("tags.value", name("tags", i), "a tag must be a non-empty string", F.to_json(x))),
        _when(kind_of(h("from")).isNotNull() & ~_has_address(h("from")), _issue("headers.from.email", "headers.from", "the sender must have an address", F.to_json(h("from")))),
    ]
    for field in ("to", "cc", "bcc"):
        out.append(_when(kind_of(h(field)) != "ARRAY", _issue(f"headers.{field}.type", f"headers.{field}", f"{field} must be a list", kind_of(h(field)))))
        out.append(_each(h(field), lambda x: ~_has_address(x), lambda x, i, field=field: _issue(f"headers.{field}.email", name(f"headers.{field}", i), "an entry must have an address", F.to_json(x))))
    out += [
        _when(kind_of(h("date")).isNotNull() & ~_is_date(h("date")), _issue("headers.date", "headers.date", "the date must be ISO 8601 or RFC 2822", _text(h("date")))),
        _each(refs, lambda x: ~_filled(x), lambda x, i: _issue("headers.references.value", name("headers.references", i), "a reference must be a non-empty string", F.to_json(x))),
        _when((kind_of(refs) == "STRING") & ~_filled(refs), _issue("headers.references.value", "headers.references", "references must be non-empty", _text(refs))),
        _when(~kind_of(refs).isin("ARRAY", "STRING"), _issue("headers.references.type", "headers.references", "references must be a list or a string", kind_of(refs))),
        _when(kind_of(files) != "ARRAY", _issue("attachments.type", "attachments", "attachments must be a list", kind_of(files))),
        _each(files, lambda x: F.coalesce(kind_of(x) != "OBJECT", F.lit(True)), lambda x, i: _issue("attachments.value", name("attachments", i), "an attachment must be an object", F.to_json(x))),
        _each(files, lambda x: F.coalesce((kind_of(x) == "OBJECT") & ~kind_of(_at(x, "$.size")).isin("BIGINT", "BOOLEAN"), F.lit(False)), lambda x, i: _issue("attachments.size", name("attachments", i, ".size"), "a size must be an integer", F.to_json(_at(x, "$.size")))),
    ]
    # Text blocks count up to the first good one: each bad one met before is an issue.
    blocks = F.coalesce(F.when(kind_of(content) == "ARRAY", F.try_variant_get(content, "$", "array<variant>")), F.array().cast("array<variant>"))
    marked = F.transform(blocks, lambda b, i: F.struct(i.alias("i"), b.alias("b"), F.coalesce(_text(_at(b, "$.type")) == "text", F.lit(False)).alias("text"), _filled(_at(b, "$.body")).alias("good")))
    texts = F.filter(marked, lambda m: m["text"])
    first_good = F.array_min(F.transform(F.filter(texts, lambda m: m["good"]), lambda m: m["i"]))
    early = F.filter(texts, lambda m: ~m["good"] & (first_good.isNull() | (m["i"] < first_good)))
    out += [
        F.transform(early, lambda m: _issue("content.body", name("content", m["i"], ".body"), "a text block must have a body", F.to_json(_at(m["b"], "$.body")))),
        _when((F.size(blocks) > 0) & first_good.isNull() & ~has_files, _issue("content.text", "content", "content must have a text block")),
        _when((F.size(blocks) == 0) & ~has_files, _issue("content.empty", "content", "content must have a text block")),
    ]
    whole = _when(F.lit(True), _issue("record.type", "record", "a record must be an object", kind_of(record)))
    return F.when(F.coalesce(kind_of(record) == "OBJECT", F.lit(False)), F.concat(*out)).otherwise(whole)


def validated(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with record (VARIANT, null where no JSON) and issues."""
    return lines.withColumn("record", F.try_parse_json(line)).withColumn("issues", F.when(F.col("record").isNotNull(), issues(F.col("record"))))


def summary(checked: DataFrame) -> DataFrame:
    """total, valid and errors in one row."""
    good = F.col("record").isNotNull() & (F.size("issues") == 0)
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("valid"), F.count_if(~good).alias("errors"))


def checked_summary(lines: DataFrame, strict: bool = False, max_errors: int | None = None) -> dict:
    """total, valid and errors; raises where strict allows no error, or where more than max_errors are found."""
    found = summary(validated(lines)).first().asDict()
    most = 0 if strict else max_errors
    if most is not None and found["errors"] > most:
        raise ValueError(f"{found['errors']} of {found['total']} records are invalid")
    return found
