"""Predicates over mail rows. User values are always literals, never parts of a SQL text."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_KEYS = ("from", "to", "from_domain", "year", "month", "start_date", "end_date", "has_attachment", "labels")


def as_text(value) -> str | None:
    return (str(value).strip() or None) if value is not None else None


def as_int(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def as_bool(value) -> bool | None:
    if isinstance(value, bool):
        return value
    return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(str(value).strip().lower())


def as_date(value) -> datetime | None:
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    try:
        return datetime.fromisoformat(str(value).replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        return None


def _sender(value: str) -> Column:
    if "@" in value:
        return F.col("from_address") == value
    if "." in value and " " not in value:
        return F.col("from_address").contains("@" + value)
    return F.col("from_name").contains(value) | F.col("from_address").contains(value)


def _recipient(value: str) -> Column:
    domain = "@" not in value and "." in value and " " not in value
    return F.col("to_addresses_str").contains("@" + value if domain else value)


def where(filters: Mapping) -> Column | None:
    """All conditions of a plan's filters; None without any. Values that can't be read as their kind set no condition."""
    tests: list[Column] = []
    if v := as_text(filters.get("from")):
        tests.append(_sender(v))
    if v := as_text(filters.get("to")):
        tests.append(_recipient(v))
    if v := as_text(filters.get("from_domain")):
        tests.append(F.col("from_address").contains("@" + v))
    for key in ("year", "month"):
        if v := as_int(filters.get(key)):
            tests.append(F.col(key) == v)
    if (v := as_bool(filters.get("has_attachment"))) is not None:
        tests.append(F.col("has_attachment") == v)
    if v := as_date(filters.get("start_date")):
        tests.append(F.col("date") >= F.lit(v).cast("timestamp_ntz"))
    if v := as_date(filters.get("end_date")):
        tests.append(F.col("date") <= F.lit(v).cast("timestamp_ntz"))
    labels = filters.get("labels") or []
    for label in [labels] if isinstance(labels, str) else labels:
        if v := as_text(label):
            tests.append(F.col("labels_str").contains(v))
    return reduce(lambda a, b: a & b, tests) if tests else None


def filtered(mails: DataFrame, test: Column | None) -> DataFrame:
    return mails if test is None else mails.where(test)


def by_id(mails: DataFrame, email_id: str) -> DataFrame:
    return mails.where(F.col("email_id") == email_id).limit(1)


def exists(mails: DataFrame, email_id: str) -> bool:
    return not by_id(mails.select("email_id"), email_id).isEmpty()


def by_sender(mails: DataFrame, sender: str, limit: int = 100) -> DataFrame:
    return mails.where(F.col("from_address") == sender).orderBy("date", "email_id").limit(limit)


def by_date_range(mails: DataFrame, start: datetime, end: datetime, limit: int = 1000) -> DataFrame:
    """Both ends included."""
    return mails.where(F.col("date").between(start, end)).orderBy("date", "email_id").limit(limit)
