"""Overlapping chunks of a text, packed word by word."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS, OVERLAP_CHARS = 1200, 200


def chunk_text(text: str | None, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """A text of at most size characters is one chunk as it is. A longer one is packed from words, single spaces between;
    a word longer than size is a chunk of its own. The next chunk begins as many words back as have overlap characters."""
    text = text or ""
    if len(text) <= size:
        return [text] if text.strip() else []
    words = text.split()
    ends = [0]
    for w in words:
        ends.append(ends[-1] + len(w) + 1)  # ends[j] - ends[i] - 1: characters of words i to j joined
    out, start = [], 0
    while start < len(words):
        end = start + 1
        while end < len(words) and ends[end + 1] - ends[start] - 1 <= size:
            end += 1
        out.append(" ".join(words[start:end]))
        if end == len(words):
            break
        back = end
        while back > start and ends[end] - ends[back] < overlap:
            back -= 1
        start = back if back > start else end
    return out


def chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: chunk_text(t, size, overlap))

    return cut(text)


def exploded(rows: DataFrame, text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """rows with chunk_index (from 0) and chunk_text, one row for each chunk."""
    return rows.select("*", F.posexplode(chunks(text, size, overlap)).alias("chunk_index", "chunk_text"))
