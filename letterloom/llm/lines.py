"""Quality rules by cross-document line frequency.

One Arrow pass over the text gives each document's base counts and its normalised line hashes with their words.
The hashes go to the corpus count: documents per host and line (a document names a line once, however often it has it),
with partial sums before the shuffle, so a line that a third of all rows carry is combined early. Lines of more documents
than the limit are taken out, and a document with too little left is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import build, column, sliced, table, written

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A line that more documents of one host carry is boilerplate.
MAX_DOCUMENTS = 20
#: A document must keep at least so many percent of its words when boilerplate lines are gone.
MIN_LEFT_PERCENT = 50

SYMBOLS = b"#*$%&|<>"
#: What bytes.split() splits at.
_SPACE = b" \t\n\v\f\r"


def repeated_words(words: Sequence) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n:
        return 0
    base = len(number)
    pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * base + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : k + n - 2] |= again
    return int(hit.sum())


def normal_line(line: str) -> str:
    """Lower-cased, white space runs single, digits as 0: what makes two lines the same boilerplate."""
    return re.sub("[0-9]+", "0", " ".join(line.lower().split()))


def measure(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, distinct line hashes, words under each."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    seen: set[str] = set()
    repeats = 0
    of_line: dict[int, int] = {}
    for line, as_bytes in zip(text.split("\n"), raw.split(b"\n")):
        n = len(as_bytes.split())
        if not n:
            continue
        if line in seen:
            repeats += 1
        seen.add(line)
        key = xxhash.xxh64_intdigest(normal_line(line).encode("utf-8", "replace")) - (1 << 63)
        of_line[key] = of_line.get(key, 0) + n
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, repeats, repeated_words(words), list(of_line), list(of_line.values())


_MEASURED = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: base counts, and the distinct normalised lines with their words."""
    pair = pa.struct([("line", pa.int64()), ("words", pa.int32())])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((n, pa.int64()) for n in names), ("lines", pa.list_(pair))])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [measure(t or "") for t in column(batch, "text").to_pylist()]
            offsets = np.cumsum([0, *(len(r[5]) for r in rows)])
            inner = pa.StructArray.from_arrays([pa.array([x for r in rows for x in r[5]], pa.int64()), pa.array([x for r in rows for x in r[6]], pa.int32())], fields=list(pair))
            lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)
            yield build(schema, [column(batch, "doc_id"), column(batch, "host"), *([r[k] for r in rows] for k in range(5)), lines])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    return read.mapInArrow(score, _MEASURED)


def frequent_lines(rows: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(host, line) of the lines that more than max_documents documents of the host carry."""
    each = rows.select("host", F.explode("lines.line").alias("line"))  # the lines of a row are distinct
    return each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > max_documents).select("host", "line")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, n_removed (words in boilerplate lines), kept.

    Null and empty texts have no words and so fail the base rules. A null host is a host of its own. Every row is a
    document: exact copies and repeated rows each count and each get their row; null ids keep their rows; an empty table
    gives none; other columns are ignored.
    """
    rows, _ = written(measured(docs, id_col, text_col, host_col).withColumn("_row", F.monotonically_increasing_id()))
    lines = rows.select("_row", "host", F.explode("lines").alias("l")).select("_row", "host", "l.line", "l.words")
    frequent, _ = written(frequent_lines(rows, max_documents))  # a plain side, so that the join on a very common line can be split
    gone = lines.join(frequent, ["host", "line"]).groupBy("_row").agg(F.sum("words").alias("n_removed"))
    out = rows.drop("lines", "host").join(gone, "_row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("n_removed")) >= min_left_percent * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & left).alias("kept"), "n_removed")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs
), wins AS (
  SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), lines AS (
  SELECT rid, host, t, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         regexp_replace(trim(regexp_replace(lower(l), '[\s\x0B]+', ' ', 'g')), '[0-9]+', '0', 'g') AS norm
  FROM (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT rid, sum(c - 1) AS n_dup_lines FROM (SELECT rid, l, count(*) AS c FROM lines GROUP BY rid, l) GROUP BY rid
), frequent AS (
  SELECT host, norm FROM lines GROUP BY host, norm HAVING count(DISTINCT rid) > 20
), gone AS (
  SELECT rid, sum(n) AS n_removed FROM lines JOIN frequent USING (host, norm) GROUP BY rid
), base AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed
  FROM words LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed) >= 50 * n_words AS kept, n_removed
FROM base
"""
