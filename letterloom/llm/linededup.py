"""Line dedup by winnowing over line hashes.

A text's lines (physical lines, cut further after sentence ends) are hashed in normal form. A gram is the shortest
run of lines from a line on with GRAM_WORDS words, a window the shortest with RUN_WORDS. Each window selects its
smallest gram hash, so two equal runs of RUN_WORDS words or more are sure to share a selected fingerprint. The
fingerprints that occur twice or more are joined to their positions; around these, and only there, matches extend
forwards and backwards: all runs of RUN_WORDS words that hold a joined position, from each line on and up to each line,
whose union is as far as a repeat goes. The first occurrence of a run, by document id and place, stays;
the lines of later ones are deleted. Counts and first places are combined before each shuffle, and no group of
occurrences is ever gathered or paired off: equal runs meet by two 64-bit hashes of all their lines, not pair by pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import build, column, ddl_of, drop, sliced, table, unused, written

GRAM_WORDS = 20
RUN_WORDS = 40
#: Lines that a worker extends at a time.
SLICE_LINES = 100_000

_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)


def pieces_of(text: str) -> list[str]:
    """The text cut after every line break and after a sentence end with its space; joined again they are the text."""
    mark = next((c for c in map(chr, range(0xD800)) if c not in text), None)  # a character that the text has not
    if mark is None:
        return re.split("(?<=\n)|(?<=[.!?] )", text)
    for end in ("\n", ". ", "! ", "? "):
        text = text.replace(end, end + mark)
    return text.split(mark)


def lines_of(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Of each line with a word: its piece, the hash of its lower-cased words, and how many they are."""
    at, hashes, words = [], [], []
    digest = xxhash.xxh64_intdigest
    for i, piece in enumerate(pieces_of(text.lower()) if text else ()):
        held = piece.split()
        if held:
            at.append(i)
            hashes.append(digest(" ".join(held)))
            words.append(len(held))
    return at, hashes, words


class Runs:
    """Runs of lines of documents laid end to end: where they end for a number of words, and their hashes."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, sizes: np.ndarray):
        self.n = n = len(hashes)
        self.cum = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
        stops = np.cumsum(sizes)
        self.stop = np.repeat(stops, sizes)  # of each line the end, and the start, of its document
        self.begin = np.repeat(stops - sizes, sizes)
        self.sums, self.unit = [], []
        for base, inverse in zip(_BASES, _INVERSE):
            powers, back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
            np.multiply.accumulate(np.full(n, base), out=powers[1:])
            np.multiply.accumulate(np.full(n, inverse), out=back[1:])
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)]))
            self.unit.append(back)

    def forward(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """For each line the last line of the shortest run from it with so many words, and whether its document has it."""
        last = np.searchsorted(self.cum, self.cum[:-1] + words) - 1
        return last, last < self.stop

    def backward(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """For each line the first line of the shortest run that ends with it, and whether its document has it."""
        first = np.searchsorted(self.cum, self.cum[1:] - words, "right") - 1
        return first, first >= self.begin

    def hash(self, start: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
        h = (self.sums[which][last + 1] - self.sums[which][start]) * self.unit[which][start]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        return h


def _last_minimum(values: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each range of values the place of its smallest, the last of equal ones: two overlapping powers of two."""
    best = np.arange(len(values))
    levels, width = [best], 1
    longest = int((last - start).max()) + 1
    while 2 * width <= longest:
        a, b = levels[-1][:-width], levels[-1][width:]
        levels.append(np.where(values[b] <= values[a], b, a))
        width *= 2
    level = np.frexp((last - start + 1).astype(np.float64))[1] - 1
    out = np.empty(len(start), np.int64)
    for k, table_ in enumerate(levels):
        at = np.nonzero(level == k)[0]
        a, b = table_[start[at]], table_[last[at] - (1 << k) + 1]
        out[at] = np.where(values[b] <= values[a], b, a)
    return out


def winnow(hashes: np.ndarray, words: np.ndarray, sizes: np.ndarray, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the selected grams of documents laid end to end."""
    runs = Runs(hashes, words, sizes)
    ends, whole = runs.forward(run_words)
    start = np.nonzero(whole)[0]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, held = runs.forward(gram_words)
    values = np.full(runs.n, np.iinfo(np.uint64).max, np.uint64)
    own = np.nonzero(held)[0]
    values[own] = runs.hash(own, grams[own])
    inside = np.searchsorted(grams, ends[start], "right") - 1  # grams from a window's start to here end within it
    at = np.unique(_last_minimum(values, start, inside))
    return at, values[at]


def extended(hashes: np.ndarray, words: np.ndarray, sizes: np.ndarray, shared: np.ndarray, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, last, hash, second hash) of the runs of run_words words, grown forwards and backwards, that hold a shared
    gram. shared: its positions, ascending."""
    runs = Runs(hashes, words, sizes)
    ends, whole = runs.forward(run_words)
    starts, ended = runs.backward(run_words)
    a, b = np.nonzero(whole)[0], np.nonzero(ended)[0]
    code = np.unique(np.concatenate([a * runs.n + ends[a], starts[b] * runs.n + b]))
    start, last = code // max(runs.n, 1), code % max(runs.n, 1)
    grams = runs.forward(gram_words)[0][shared]
    first = np.searchsorted(shared, start)  # the shared gram that starts first in the run also ends first
    ok = first < len(shared)
    ok[ok] &= grams[first[ok]] <= last[ok]
    start, last = start[ok], last[ok]
    return start, last, runs.hash(start, last), runs.hash(start, last, 1)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _by_lines(batch: pa.RecordBatch, column_name: str = "hashes", most: int = SLICE_LINES) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many lines (or a single row): long documents may stand together."""
    ends = np.cumsum(pa.compute.list_value_length(column(batch, column_name)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _hashed(docs: DataFrame, id_col: str, text_col: str, gram_words: int, run_words: int) -> DataFrame:
    """doc_id, _key, and the hashes and words of the lines, and the places and hashes of the fingerprints."""
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("hashes", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("fp_at", pa.list_(pa.int32())), ("fp", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held = [lines_of(t)[1:] for t in column(batch, "text").to_pylist()]
            sizes = np.array([len(h) for h, _ in held], np.int64)
            hashes = np.array([x for h, _ in held for x in h], np.uint64)
            words = np.array([x for _, w in held for x in w], np.int64)
            at, fp = winnow(hashes, words, sizes, gram_words, run_words)
            stops = np.cumsum(sizes)
            doc = np.searchsorted(stops, at, "right")
            each = np.bincount(doc, minlength=len(sizes))
            own = at - (stops - sizes)[doc]
            yield build(schema, [column(batch, "doc_id"), column(batch, "_key"), _lists(hashes.view(np.int64), sizes, pa.int64()), _lists(words.astype(np.int32), sizes, pa.int32()), _lists(own.astype(np.int32), each, pa.int32()), _lists(fp.view(np.int64), each, pa.int64())])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("_key"))
    return read.mapInArrow(run, "doc_id long, _key long, hashes array<long>, words array<int>, fp_at array<int>, fp array<long>")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(_id, _key, _spans): of each document with a later repeated run, the (first, last) lines of such runs."""
    rows, rows_path = written(_hashed(docs, id_col, text_col, gram_words, run_words).withColumn("_row", F.monotonically_increasing_id()))
    prints = rows.select("_row", F.explode(F.arrays_zip("fp_at", "fp")).alias("p")).select("_row", "p.fp_at", "p.fp")
    # Written, as the heads are below, so that both sides of the join are plain exchanges and a fingerprint in very many
    # places can be split.
    shared, shared_path = written(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"))
    places = prints.join(shared, "fp").groupBy("_row").agg(F.sort_array(F.collect_list("fp_at")).alias("shared"))
    schema = pa.schema([("w_a", pa.int64()), ("w_b", pa.int64()), ("doc_id", pa.int64()), ("_key", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_lines(whole):
                sizes = pa.compute.list_value_length(column(batch, "hashes")).to_numpy(zero_copy_only=False).astype(np.int64)
                base = np.cumsum(sizes) - sizes
                marks = pa.compute.list_value_length(column(batch, "shared")).to_numpy(zero_copy_only=False).astype(np.int64)
                shared_at = _flat(column(batch, "shared")).astype(np.int64) + np.repeat(base, marks)
                start, last, a, b = extended(_flat(column(batch, "hashes")).view(np.uint64), _flat(column(batch, "words")).astype(np.int64), sizes, shared_at, gram_words, run_words)
                doc = np.searchsorted(base + sizes, start, "right")
                take = pa.array(doc)
                yield build(schema, [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), column(batch, "doc_id").take(take), column(batch, "_key").take(take), pa.array((start - base[doc]).astype(np.int32)), pa.array((last - base[doc]).astype(np.int32))])

    candidates = rows.select("_row", "doc_id", "_key", "hashes", "words").join(places, "_row").drop("_row")
    grown, grown_path = written(candidates.mapInArrow(grow, "w_a long, w_b long, doc_id long, _key long, first int, last int"))
    drop(docs.sparkSession, rows_path, shared_path)  # what follows needs the grown runs alone
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key", "first")
    heads, _ = written(grown.groupBy("w_a", "w_b").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"))
    later = grown.join(heads, ["w_a", "w_b"]).where(place > F.col("head"))
    return later.groupBy(F.col("doc_id").alias("_id"), "_key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("_spans"))


def delete_lines(text: str, spans: list[dict]) -> tuple[str, int, int, int]:
    """The text without the lines in spans; how many lines and words went, and how many words are left."""
    pieces = pieces_of(text)
    at, _, words = lines_of(text)
    gone = np.zeros(len(at) + 1, np.int64)
    for s in spans:
        gone[s["first"]] += 1
        gone[s["last"] + 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    keep = np.ones(len(pieces), bool)
    for i in np.nonzero(gone)[0]:
        end = at[i + 1] if i + 1 < len(at) and gone[i + 1] else at[i] + 1
        keep[at[i] : end] = False
    out = "".join(p for p, k in zip(pieces, keep.tolist()) if k)
    words = np.array(words)
    return out.rstrip("\n ") if gone[-1] else out, int(gone.sum()), int(words[gone].sum()), int(words[~gone].sum())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, added: Sequence[str] = ("_deleted_lines", "_deleted_words", "_emptied")) -> DataFrame:
    """docs with its text column rewritten, and _deleted_lines, _deleted_words and _emptied (no word is left) added.

    Later means a larger id (a null id last), then a larger hash of the text, then a later place in the text. Rows
    equal in id and text are one document: a run isn't deleted for standing in the other row. Null texts stay null;
    texts below run_words words and texts without a repeat stay as they are, to the byte; an empty table gives none.
    Columns of docs that have the added ones' names give way to them; others stay, whatever their names.
    """
    columns = [c for c in docs.columns if c.lower() not in {n.lower() for n in added}]
    key, here, ident, own, spans_ = unused([*columns, *added], "key", "key_here", "id", "own_id", "spans")
    found = repeats(docs, id_col, text_col, gram_words, run_words).select(F.col("_id").alias(ident), F.col("_key").alias(key), F.col("_spans").alias(spans_))
    keyed = docs.select(*columns, F.xxhash64(id_col, text_col).alias(here), F.col(id_col).cast("long").alias(own))
    keyed = keyed.join(found, (F.col(here) == F.col(key)) & F.col(own).eqNullSafe(F.col(ident)), "left")
    names = [*columns, *added]

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            spans, texts = column(batch, spans_), column(batch, text_col)
            hit = np.nonzero(spans.is_valid().to_numpy(zero_copy_only=False))[0]
            counts = np.zeros((3, batch.num_rows), np.int64)
            if len(hit):
                rewritten = texts.to_pylist()
                for i, s in zip(hit.tolist(), spans.take(pa.array(hit)).to_pylist()):
                    rewritten[i], *counts[:, i] = delete_lines(rewritten[i], s)
                texts = pa.array(rewritten, pa.string())
            emptied = (counts[0] > 0) & (counts[2] == 0)
            out = [texts if n == text_col else column(batch, n) for n in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(counts[0]), pa.array(counts[1]), pa.array(emptied)], names=names)

    ddl = f"{ddl_of(docs, columns)}, `{added[0]}` long, `{added[1]}` long, `{added[2]}` boolean"
    return keyed.select(*columns, spans_).mapInArrow(apply, ddl)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_deleted_lines").alias("n_deleted_lines"), F.col("_deleted_words").alias("n_deleted_words"), "text")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, text FROM documents),
pc AS (
  SELECT doc_id, k, p[k] AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM (
    SELECT doc_id, string_split(replace(replace(replace(replace(text, chr(10), chr(10) || chr(1)), '. ', '. ' || chr(1)), '! ', '! ' || chr(1)), '? ', '? ' || chr(1)), chr(1)) AS p FROM d))
), wd AS (
  SELECT doc_id, k, regexp_extract_all(lower(piece), '[^\s\x0B\x1C-\x1F\x{85}\x{a0}]+') AS w FROM pc
), ln AS (
  SELECT doc_id, k, array_to_string(w, ' ') AS norm, len(w) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i,
         sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k) AS cum FROM wd WHERE len(w) > 0
), runs AS (
  SELECT a.doc_id, a.i AS s, b.i AS e FROM (SELECT *, cum - n + 40 AS goal FROM ln) a ASOF JOIN ln b ON a.doc_id = b.doc_id AND a.goal <= b.cum
  UNION
  SELECT a.doc_id, b.i, a.i FROM (SELECT *, cum - 40 AS goal FROM ln) a ASOF JOIN (SELECT *, cum - n AS pre FROM ln) b ON a.doc_id = b.doc_id AND a.goal >= b.pre
), body AS (SELECT doc_id, list(norm ORDER BY i) AS norms FROM ln GROUP BY doc_id),
held AS (SELECT doc_id, s, e, md5(array_to_string(norms[s : e], chr(10))) AS content FROM runs JOIN body USING (doc_id)),
later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS r FROM held) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM later),
span AS (
  SELECT doc_id, a.k AS first, CASE WHEN c.i IS NULL THEN a.k ELSE b.k - 1 END AS last, a.n, b.k IS NULL AS at_end
  FROM ln a JOIN gone g USING (doc_id, i) LEFT JOIN ln b ON b.doc_id = a.doc_id AND b.i = a.i + 1 LEFT JOIN gone c ON c.doc_id = a.doc_id AND c.i = a.i + 1
), cut AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS k FROM span),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY k) AS t FROM pc ANTI JOIN cut USING (doc_id, k) GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS l, sum(n) AS n, bool_or(at_end) AS at_end FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(l, 0)::BIGINT AS n_deleted_lines, coalesce(n, 0)::BIGINT AS n_deleted_words,
       CASE WHEN l IS NULL THEN text WHEN at_end THEN rtrim(coalesce(t, ''), chr(10) || ' ') ELSE coalesce(t, '') END AS text
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
