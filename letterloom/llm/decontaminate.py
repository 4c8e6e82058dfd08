"""Benchmark decontamination by a prefix-filtered set join of word shingles.

A benchmark item gives windows of WINDOW_WORDS consecutive words (a shorter item is one window). A window is the
set of its SHINGLE_WORDS-word shingles at their places, and a document must contain all of it, so the necessary
prefix of the rarity-ordered set is one shingle: the one that is rarest over all documents. The join meets
document shingles with those prefix shingles only; a window that would begin before or end after its document is
dropped by length and position, and the rest are verified word by word over the whole window.

The window index goes to the executors in slices of at most SLICE_WINDOWS words, a proven bound: a long item is cut into
parts that overlap by a window less a word, which have all its windows. A larger benchmark takes more slices, each one pass
over the documents whose result is written before the next slice is laid out, and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import build, column, row_keys, sliced, table, unused, written

WINDOW_WORDS = 8
SHINGLE_WORDS = 3
MIN_ITEMS = 2
#: Words, and so windows at most, of one broadcast slice: below 64 MB.
SLICE_WINDOWS = 200_000
#: Candidate windows verified at a time.
BLOCK = 1 << 20

#: Word bytes lower-cased, any other byte to a space.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of ASCII letters, digits and all non-ASCII characters; none for null."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


class WindowIndex:
    """Windows of some benchmark items as arrays of word numbers (0: a word that no item has)."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        number = self.vocab.setdefault
        seen: dict[tuple[int, ...], set] = {}
        for item, words in items:
            ids = [number(w, len(self.vocab) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                seen.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.items = sorted({i for s in seen.values() for i in s}, key=str)
        place = {item: n for n, item in enumerate(self.items)}
        self.windows = list(seen)
        self.owners = [np.array(sorted(place[i] for i in s), np.int32) for s in seen.values()]
        self.shingle = shingle
        self.base = len(self.vocab) + 1
        assert self.base**shingle < 1 << 62, "shingles as numbers: a slice's words are bounded"
        self.codes = np.unique(np.array([c for w in self.windows for c, _ in self._shingles(w)], np.int64))
        self.prefix = np.zeros(0, np.int64)

    def _shingles(self, window: tuple[int, ...]) -> list[tuple[int, int]]:
        """(code, place) of a window's shingles; a shorter window is padded, and so has one of its own length."""
        k = min(self.shingle, len(window))
        return [(self._code(window[i : i + k]), i) for i in range(len(window) - k + 1)]

    def _code(self, ids: tuple[int, ...]) -> int:
        code = 0
        for i in ids:
            code = code * self.base + i
        return code

    def order(self, counts: dict[int, int]) -> None:
        """Chooses every window's prefix shingle, the rarest by counts, and lays out the join's build side."""
        chosen = [min(self._shingles(w), key=lambda c: (counts.get(c[0], 0), c[0], c[1])) for w in self.windows]
        codes = np.array([c for c, _ in chosen], np.int64)
        by = np.argsort(codes, kind="stable")
        self.prefix, first, n = np.unique(codes[by], return_index=True, return_counts=True)
        self.first, self.n, self.by = first, n, by
        self.place = np.array([p for _, p in chosen], np.int64)
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.words = np.zeros((len(self.windows), max(map(len, self.windows), default=1)), np.int64)
        for i, w in enumerate(self.windows):
            self.words[i, : len(w)] = w

    def numbers(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The documents' words as numbers, a 0 after each document, and where each document begins."""
        get = self.vocab.get
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.zeros(starts[-1] + self.words_width(), np.int64)
        for s, words in zip(starts.tolist(), docs):
            flat[s : s + len(words)] = [get(w, 0) for w in words]
        return flat, starts

    def words_width(self) -> int:
        return max(map(len, self.windows), default=1)

    def probes(self, flat: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index into table) of every document shingle that table has, for every shingle length in use."""
        at, found = [], []
        for k in sorted({min(self.shingle, len(w)) for w in self.windows}):
            run = len(flat) - k + 1
            here = flat[:run] > 0
            for j in range(1, k):
                here &= flat[j : j + run] > 0
            p = np.nonzero(here)[0]
            code = np.zeros(len(p), np.int64)
            for j in range(k):
                code = code * self.base + flat[p + j]
            i = np.minimum(np.searchsorted(table, code), len(table) - 1)
            hit = table[i] == code
            at.append(p[hit])
            found.append(i[hit])
        return np.concatenate(at), np.concatenate(found)

    def tally(self, docs: list[list[bytes]]) -> np.ndarray:
        _, found = self.probes(self.numbers(docs)[0], self.codes)
        return np.bincount(found, minlength=len(self.codes))

    def matches(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence of a window. The windows of each prefix that occurs are
        laid out block by block, so a shingle of very many windows in very many places takes no more memory."""
        flat, starts = self.numbers(docs)
        at, found = self.probes(flat, self.prefix)
        n = self.n[found]
        ends = np.cumsum(n)
        out = [(np.zeros(0, np.int64),) * 3]
        for lo in range(0, int(n.sum()), BLOCK):
            each = np.arange(lo, min(lo + BLOCK, int(ends[-1])))
            probe = np.searchsorted(ends, each, "right")
            window = self.by[self.first[found[probe]] + each - (ends - n)[probe]]
            begin = at[probe] - self.place[window]
            doc = np.searchsorted(starts, at[probe], "right") - 1
            fits = (begin >= starts[doc]) & (begin + self.size[window] < starts[doc + 1])  # length and positional bounds
            begin, window, doc = begin[fits], window[fits], doc[fits]
            ok = np.ones(len(begin), bool)
            for j in range(self.words.shape[1]):
                want = self.words[window, j]
                ok &= (want == 0) | (flat[begin + j] == want)
            out.append((doc[ok], begin[ok] - starts[doc[ok]], window[ok]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _slices(benchmark: DataFrame, id_col: str, text_col: str, window: int, shingle: int, slice_windows: int) -> Iterator[WindowIndex]:
    """Indexes over the items, in order of id, each of at most slice_windows words and one window less a word."""
    held, size, most = [], 0, max(slice_windows, window)
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    for row in rows.orderBy("i", "t").toLocalIterator():
        words, at = words_of(row["t"]), 0
        while at < len(words) and (at == 0 or len(words) - at >= window):
            if held and size + min(len(words) - at, window) > most:
                yield WindowIndex(held, window, shingle)
                held, size = [], 0
            part = words[at : at + max(most - size, window)]
            held.append((row["i"], part))
            size += len(part)
            at += max(len(part) - window + 1, 1)
    if held:
        yield WindowIndex(held, window, shingle)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """The union of [start, start + size) as disjoint spans in order."""
    out: list[list[int]] = []
    for s, n in sorted(zip(starts.tolist(), sizes.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(a, b) for a, b in out]


def _ordered(docs: DataFrame, index: WindowIndex) -> WindowIndex:
    """Orders the index by how often its shingles occur in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.codes), np.int64)
        for batch in sliced(batches):
            total += own.tally([words_of(t) for t in column(batch, "text").to_pylist()])
        some = np.nonzero(total)[0]
        yield build(pa.schema([("code", pa.int64()), ("n", pa.int64())]), [pa.array(own.codes[some]), pa.array(total[some])])

    counted = docs.select("text").mapInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    index.order({r["code"]: r["n"] for r in counted.toLocalIterator()})  # at most 8 rows for each window of the slice
    shared.unpersist()
    return index


_FOUND = "doc_id long, _key_a long, _key_b long, n_words long, items array<string>, spans array<struct<first:int,end:int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """One row per input row: doc_id, _key_a, _key_b, n_words, items (matching ids as sorted strings), spans (hit words).

    Null texts have no words and no hits. Benchmark rows with a null id or text, or without words, give no window;
    repeated items count once. Repeated documents each keep their row; an empty table on either side gives no hits.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col))
    struct = pa.struct([("first", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("_key_a", pa.int64()), ("_key_b", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(struct))])

    def found(index: WindowIndex | None) -> tuple[DataFrame, Broadcast]:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in sliced(batches):
                texts = [words_of(t) for t in column(batch, "text").to_pylist()]
                items: list[list[str]] = [[] for _ in texts]
                spans: list[list[dict]] = [[] for _ in texts]
                if own is not None:
                    doc, first, win = own.matches(texts)
                    by = np.argsort(doc, kind="stable")
                    doc, first, win = doc[by], first[by], win[by]
                    some, at = np.unique(doc, return_index=True)
                    for d, s, e in zip(some.tolist(), at.tolist(), [*at[1:].tolist(), len(doc)]):
                        items[d] = sorted({str(own.items[i]) for w in np.unique(win[s:e]) for i in own.owners[w]})
                        spans[d] = [{"first": a, "end": b} for a, b in _spans(first[s:e], own.size[win[s:e]])]
                yield build(schema, [column(batch, "doc_id"), column(batch, "_key_a"), column(batch, "_key_b"), [len(t) for t in texts], items, pa.array(spans, pa.list_(struct))])

        return read.mapInArrow(match, _FOUND), shared

    slices = _slices(benchmark, item_col, item_text, window, shingle, slice_windows)
    index, after = next(slices, None), next(slices, None)
    rows, shared = found(_ordered(read, index) if index else None)
    if after is None:
        return rows
    # More slices: of every row the first's result is written, of the others what they found; equal rows find the same.
    base, _ = written(rows)
    hits = [base.where(F.size("items") > 0).select("_key_a", "_key_b", "items", "spans")]
    while after is not None:
        shared.destroy()
        rows, shared = found(_ordered(read, after))
        hits.append(written(rows.where(F.size("items") > 0).select("_key_a", "_key_b", "items", "spans"))[0])
        after = next(slices, None)
    shared.destroy()
    # A set: at most one entry for each slice, however often the row is there.
    met = reduce(DataFrame.unionByName, hits).groupBy("_key_a", "_key_b").agg(F.collect_set("items").alias("items"), F.collect_set("spans").alias("spans"))
    met, _ = written(met.select("_key_a", "_key_b", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), F.array_sort(F.flatten("spans")).alias("spans")))
    every = base.drop("items", "spans").join(met, ["_key_a", "_key_b"], "left")
    empty = base.schema["items"].dataType, base.schema["spans"].dataType
    return every.select("doc_id", "_key_a", "_key_b", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in zip(("items", "spans"), empty)])


def _n_hit(spans):
    """Words in the union of spans sorted by first word."""
    seed = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    grown = F.aggregate(spans, seed, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["first"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")))
    return grown["n"].cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_items: int = MIN_ITEMS, **options) -> DataFrame:
    """docs without the rows that contain windows of min_items benchmark items or more; all columns stay as they are.

    Nulls, repeated rows and empty tables as in contamination(); columns of any name stay."""
    found = contamination(docs, benchmark, id_col, text_col, **options)
    a, b = unused(docs.columns, "key_a", "key_b")
    bad = found.where(F.size("items") >= min_items).select(F.col("_key_a").alias(a), F.col("_key_b").alias(b)).distinct()
    return docs.select("*", *row_keys(id_col, text_col, (a, b))).join(bad, [a, b], "left_anti").select(*docs.columns)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", _n_hit(F.col("spans")).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_items >= MIN_ITEMS).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS win, least(8, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT rid, item_id, i, n FROM dw JOIN win USING (win, n)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
