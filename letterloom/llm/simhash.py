"""SimHash near-dedup: 64-bit fingerprints compared exactly, tile against tile.

Plan. Fingerprints come from one Arrow pass over the text. Equal fingerprints collapse to one row, so groups
of exact copies never meet pairwise. Each distinct fingerprint is dealt to radius + 1 buckets, one for each of
radius + 1 bit ranges: two fingerprints within the radius agree on at least one range, so no link is lost.
Inside a bucket, tiles sorted by population count are compared with exclusive-or and bit counts, and tile pairs
whose population counts differ by more than the radius are skipped. A bucket of more than TILE_ROWS rows is cut
into shards whose pairs become cells of their own, so no task holds an unbounded bucket. A cell returns a
spanning star per cluster, never all pairs. Components are found over each fingerprint's smallest document, so that a
component's root is the answer itself and nothing is joined by group. Where a radius that buckets can serve is too narrow,
as for word shingles of a given similarity, neardup.py puts the same tiles to use.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import build, column, row_keys, sliced, table, unused, written
from letterloom.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Rows of a bucket beyond which it is split into shards compared pair by pair: two shards are 4 MB, compared in about a minute.
TILE_ROWS = 1 << 18
#: Rows and columns of one exclusive-or tile: 2 MB of 64-bit words.
TILE_SIDE = 512

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("_key_a", pa.int64()), ("_key_b", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles (repeats count); 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle_words - 1 :].tolist())], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def close_pairs(values: np.ndarray, radius: int, side: int = TILE_SIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the uint64 values that lie within radius bits of one another, tile against tile in order of population
    count; tile pairs whose counts differ by more are skipped."""
    counts = np.bitwise_count(values).astype(np.int16)
    order = np.argsort(counts, kind="stable")
    tiles = [order[i : i + side] for i in range(0, len(order), side)]
    for i, a in enumerate(tiles):
        x, high = values[a][:, None], counts[a[-1]]
        for b in tiles[i:]:
            if counts[b[0]] - high > radius:  # all later tiles differ more
                break
            rows, cols = np.nonzero(np.bitwise_count(x ^ values[b][None, :]) <= radius)
            if b is a:
                rows, cols = rows[rows < cols], cols[rows < cols]
            if len(rows):
                yield a[rows], b[cols]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, _key_a, _key_b, fp): one row per input row; fp is the fingerprint as a signed long."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(t, shingle_words) for t in column(batch, "text").to_pylist()], dtype=np.uint64)
            yield build(_FINGERPRINTS, [column(batch, "doc_id"), column(batch, "_key_a"), column(batch, "_key_b"), pa.array(found.view(np.int64))])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col))
    return read.mapInArrow(score, "doc_id long, _key_a long, _key_b long, fp long")


def _union(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the sets of left[i] and right[i]; parent stays flat, each set's root its smallest member."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def tile_links(values: np.ndarray, radius: int = RADIUS, side: int = TILE_SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (value, root) of the distinct uint64 values that lie within radius bits of one another."""
    values = np.sort(values)
    parent = np.arange(len(values))
    for left, right in close_pairs(values, radius, side):
        _union(parent, left, right)
    linked = np.nonzero(parent != np.arange(len(values)))[0]
    return values[linked], values[parent[linked]]


def _cells(radius: int):
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[np.ndarray] = []
        at = None

        def flush():
            values = np.concatenate(held) if len(held) > 1 else held[0]
            if len(values) > 1:
                a, b = tile_links(np.ascontiguousarray(values).view(np.uint64), radius)
                if len(a):
                    yield build(schema, [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, values = column(batch, "cell").to_numpy(), column(batch, "fp").to_numpy()
            edges = np.nonzero(np.diff(cells))[0] + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)]):
                if cells[s] != at:
                    if held:
                        yield from flush()
                    held, at = [], cells[s]
                held.append(values[s:e])
        if held:
            yield from flush()

    return compare


def near_links(values: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """values(fp long), distinct. Links (a, b) that span every component of fingerprints within radius bits."""
    n = radius + 1
    bounds = [64 * i // n for i in range(n + 1)]
    ranges = F.array(*[F.lit(i << 32).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))])
    dealt = values.select("fp", F.explode(ranges).alias("bucket"))
    # At most (radius + 1) * 2**ceil(64 / (radius + 1)) buckets exist (40,960 at radius 4): a proven bound for the broadcast.
    large = dealt.groupBy("bucket").count().where(F.col("count") > tile_rows).select("bucket", F.ceil(F.col("count") / tile_rows).cast("int").alias("shards"))
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    cells = dealt.join(F.broadcast(large), "bucket", "left").withColumn("shard", F.coalesce(own, F.lit(0)))
    cells = cells.select("fp", "bucket", "shard", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("other"))
    cells = cells.select("fp", F.xxhash64("bucket", F.least("shard", "other"), F.greatest("shard", "other")).alias("cell"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, _key_a, _key_b, fp, and of its component the smallest document: component_id, rep_a, rep_b.

    Null and wordless texts have fingerprint 0 and link like any other. Null ids come last in a component, so
    component_id is null only if every member's id is. Repeated rows each get their row. An empty table gives none.
    """
    docs_fp, _ = written(fingerprints(docs, id_col, text_col, shingle_words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key_a", "_key_b")).alias("first")
    distinct, _ = written(docs_fp.groupBy("fp").agg(first))
    links, _ = written(near_links(distinct.select("fp"), radius))
    ends = [distinct.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}")) for side in ("a", "b")]
    nodes = links.join(ends[0], "a").join(ends[1], "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    stars = connected_components(nodes)
    members = distinct.join(stars, distinct["first"] == stars["node"], "left").select("fp", F.coalesce("root", "first").alias("head"))
    # Written, so that both sides of the join are plain exchanges and a fingerprint of very many documents can be split.
    classes, _ = written(members.select("fp", F.col("head.doc_id").alias("component_id"), F.col("head._key_a").alias("rep_a"), F.col("head._key_b").alias("rep_b")))
    return docs_fp.join(classes, "fp")


def one_of_each(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs' rows whose keys are in kept(_key_a, _key_b, times); of rows that are there several times one."""
    a, b, times = unused(docs.columns, "key_a", "key_b", "times")
    keep, _ = written(kept.select(F.col("_key_a").alias(a), F.col("_key_b").alias(b), F.col("times").alias(times)))
    keyed = docs.select("*", *row_keys(id_col, text_col, (a, b))).join(keep, [a, b])
    again = keyed.where(F.col(times) > 1).dropDuplicates([a, b])
    return keyed.where(F.col(times) == 1).unionByName(again).select(*docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each near-duplicate group, the one with the smallest id; of fully repeated rows one stays.

    Nulls, empty tables and wordless texts as in near_duplicates(); columns of any name stay as they are.
    """
    found = near_duplicates(docs, id_col, text_col, shingle_words, radius)
    kept = found.where("_key_a = rep_a and _key_b = rep_b").groupBy("_key_a", "_key_b").agg(F.count(F.lit(1)).alias("times"))
    return one_of_each(docs, kept, id_col, text_col)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
