"""SimHash near-dedup at a similarity: wide fingerprints of word shingles compared tile by tile, every link checked exactly.

Two texts whose five-word shingle sets have a Jaccard similarity of 0.8 differ in some 15% of their fingerprint bits, at
worst (four shingles against five) in 3 of 16 on average. 64 bits have no ranges that such texts are sure to share, and
unrelated texts come as near by chance. So a fingerprint has as many bytes here as make two such texts agree on one of them
but for a chance of LOSS: 80 at 0.8. Plan. One Arrow pass gives each text its fingerprint and the digest of its shingle set.
Equal sets collapse to one node. Each node is dealt to one bucket for each byte of its fingerprint. Inside a bucket the
first 256 bits are compared in tiles with exclusive-or and bit counts, tile pairs too far apart in set size or in population
count skipped; a bucket of more than TILE_ROWS rows is cut into shards whose pairs become cells of their own, and a cell
returns spanning links. Components of these links are candidate groups. In a group the pairs within the radius, found by the
same tiles, are checked by their exact Jaccard similarity (those already joined excepted); a group of more than SHARD
members is cut into shards likewise. Groups of texts are the components of the links so verified.

What can be lost: a pair of exactly the similarity that shares no byte, or lies beyond the radius in the first 128 or 256
bits, with a chance of at most LOSS each; at 0.8 that is reached by four shingles against five alone, and pairs of large
sets (15%) come to 2 in 10**11.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import build, column, drop, row_keys, sliced, written
from letterloom.llm.components import connected_components
from letterloom.llm.simhash import _union, one_of_each

SHINGLE_WORDS, SIMILARITY = 5, 0.8
SEED = 42
#: Chance at which a pair of the stated similarity may share no byte, or be beyond a radius.
LOSS = 5e-8
#: Words of a fingerprint that are compared; the first half of them first.
COMPARED = 4
#: Members of a candidate group beyond which it is split into shards compared pair by pair.
SHARD = 512
#: Rows of a bucket beyond which it is split likewise: two shards are 6 MB, all their pairs take about a minute.
TILE_ROWS = 1 << 16
#: Rows and columns of one exclusive-or tile.
TILE_SIDE = 128

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SKETCHES = pa.schema([("doc_id", pa.int64()), ("_key_a", pa.int64()), ("_key_b", pa.int64()), ("node", pa.binary()), ("fp", pa.binary()), ("n", pa.int32())])


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; of all words together where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip((ends - lengths).tolist(), ends[n - 1 :].tolist())], np.uint64))


def fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """The SimHash of 64 bits a word: each hash is mixed anew for each word, and a bit is what most of them have there. A tie
    goes by the first hash, so that ties of unrelated sets are no likeness. Zeros of an empty set."""
    if not len(hashes):
        return bytes(8 * words)
    steps = _STEP * np.arange(1, words + 1, dtype=np.uint64)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):
        z = hashes[at : at + 255, None] + steps
        z = (z ^ (z >> np.uint64(30))) * _MIX[0]
        z = (z ^ (z >> np.uint64(27))) * _MIX[1]
        bits = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1)
        if not at:
            first = bits[0].astype(bool)
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(np.where(2 * ones == len(hashes), first, 2 * ones > len(hashes))).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes; that of two empty ones is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _sketch(words: int):
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t) for t in column(batch, "text").to_pylist()]
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield build(_SKETCHES, [*(column(batch, c) for c in ("doc_id", "_key_a", "_key_b")), nodes, [fingerprint(s, words) for s in sets], [len(s) for s in sets]])

    return sketch


def apart(least: float) -> float:
    """The largest chance that a bit differs in two sets so similar: by their angle, at most that of sets of equal size, or
    where one more hash decides a tie of the smallest even set (3/16 at 0.8; other small sets lie between, as drawn)."""
    if least >= 1:
        return 0.0
    even = 2 * math.ceil(round(least / (1 - least), 9) / 2)
    return max(math.acos(2 * least / (1 + least)) / math.pi, math.comb(even, even // 2) / 2 ** (even + 1))


def words_of(least: float) -> int:
    """Words of a fingerprint of whose bytes two sets so similar share one, but for a chance of LOSS."""
    same = (1 - apart(least)) ** 8
    return max(COMPARED, math.ceil(math.log(LOSS) / math.log1p(-same) / 8) if same < 1 else 0)


@cache
def radius_of(least: float, bits: int) -> int:
    """Bits beyond which sets so similar differ with a chance of at most LOSS."""
    p, left = apart(least), 1.0
    for radius in range(bits):
        left -= math.comb(bits, radius) * p**radius * (1 - p) ** (bits - radius)
        if left <= LOSS:
            return radius
    return bits


def close(words: np.ndarray, sizes: np.ndarray, least: float, side: int = TILE_SIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the fingerprints, a row of COMPARED words each, within the radius and of sizes that allow the similarity,
    tile against tile in order of size; tile pairs too far apart in size or population count are skipped."""
    order = np.argsort(sizes, kind="stable")
    sizes, words = sizes[order], np.ascontiguousarray(words[order].T)
    half, full = radius_of(least, 32 * COMPARED), radius_of(least, 64 * COMPARED)
    counts = np.bitwise_count(words).sum(axis=0, dtype=np.int16)
    starts = list(range(0, len(order), side))
    low, high = (f.reduceat(counts, starts).tolist() for f in (np.minimum, np.maximum)) if starts else ([], [])
    smallest = sizes[starts].tolist()

    def differing(k: int, x: np.ndarray | slice, y: np.ndarray | slice, tile: bool = False) -> np.ndarray:
        return np.bitwise_count((words[k, x][:, None] if tile else words[k, x]) ^ words[k, y])

    for n, s in enumerate(starts):
        a = slice(s, s + side)
        limit = int(sizes[a][-1]) / least + 1e-6
        for m in range(n, len(starts)):
            if smallest[m] > limit:  # all later tiles' sets are larger
                break
            if low[m] - high[n] > full or low[n] - high[m] > full:
                continue
            t = starts[m]
            b = slice(t, t + side)
            found = sum(differing(k, a, b, True) for k in range(1, COMPARED // 2)) + differing(0, a, b, True)
            rows, cols = np.divmod(np.flatnonzero(found <= half), found.shape[1])
            if m == n:
                rows, cols = rows[rows < cols], cols[rows < cols]
            if not len(rows):
                continue
            both = found[rows, cols].astype(np.int16)
            x, y = s + rows, t + cols
            for k in range(COMPARED // 2, COMPARED):
                both += differing(k, x, y)
            near = (both <= full) & (sizes[x] >= least * sizes[y] - 1e-6)
            if near.any():
                yield order[x[near]], order[y[near]]


def _words(fps: pa.Array) -> np.ndarray:
    """The compared words of an array of as many bytes each."""
    return np.frombuffer(fps.cast(pa.binary(8 * COMPARED)).buffers()[1], np.uint64).reshape(-1, COMPARED)[: len(fps)]


def _spanning(least: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def links(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parent = np.arange(len(words))
        for i, j in close(words, sizes, least):
            new = parent[i] != parent[j]
            if new.any():
                _union(parent, i[new], j[new])
        linked = np.flatnonzero(parent != np.arange(len(words)))
        return words[linked], words[parent[linked]]

    def made(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return build(schema, [[x.tobytes() for end in ends for x in end] for ends in zip(*found)])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, words, sizes = column(batch, "cell").to_numpy(), _words(column(batch, "fp")), column(batch, "n").to_numpy()
            edges = np.flatnonzero(np.diff(cells)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)]):
                if cells[s] != at:
                    if held:
                        found.append(links(*map(np.concatenate, zip(*held))))
                    held, at = [], cells[s]
                held.append((words[s:e], sizes[s:e]))
            if found:
                yield made(found)
                found = []
        if held:
            yield made([links(*map(np.concatenate, zip(*held)))])

    return compare


def near_fingerprints(nodes: DataFrame, least: float = SIMILARITY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b), of fingerprints' compared bytes, that span every component of nodes(fp, n) that share a byte of the
    fingerprint and lie within the radius. Empty sets have none."""
    dealt = nodes.where("n > 0").select("fp", "n", F.explode(F.sequence(F.lit(1), F.lit(8 * words_of(least)))).alias("at"))
    dealt = dealt.select(F.substring("fp", 1, 8 * COMPARED).alias("fp"), "n", F.xxhash64("at", F.substring("fp", F.col("at"), F.lit(1))).alias("bucket"))
    # 256 buckets for each byte exist (20,480 at 0.8): a proven bound for the broadcast.
    large = dealt.groupBy("bucket").count().where(F.col("count") > tile_rows).select("bucket", F.ceil(F.col("count") / tile_rows).cast("int").alias("shards"))
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    cells = dealt.join(F.broadcast(large), "bucket", "left").withColumn("shard", F.coalesce(own, F.lit(0)))
    cells = cells.select("fp", "n", "bucket", "shard", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("other"))
    cells = cells.select("fp", "n", F.xxhash64("bucket", F.least("shard", "other"), F.greatest("shard", "other")).alias("cell"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_spanning(least), "a binary, b binary").distinct()


def _verified(least: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def links(held: dict[bytes, tuple[int, bytes, np.ndarray]]) -> tuple[list[bytes], list[bytes]]:
        nodes = sorted(held)
        shard = np.array([held[n][0] for n in nodes], np.int64)
        sets = [held[n][2] for n in nodes]
        size = np.array([len(x) for x in sets], np.int64)
        parent, split = list(range(len(nodes))), len(np.unique(shard)) > 1

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        left, right = [], []
        for i, j in close(_words(pa.array([held[n][1] for n in nodes], pa.binary())), size, least):
            if split:
                i, j = i[shard[i] != shard[j]], j[shard[i] != shard[j]]
            for x, y in zip(i.tolist(), j.tolist()):
                a, b = find(x), find(y)
                if a != b and similarity(sets[x], sets[y]) >= least:
                    parent[b] = a
                    left.append(nodes[x])
                    right.append(nodes[y])
        return left, right

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, bytes, np.ndarray]] = {}
        at = None
        for batch in sliced(batches):
            for cell, shard, node, fp, text in zip(*(column(batch, c).to_pylist() for c in ("cell", "shard", "node", "fp", "text"))):
                if cell != at:
                    yield build(schema, list(links(held)))
                    held, at = {}, cell
                held[node] = (shard, fp, shingles(text))
        yield build(schema, list(links(held)))

    return check


def similar_links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, least: float = SIMILARITY, shard_rows: int = SHARD) -> DataFrame:
    """Links (a, b) of nodes(node, fp, n, _key_a, _key_b), written, that span every group of sets at least so similar.

    Members and group sizes are written before their joins, so that adaptive execution can split a hot key."""
    near = connected_components(near_fingerprints(nodes, least)).withColumnRenamed("node", "fp")
    own = nodes.where("n > 0").select("node", F.substring("fp", 1, 8 * COMPARED).alias("fp"), "_key_a", "_key_b")
    grouped, _ = written(own.join(near, "fp", "left").withColumn("root", F.coalesce("root", "fp")))  # equal compared bytes are a group too
    sizes, _ = written(grouped.groupBy("root").count().where("count > 1").select("root", F.ceil(F.col("count") / shard_rows).cast("int").alias("shards")))
    members = grouped.join(sizes, "root").withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int"))
    read = docs.select(F.col(text_col).alias("text"), *row_keys(id_col, text_col)).join(members, ["_key_a", "_key_b"])
    cells = read.select("node", "fp", "text", "root", "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    cells = cells.select("node", "fp", "text", "shard", F.xxhash64("root", F.least("shard", "other"), F.greatest("shard", "other")).alias("cell"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verified(least), "a binary, b binary")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, shard_rows: int = SHARD) -> DataFrame:
    """docs with one row of each group of similar texts, the one with the smallest id; of fully repeated rows one stays.

    Null and wordless texts are one group. Null ids come last in a group. An empty table gives none. Columns of any name
    stay as they are.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col))
    sketched, _ = written(read.mapInArrow(_sketch(words_of(least)), "doc_id long, _key_a long, _key_b long, node binary, fp binary, n int"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key_a", "_key_b")).alias("first")
    nodes, _ = written(sketched.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("n").alias("n")))
    flat = nodes.select("node", "fp", "n", "first._key_a", "first._key_b")
    links, _ = written(similar_links(docs, flat, id_col, text_col, least, shard_rows))
    groups = nodes.select("node", "first").join(connected_components(links), "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept, _ = written(groups.agg(F.min("first").alias("head")).select("head._key_a", "head._key_b"))
    times = sketched.select("_key_a", "_key_b").join(kept, ["_key_a", "_key_b"]).groupBy("_key_a", "_key_b").agg(F.count(F.lit(1)).alias("times"))
    return one_of_each(docs, times, id_col, text_col)
