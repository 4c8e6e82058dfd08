"""Retrieval metrics over ranked hits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of one block of the search.
QUERY_BLOCK, ROW_BLOCK = 256, 4096


class _Nearest:
    """The k nearest rows of each of a block of queries so far. One matrix product gives a block's distances but for rounding;
    rows that are within the k nearest by that, or could be but for rounding, are measured exactly."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int):
        self.ids, self.vectors, self.labels, self.k = ids, vectors, labels, k
        self.norms = np.square(vectors).sum(axis=1)
        self.best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, bool))] * len(ids)  # distances, ids, relevant
        self.limit = np.full(len(ids), np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        norms = np.square(vectors).sum(axis=1)
        about = self.norms[:, None] + norms - 2 * (self.vectors @ vectors.T)
        # Over n terms, rounding moves either way of summing by less than this; a value that isn't finite is measured exactly.
        slack = 8 * (vectors.shape[1] + 4) * np.finfo(np.float64).eps * (self.norms + norms.max())
        bound = self.limit
        if len(ids) > self.k + 1:  # the query itself may be among them
            bound = np.minimum(bound, np.partition(about, self.k, axis=1)[:, self.k] + slack)
        maybe = ~(about > (bound + slack)[:, None])
        for i in np.nonzero(maybe.any(axis=1))[0]:
            at = np.nonzero(maybe[i] & (ids != self.ids[i]))[0]
            distance = np.square(vectors[at] - self.vectors[i]).sum(axis=1)
            held = [np.concatenate(x) for x in zip(self.best[i], (distance, ids[at], labels[at] == self.labels[i]))]
            first = np.lexsort((held[1], held[0]))[: self.k]
            self.best[i] = tuple(x[first] for x in held)
            if len(first) == self.k:
                self.limit[i] = held[0][first[-1]]

    def rows(self) -> pa.RecordBatch:
        distance, ids, relevant = (np.concatenate(x) for x in zip(*self.best))
        query = np.repeat(self.ids, [len(d) for d, _, _ in self.best])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (query, ids, distance, relevant)], names=["query", "vec_id", "distance", "relevant"])


def nearest_others(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """rows, queries(vec_id, embedding, label). query, rank and relevant of the k nearest other rows of every query, all
    compared (squared L2, ties by id) in blocks of both sides; relevant ones have the query's label."""

    def blocks(df: DataFrame, size: int, prefix: str) -> DataFrame:
        # The block's number within its input partition; each block is one row of arrays.
        place = F.struct(F.spark_partition_id().alias("part"), F.floor((F.monotonically_increasing_id() % (1 << 33)) / size).alias("n"))
        held = df.select(place.alias("block"), F.struct("vec_id", "embedding", "label").alias("v"))
        held = held.groupBy("block").agg(F.collect_list("v").alias("v"))
        return held.select(F.col("v.vec_id").alias(f"{prefix}_id"), F.flatten("v.embedding").alias(f"{prefix}_vector"), F.col("v.label").alias(f"{prefix}_label"))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: _Nearest | None = None  # of one block of queries, as a task meets each with all its rows' blocks one after the other
        for batch in batches:
            for pair in range(batch.num_rows):
                q_id, q, q_label, v_id, v, v_label = (batch.column(i)[pair].values.to_numpy(zero_copy_only=False) for i in range(6))
                q = q.astype(np.float64).reshape(len(q_id), -1)
                if near is None or not all(map(np.array_equal, (near.ids, near.vectors, near.labels), (q_id, q, q_label))):
                    if near is not None:
                        yield near.rows()
                    near = _Nearest(q_id, q, q_label, k)
                near.add(v_id, v.astype(np.float64).reshape(len(v_id), -1), v_label)
        if near is not None:
            yield near.rows()

    pairs = blocks(queries, QUERY_BLOCK, "q").crossJoin(blocks(rows, ROW_BLOCK, "v"))
    found = pairs.mapInArrow(search, "query long, vec_id long, distance double, relevant boolean")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "relevant")


def precision_at(hits: DataFrame, k: int) -> DataFrame:
    """hits(query, rank, relevant boolean). One row for each query: the share of relevant ones among the first k."""
    return hits.where(F.col("rank") <= k).groupBy("query").agg((F.count_if("relevant") / k).alias("precision"))


def reciprocal_rank(hits: DataFrame) -> DataFrame:
    """One row for each query: one over the rank of the first relevant hit, or 0."""
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return hits.groupBy("query").agg(F.coalesce(1 / first, F.lit(0.0)).alias("rr"))
