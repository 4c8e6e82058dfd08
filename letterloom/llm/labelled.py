"""Bounded samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a fit takes at most.
ROWS_PER_CLASS = 1500
#: Texts beyond so many bytes aren't taken for fitting; every text is scored whole.
MAX_TEXT_BYTES = 32768


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], classes: Sequence[tuple], train: Column, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = ROWS_PER_CLASS, max_bytes: int = MAX_TEXT_BYTES) -> list[tuple[str, tuple, float]]:
    """(text, labels, weight) of at most rows_per_class documents of each of the classes, the label combinations to learn.

    train is a condition on the label table's id. Rows are taken in an order given by a hash of the id, so the sample
    is the same at every run. Weights restore the classes' shares among the training labels (mean 1). Null labels and
    ids, labels of no class, and labels without a document are left out; an id with several labels keeps its smallest.
    """
    ident = labels.select(F.col(id_col).alias("i"), *label_cols).where(train).dropna()
    one = ident.groupBy("i").agg(F.min(F.struct(*label_cols)).alias("y")).select("i", "y.*")
    conditions = [reduce(and_, (F.col(c) == F.lit(v) for c, v in zip(label_cols, values))) for values in classes]
    counted = one.agg(*[F.count_if(test).alias(f"n{k}") for k, test in enumerate(conditions)]).first()
    parts = [one.where(test).select("i", F.lit(k).alias("k")).orderBy(F.xxhash64("i"), "i").limit(rows_per_class) for k, test in enumerate(conditions)]
    # rows_per_class ids for each class: a proven bound for the broadcast.
    chosen = F.broadcast(reduce(DataFrame.unionByName, parts))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.octet_length("t") <= max_bytes)
    rows = sorted(texts.join(chosen, "i").groupBy("i", "k").agg(F.min("t").alias("t")).collect(), key=lambda r: r["i"])
    taken = Counter(r["k"] for r in rows)
    total = sum(counted[k] for k in taken)
    return [(r["t"], tuple(classes[r["k"]]), counted[r["k"]] / total / taken[r["k"]] * len(rows)) for r in rows]
