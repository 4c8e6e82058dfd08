"""Helpers that the training-data operators share: Arrow slices, document keys, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as Python objects at a time (one longer text is taken alone).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a
    cluster an error, as a temporary folder would be another one on each machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="letterloom-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder and reads it from there: computed once, safe against lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's own folder under the checkpoint folder, deleted when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{checkpoint_root(spark)}/letterloom-{app}"

        def clear() -> None:
            try:
                _delete(spark, _SCRATCH[app])
            except Exception:  # noqa: BLE001  the session may have ended before Python does
                pass

        atexit.register(clear)
    return _SCRATCH[app]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as a Parquet table to the application's scratch folder and read again, and the table's path. Cuts
    lineage as cut() does; columnar files are smaller than checkpoints, and drop() frees them once nothing needs them."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        _delete(spark, path)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; every other character, accented capitals included, stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_keys(id_col: str, text_col: str, names: Sequence[str] = ("_key_a", "_key_b")) -> list[Column]:
    """Two 64-bit hashes of (id, text). Rows equal in both are one document to the operators."""
    text, ident = F.col(text_col), F.col(id_col)
    return [F.xxhash64(ident, text).alias(names[0]), F.xxhash64(text, F.lit("|"), ident).alias(names[1])]


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores added to those that a column (or one before) has already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ddl_of(df: DataFrame, columns: Iterable[str]) -> str:
    """The columns' DDL, for functions over batches that hand them on."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches with at most max_bytes in the named text column (or a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > start and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def build(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, field.type) for c, field in zip(columns, schema)]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)
