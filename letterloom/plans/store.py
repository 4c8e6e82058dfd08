"""The stored tables of a mail archive, and the maintenance of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.operators import fulltext
from letterloom.operators.dedupe import keep_first, upsert
from letterloom.schemas import CHUNK_VECTORS, EMAIL_CHUNKS, EMAIL_VECTORS, EMAILS, columns

SCHEMAS = {"emails": EMAILS, "email_chunks": EMAIL_CHUNKS, "email_vectors": EMAIL_VECTORS, "chunk_vectors": CHUNK_VECTORS}
PARTITIONED = {"emails": ["year", "month"], "email_chunks": ["year", "month"]}


class Store:
    """Parquet tables under one folder. Mail tables are partitioned by year and month, so date filters prune files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def names(self) -> list[str]:
        return [n for n in SCHEMAS if self.exists(n)]

    def read(self, name: str) -> DataFrame:
        """The table; an empty one of its schema where it doesn't exist yet."""
        self._restore(name)
        if not self.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def _write(self, rows: DataFrame, name: str, mode: str, path: str | None = None) -> None:
        rows = rows.select(*columns(SCHEMAS[name]))
        by = PARTITIONED.get(name)
        if by:
            rows = rows.hint("rebalance", *[F.col(c) for c in by])  # tasks by size: a large month isn't one, a small one not many
        writer = rows.write.mode(mode)
        (writer.partitionBy(*by) if by else writer).parquet(path or self.path(name))

    def append(self, rows: DataFrame, name: str) -> None:
        self._write(rows, name, "append")

    def create(self, rows: DataFrame, name: str) -> None:
        self._write(rows, name, "overwrite")

    def replace(self, rows: DataFrame, name: str) -> None:
        """Overwrites a table with rows that may be read from it: written beside it first, then the old one is renamed away
        and the new one to its place. A stop at any point leaves one whole table: read() takes the old one back."""
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        new, held, old = (jvm(self.path(n)) for n in (f"_{name}_new", name, f"_{name}_old"))
        self._write(rows, name, "overwrite", str(new))
        fs = new.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, True)
        if fs.exists(held):
            fs.rename(held, old)
        fs.rename(new, held)
        fs.delete(old, True)

    def _restore(self, name: str) -> None:
        """Takes back a table whose replacement stopped between its two renames."""
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        held, old = jvm(self.path(name)), jvm(self.path(f"_{name}_old"))
        fs = held.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(held) and fs.exists(old):
            fs.rename(old, held)

    def upsert(self, rows: DataFrame, name: str, keys: list[str]) -> None:
        """Rows in place of stored ones with equal keys; rows of this batch must be unique by them, and their vectors as long
        as the store's."""
        self.check_vectors(rows, name)
        self.replace(upsert(self.read(name), rows.select(*columns(SCHEMAS[name])), keys), name)

    def check_vectors(self, rows: DataFrame, name: str) -> None:
        """Raises where a vector isn't as long as the store's embedding_dimension (if it has one)."""
        wanted = self.meta().get("embedding_dimension")
        vectors = [c for c in ("subject_vector", "chunk_vector") if c in SCHEMAS[name] and c in rows.columns]
        for c in vectors if wanted else []:
            if not rows.where(F.col(c).isNotNull() & (F.size(c) != int(wanted))).isEmpty():
                raise ValueError(f"{name}: a {c} isn't {wanted} long")

    def drop(self, name: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def compact(self, name: str) -> None:
        """Rewrites a table into few files for each month."""
        self.replace(self.read(name), name)

    def dedupe(self, name: str, key: str, dry_run: bool = False) -> int:
        """Keeps the first row of each key by place in the mailbox; returns how many rows go."""
        rows = self.read(name)
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()
        if counts[0] and not dry_run:
            order = [c for c in ("mbox_file", "mbox_offset", "chunk_index") if c in rows.columns]
            self.replace(keep_first(rows, [key], [*order, key]), name)
        return counts[0]

    def index_fulltext(self) -> fulltext.Index:
        fulltext.build(self.read("emails")).write(self.path("fulltext"))
        return self.fulltext()

    def fulltext(self) -> fulltext.Index:
        if not self.exists("fulltext/postings"):
            return self.index_fulltext()
        return fulltext.Index.read(self.spark, self.path("fulltext"))

    # Metadata of the embedding store: one row that later writes must agree with.
    def meta(self) -> dict:
        return {r["key"]: r["value"] for r in self.spark.read.json(self.path("meta")).collect()} if self.exists("meta") else {}

    def ensure_meta(self, wanted: dict) -> None:
        have = self.meta()
        different = {k: (have[k], str(v)) for k, v in wanted.items() if k in have and have[k] != str(v)}
        if different:
            raise ValueError(f"metadata mismatch: {different}")
        if not have:
            self.spark.createDataFrame([(k, str(v)) for k, v in wanted.items()], "key string, value string").coalesce(1).write.mode("overwrite").json(self.path("meta"))


def embedding_meta(provider, chunk_size: int, overlap: int, source: str = "") -> dict:
    return {
        "embedding_model": provider.model, "embedding_model_revision": provider.revision, "embedding_dimension": provider.dimension,
        "chunk_size": chunk_size, "chunk_overlap": overlap, "format_version": 1, **({"source": source} if source else {}),
    }
