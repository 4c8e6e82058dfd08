"""Registered queries over the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions import headers as H
from letterloom.functions import text as X
from letterloom.functions.chunks import exploded
from letterloom.functions.ids import email_id, hash16, thread_id
from letterloom.functions.mime import body_of
from letterloom.operators import dedupe, filters, fulltext, hybrid, joins, metrics, rules, stats, vectors
from letterloom.operators.validate import summary, validated
from letterloom.plans.query import STOP_WORDS, keyword_array
from letterloom.plans.stages import preprocess
from letterloom.sources.mbox import MONTHS, read_mbox, scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- The shared tables in the shape of mail -------------------------------------------------------------------------


def order_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a mail log: the customer sends, the priority is the label, urgent ones have an attachment."""
    o = table(spark, sf_dir, "orders")
    customer = F.col("o_custkey").cast("string")
    domain = F.concat(F.lit("team"), (F.col("o_custkey") % 7).cast("string"), F.lit(".example"))
    return o.select(
        F.col("o_orderkey").alias("email_id"),
        F.concat(F.lit("user"), customer, F.lit("@"), domain).alias("from_address"),
        F.concat(F.lit("User "), customer).alias("from_name"),
        F.concat(F.lit("desk"), (F.col("o_custkey") % 11).cast("string"), F.lit("@support.example")).alias("to_addresses_str"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("date"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.col("o_orderpriority").alias("labels_str"),
        F.col("o_orderpriority").startswith("1").alias("has_attachment"),
    )


_MAILS = """
mails AS (
  SELECT o_orderkey AS email_id, 'user' || o_custkey || '@team' || (o_custkey % 7) || '.example' AS from_address,
         'User ' || o_custkey AS from_name, 'desk' || (o_custkey % 11) || '@support.example' AS to_addresses_str,
         o_orderdate AS date, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month,
         o_orderpriority AS labels_str, starts_with(o_orderpriority, '1') AS has_attachment
  FROM orders
)"""

# ---- Counts, lookups and filters ------------------------------------------------------------------------------------


@query(f"WITH {_MAILS} SELECT from_address, count(*) AS n FROM mails GROUP BY 1 ORDER BY n DESC, from_address LIMIT 10")
def top_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_senders(order_mails(spark, sf_dir))


@query(f"WITH {_MAILS} SELECT from_address, count(*) AS n FROM mails WHERE year = 1997 GROUP BY 1 ORDER BY n DESC, from_address LIMIT 10")
def top_senders_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_senders(order_mails(spark, sf_dir), 1997)


@query(f"WITH {_MAILS} SELECT count(*) AS n FROM mails WHERE year = 1996 AND has_attachment")
def count_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_where(order_mails(spark, sf_dir), filters.where({"year": 1996, "has_attachment": True}))


@query(f"WITH {_MAILS} SELECT count(*) AS n FROM mails")
def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_where(order_mails(spark, sf_dir))


@query(f"WITH {_MAILS} SELECT year, count(*) AS n FROM mails WHERE year <> 0 GROUP BY year")
def count_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_year(order_mails(spark, sf_dir))


@query(f"WITH {_MAILS} SELECT year, month, count(*) AS n FROM mails GROUP BY year, month")
def count_by_year_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_mails(spark, sf_dir).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MAILS} SELECT * FROM mails WHERE email_id = 100")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_id(order_mails(spark, sf_dir), 100)


@query(f"WITH {_MAILS} SELECT email_id, date FROM mails WHERE from_address = 'user10@team3.example' ORDER BY date, email_id LIMIT 100")
def get_by_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_sender(order_mails(spark, sf_dir), "user10@team3.example").select("email_id", "date")


@query(f"WITH {_MAILS} SELECT email_id, date FROM mails WHERE date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-02-01' ORDER BY date, email_id LIMIT 1000")
def get_by_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    return filters.by_date_range(order_mails(spark, sf_dir), datetime(1996, 1, 1), datetime(1996, 2, 1)).select("email_id", "date")


_PLANS: dict[str, tuple[dict, str]] = {
    "address": ({"from": "user5@team5.example"}, "from_address = 'user5@team5.example'"),
    "dotted": ({"from": "team3.example"}, "contains(from_address, '@team3.example')"),
    "name": ({"from": "User 12"}, "contains(from_name, 'User 12') OR contains(from_address, 'User 12')"),
    "to": ({"to": "support.example"}, "contains(to_addresses_str, '@support.example')"),
    "domain": ({"from_domain": "team1"}, "contains(from_address, '@team1')"),
    "year_month": ({"year": "1997", "month": 3}, "year = 1997 AND month = 3"),
    "attachment": ({"has_attachment": "no"}, "NOT has_attachment"),
    "dates": ({"start_date": "1996-05-01", "end_date": "1996-06-01T12:00:00"}, "date >= TIMESTAMP '1996-05-01' AND date <= TIMESTAMP '1996-06-01 12:00:00'"),
    "labels": ({"labels": ["URGENT", "1"]}, "contains(labels_str, 'URGENT') AND contains(labels_str, '1')"),
    "wildcards": ({"from": "100%' OR 1=1"}, "contains(from_name, '100%'' OR 1=1') OR contains(from_address, '100%'' OR 1=1')"),
}


@query("WITH " + _MAILS + " " + " UNION ALL ".join(f"SELECT '{k}' AS plan, count(*) AS n, coalesce(sum(email_id), 0)::BIGINT AS ids FROM mails WHERE {sql}" for k, (_, sql) in _PLANS.items()))
def where_plan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = order_mails(spark, sf_dir)
    tests = {k: filters.where(f) for k, (f, _) in _PLANS.items()}
    one = mails.agg(*[F.struct(F.lit(k).alias("plan"), F.count_if(t).alias("n"), F.coalesce(F.sum(F.when(t, F.col("email_id"))), F.lit(0)).alias("ids")).alias(k) for k, t in tests.items()])
    return one.select(F.inline(F.array(*tests)))


# ---- Duplicates, samples and upserts ---------------------------------------------------------------------------------


@query("""
SELECT sum(n)::BIGINT AS total, count(*) AS unique_keys, count(*) FILTER (n > 1) AS duplicate_keys, sum(n - 1)::BIGINT AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
""")
def duplicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicate_stats(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, 1, 2 LIMIT 5")
def duplicate_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.top_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(_LINE_ORDER)}) = 1
""")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_LINE_ORDER)
    return dedupe.keep_first(rows, ["l_orderkey", "l_linenumber"], _LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1
""")
def dedupe_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("sha")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def first_n_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_n(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 5)


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 50")
def sample_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.sample_sequential(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"], 50).select("event_id")


@query()
def sample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.sample_random(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 50, seed=3)


@query("""
SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    old, new = e.where("ts < timestamp '2024-01-15'"), e.where("ts >= timestamp '2024-01-15'")
    order = [F.desc("ts"), F.desc("event_id")]
    merged = dedupe.upsert(dedupe.keep_first(old, ["user_id"], order), dedupe.keep_first(new, ["user_id"], order), ["user_id"])
    return merged.select("user_id", "event_id", "value")


# ---- Joins ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.skip_existing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, vec_id IS NULL AS missing FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("email_id"))
    vectors_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("email_id"), F.col("embedding").alias("subject_vector"), F.lit(1).alias("chunk_count"))
    return joins.with_subject_vectors(mails, vectors_).select(F.col("email_id").alias("doc_id"), F.col("subject_vector").isNull().alias("missing"))


@query("""
SELECT coalesce(a.k, b.k) AS email_id, coalesce(x, 0) AS text_chunks, coalesce(y, 0) AS vector_chunks
FROM (SELECT o_orderkey AS k, 1 + o_orderkey % 7 AS x FROM orders) a
FULL JOIN (SELECT l_orderkey AS k, count(*) AS y FROM lineitem GROUP BY 1) b ON a.k = b.k WHERE coalesce(x, 0) <> coalesce(y, 0)
""")
def chunk_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("email_id"), F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 7).cast("int"))).alias("chunk_index"))
    return joins.chunk_count_mismatches(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("email_id")))


@query("""
SELECT l_orderkey AS email_id, list(l_linenumber ORDER BY l_linenumber)::VARCHAR AS indexes FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1
""")
def ordered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("email_id"), F.col("l_linenumber").alias("chunk_index")).distinct().withColumn("chunk_vector", F.col("chunk_index"))
    out = joins.ordered_chunk_vectors(v)
    return out.select("email_id", F.concat(F.lit("["), F.array_join(F.col("chunk_vectors").cast("array<string>"), ", "), F.lit("]")).alias("indexes"))


# ---- Vectors, full text and fusion ------------------------------------------------------------------------------------


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One stored vector by its id: a single bounded row."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


_DISTANCES = """
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, label, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - e[i]::DOUBLE) ** 2)) AS dist FROM embeddings, q)"""


@query(f"WITH {_DISTANCES} SELECT vec_id, round(dist, 6) AS dist FROM d ORDER BY d.dist, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, "vec_id", "embedding")
    return near.select("vec_id", F.round("distance", 6).alias("dist"))


@query(f"WITH {_DISTANCES} SELECT vec_id, round(dist, 6) AS dist FROM d WHERE label = 3 ORDER BY d.dist, vec_id LIMIT 10")
def vector_topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, "vec_id", "embedding", F.col("label") == 3)
    return near.select("vec_id", F.round("distance", 6).alias("dist"))


@query(f"WITH {_DISTANCES} SELECT vec_id, round(dist, 6) AS dist FROM d WHERE vec_id <> 0 ORDER BY d.dist, vec_id LIMIT 10")
def similar_exclude_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar(table(spark, sf_dir, "embeddings"), 0, 10, "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("dist"))


@query(f"""
WITH {_DISTANCES}, hits AS (SELECT vec_id, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM d ORDER BY dist, vec_id LIMIT 80)
SELECT vec_id // 4 AS mail, min(rank) AS rank, arg_min(vec_id, rank) AS chunk FROM hits GROUP BY 1
""")
def chunk_vector_best_per_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 80, "vec_id", "embedding").select("vec_id", "distance")
    hits = hybrid.ranked(near, "distance", "vec_id").select(F.floor(F.col("vec_id") / 4).alias("mail"), "rank", F.col("vec_id").alias("chunk"))
    return vectors.best_per_mail(hits, "mail").select("mail", F.col("rank").cast("long").alias("rank"), "chunk")


_TERMS = ("the", "tion", "was", "und")
_BM25 = r"""
toks AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf FROM toks GROUP BY 1, 2),
lens AS (SELECT d.doc_id, coalesce(n, 0) AS len FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM toks GROUP BY 1) USING (doc_id)),
tot AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM lens),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
bm AS (
  SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
  FROM post JOIN df USING (term) JOIN lens USING (doc_id), tot WHERE term IN ('the', 'tion', 'was', 'und') GROUP BY 1
)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 30")
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fulltext.search(fulltext.build(table(spark, sf_dir, "documents"), "doc_id", ["text"]), _TERMS, 30)
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 30")
def fts_scan_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fulltext.scan(table(spark, sf_dir, "documents"), _TERMS, 30, "doc_id", ["text"])
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""
WITH {_DISTANCES}, {_BM25},
s AS (SELECT vec_id AS k, row_number() OVER (ORDER BY dist, vec_id) AS r FROM d ORDER BY dist, vec_id LIMIT 40),
c AS (SELECT vec_id // 4 AS k, row_number() OVER (ORDER BY dist, vec_id) AS r FROM d ORDER BY dist, vec_id LIMIT 100),
f AS (SELECT doc_id AS k, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm ORDER BY score DESC, doc_id LIMIT 60),
g AS (
  SELECT k, min(r) FILTER (x = 's') AS sr, min(r) FILTER (x = 'b') AS br, min(r) FILTER (x = 'f') AS fr
  FROM (SELECT *, 's' AS x FROM s UNION ALL SELECT *, 'b' FROM c UNION ALL SELECT *, 'f' FROM f) GROUP BY k
)
SELECT k AS doc_id, round(coalesce(0.4 / (60 + fr), 0) + greatest(coalesce(1.2 / (60 + sr), 0), coalesce(1.0 / (60 + br), 0)), 6) AS score,
       CASE WHEN br IS NOT NULL AND coalesce(1.0 / (60 + br), 0) >= coalesce(1.2 / (60 + sr), 0) THEN 'body' WHEN sr IS NOT NULL THEN 'subject' ELSE 'fulltext' END AS shown
FROM g ORDER BY coalesce(0.4 / (60 + fr), 0) + greatest(coalesce(1.2 / (60 + sr), 0), coalesce(1.0 / (60 + br), 0)) DESC, k LIMIT 20
""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_subject, n_body, n_text = hybrid.overfetch(20)
    e = table(spark, sf_dir, "embeddings")
    near = vectors.nearest(e, _query_vector(spark, sf_dir), n_body, "vec_id", "embedding").select("vec_id", "distance")
    ranks = hybrid.ranked(near, "distance", "vec_id")
    subject = ranks.where(F.col("rank") <= n_subject).select(F.col("vec_id").alias("key"), "rank")
    body = ranks.select(F.floor(F.col("vec_id") / 4).alias("key"), "rank")
    text = hybrid.ranked(fulltext.scan(table(spark, sf_dir, "documents"), _TERMS, n_text, "doc_id", ["text"]), F.desc("score"), "key")
    return hybrid.fuse(subject, body, text, 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "shown")


_STATED_HITS = """
pairs AS (
  SELECT a.vec_id AS q, b.vec_id AS v, a.label = b.label AS relevant,
         list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) AS dist
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), hits AS (SELECT q AS query, relevant, row_number() OVER (PARTITION BY q ORDER BY dist, v) AS rank FROM pairs QUALIFY rank <= 10)"""


def _stated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every vector whose id is divisible by 20, the stated query set."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return metrics.nearest_others(e, e.where("vec_id % 20 = 0"), 10)


@query(f"WITH {_STATED_HITS} SELECT query, count(*) FILTER (relevant) / 5.0 AS precision FROM hits WHERE rank <= 5 GROUP BY 1")
def precision_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision_at(_stated_hits(spark, sf_dir), 5)


@query(f"WITH {_STATED_HITS} SELECT query, round(coalesce(1.0 / min(rank) FILTER (relevant), 0), 6) AS rr FROM hits GROUP BY 1")
def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reciprocal_rank(_stated_hits(spark, sf_dir)).select("query", F.round("rr", 6).alias("rr"))


# ---- Identifiers, threads and periods ---------------------------------------------------------------------------------


@query("""
SELECT doc_id, substr(sha256(CASE WHEN doc_id % 3 = 0 THEN source || '|' || lang || '|' || substr(text, 1, 100) ELSE 'msg-' || doc_id END), 1, 16) AS email_id
FROM documents
""")
def email_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("msg-"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", email_id(ident, F.col("source"), F.col("lang"), F.col("text")).alias("email_id"))


@query(r"""
SELECT conv_id, turn, substr(sha256(CASE conv_id % 4 WHEN 1 THEN 'ref-' || conv_id WHEN 2 THEN 'irt-' || conv_id
         ELSE regexp_replace(lower(trim(CASE WHEN conv_id % 4 = 0 THEN 'Re: ' ELSE 'FWD: ' END || role)), '^(re:|fwd?:)\s*', '') END), 1, 16) AS thread_id
FROM conversations
""")
def thread_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, kind = F.col("conv_id").cast("string"), F.col("conv_id") % 4
    refs = F.when(kind == 1, F.array(F.concat(F.lit("ref-"), c)))
    subject = F.concat(F.when(kind == 0, "Re: ").otherwise("FWD: "), F.col("role"))
    out = thread_id(F.lit(None).cast("string"), refs, F.when(kind == 2, F.concat(F.lit("irt-"), c)), subject)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("thread_id"))


@query("""
SELECT substr(sha256('conv-' || conv_id), 1, 16) AS thread_id, count(*) AS mails, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1
""")
def thread_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("thread_id", hash16(F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))))
    return c.groupBy("thread_id").agg(F.count(F.lit(1)).alias("mails"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS emails, sum(o_custkey)::BIGINT AS bytes FROM orders GROUP BY 1")
def month_partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_period(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_custkey").alias("length")))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1")
def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.spread(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", F.round("mean", 6).alias("mean"), "least", "most", F.round("deviation", 6).alias("deviation"))


# ---- Bulk mail and ignore rules ---------------------------------------------------------------------------------------


def _header_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with made-up headers that set off every rule."""
    n = F.col("doc_id")

    def pick(by: int, values: dict[int, str]) -> Column:
        out = None
        for k, v in values.items():
            out = F.when(n % by == k, F.lit(v)) if out is None else out.when(n % by == k, F.lit(v))
        return out

    headers = F.create_map(
        F.lit("x-gmail-labels"), pick(11, {1: "Inbox,\\Spam", 2: "\\Trash", 3: "CATEGORY_PROMOTIONS"}),
        F.lit("from"), pick(13, {1: "MAILER-DAEMON@x.example", 2: "Postmaster@y.example"}),
        F.lit("x-mailer"), pick(17, {1: "MailChimp Mailer", 2: "HubSpot"}),
        F.lit("precedence"), pick(5, {1: "bulk"}),
    )
    listed = F.when(n % 10 == 1, F.create_map(F.lit("list-id"), F.lit("<l.example>")))
    return table(spark, sf_dir, "documents").withColumn("h", F.map_concat(headers, F.coalesce(listed, F.create_map().cast("map<string,string>"))))


_SPAM = r"""
CASE WHEN doc_id % 11 = 1 THEN 'label:spam' WHEN doc_id % 11 = 2 THEN 'label:trash' WHEN doc_id % 11 = 3 THEN 'label:promotions'
     WHEN doc_id % 13 = 1 THEN 'sender:mailer-daemon@' WHEN doc_id % 13 = 2 THEN 'sender:postmaster@'
     WHEN doc_id % 17 = 1 THEN 'mailer:mailchimp' WHEN doc_id % 17 = 2 THEN 'mailer:hubspot'
     WHEN doc_id % 5 = 1 AND doc_id % 10 <> 1 THEN 'precedence:bulk' END"""


@query(f"SELECT doc_id, {_SPAM} AS reason FROM documents")
def spam_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_docs(spark, sf_dir).select("doc_id", H.spam_reason(F.col("h")).alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_SPAM} AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1")
def spam_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_header_docs(spark, sf_dir).select(H.spam_reason(F.col("h")).alias("reason")).where("reason is not null"))


_RULES = (
    rules.Rule("r1", "sender", "src3@mail.example", "one sender"),
    rules.Rule("r2", "domain", "lists.example", "a domain"),
    rules.Rule("r3", "subject_contains", "THE ", "subject words"),
    rules.Rule("r4", "subject_regex", r"^[0-9]", "subject form"),
    rules.Rule("r5", "label", "De", "a label"),
    rules.Rule("r6", "header_equals", "7", "a header", "x_slot"),
    rules.Rule("r7", "header_contains", "9", "a header's part", "x_slot"),
    rules.Rule("r8", "no_such_type", "x"),
)
_RULE_SQL = """
CASE WHEN sender = 'src3@mail.example' THEN 'r1' WHEN split_part(sender, '@', 2) = 'lists.example' THEN 'r2'
     WHEN contains(lower(subject), 'the') AND contains(lower(subject), 'the ') THEN 'r3' WHEN regexp_matches(subject, '^[0-9]') THEN 'r4'
     WHEN lang = 'de' THEN 'r5' WHEN slot = '7' THEN 'r6' WHEN contains(slot, '9') THEN 'r7' END"""
_RULE_DOCS = "(SELECT *, source || CASE WHEN doc_id % 9 = 0 THEN '@lists.example' ELSE '@mail.example' END AS sender, text AS subject, (doc_id % 100)::VARCHAR AS slot FROM documents)"


def _ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("source", F.when(F.col("doc_id") % 9 == 0, "@lists.example").otherwise("@mail.example")).alias("sender"), F.col("text").alias("subject"), (F.col("doc_id") % 100).cast("string").alias("slot"))
    return rules.routed(docs, [r if r.rule_id != "r3" else rules.Rule("r3", "subject_contains", "the ", r.reason) for r in _RULES], {"from_address": F.col("sender"), "subject": F.col("subject"), "labels": F.array("lang"), "x_slot": F.col("slot")})


@query(f"SELECT doc_id, rule AS ignore_rule_id FROM (SELECT doc_id, {_RULE_SQL.replace(chr(39) + 'the ' + chr(39), chr(39) + 'the' + chr(39))} AS rule FROM {_RULE_DOCS}) WHERE rule IS NOT NULL")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir)[1].select("doc_id", "ignore_rule_id")


@query(f"SELECT coalesce(rule, 'kept') AS verdict, count(*) AS n FROM (SELECT {_RULE_SQL.replace(chr(39) + 'the ' + chr(39), chr(39) + 'the' + chr(39))} AS rule FROM {_RULE_DOCS}) GROUP BY 1")
def ignore_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, ignored = _ruled(spark, sf_dir)
    every = kept.select(F.lit("kept").alias("verdict")).unionByName(ignored.select(F.col("ignore_rule_id").alias("verdict")))
    return every.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# ---- Header values ----------------------------------------------------------------------------------------------------


@query(r"""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'm' || doc_id WHEN 1 THEN '<m' || doc_id WHEN 2 THEN 'm' || doc_id WHEN 3 THEN 'm' || doc_id END AS message_id,
       CASE doc_id % 3 WHEN 0 THEN 'user' || doc_id || '@x.example' WHEN 1 THEN 'b@y.example' END AS email,
       CASE doc_id % 3 WHEN 0 THEN 'U ' || doc_id END AS name, CASE doc_id % 2 WHEN 0 THEN 'l.example' ELSE 'plain' END AS list_id,
       'a,' || lang AS labels
FROM documents
""")
def header_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    k = F.col("doc_id")
    mid = F.when(k % 5 == 0, F.concat(F.lit(" <m"), n, F.lit("> "))).when(k % 5 == 1, F.concat(F.lit("<m"), n)).when(k % 5 == 2, F.concat(F.lit("m"), n, F.lit(">"))).when(k % 5 == 3, F.concat(F.lit("m"), n)).otherwise("<>")
    addr = F.when(k % 3 == 0, F.concat(F.lit('"U '), n, F.lit('" <USER'), n, F.lit("@x.example>"))).when(k % 3 == 1, "B@Y.example").otherwise("nobody")
    a = H.address(addr)
    return table(spark, sf_dir, "documents").select(
        "doc_id", H.message_id(mid).alias("message_id"), a["email"].alias("email"), a["name"].alias("name"),
        H.list_id(F.when(k % 2 == 0, "List <l.example>").otherwise(" plain ")).alias("list_id"), F.array_join(H.comma_list(F.concat(F.lit(" a , ,"), "lang")), ",").alias("labels"),
    )


# ---- Text cleaning ----------------------------------------------------------------------------------------------------

_ENTITIES = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
_WS = r"[ \t\n\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _rstrip(sql: str) -> str:
    return f"regexp_replace({sql}, '{_WS}+$', '')"


def _strip(sql: str) -> str:
    return f"regexp_replace({_rstrip(sql)}, '^{_WS}+', '')"


def _normalized(sql: str) -> str:
    out = f"replace(replace({sql}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    out = rf"regexp_replace({out}, '[ \t\v\f\r\x{{a0}}]+(\n|$)', '\1', 'g')"
    out = rf"regexp_replace({out}, '(^|\n)>From ', '\1From ', 'g')"
    return _strip(rf"regexp_replace({out}, '\n{{4,}}', repeat(chr(10), 3), 'g')")


_MESSY_HTML = "(html || CASE page_id % 4 WHEN 0 THEN '<p>x &amp;lt; y > z</p><script>a</script' WHEN 1 THEN '<STYLE>b{c}</style>tail &quot;q&quot;<broken' WHEN 2 THEN '&nbsp;&#39;' ELSE '' END)"


@query("SELECT page_id, " + _normalized(_ENTITIES.format(r"replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _MESSY_HTML + r", '(?is)<script.*?(</script>|\z)', '', 'g'), '(?is)<style.*?(</style>|\z)', '', 'g'), '<[^>]*>', chr(10), 'g'), '<[^>]*\z', '', 'g'), '>', '')")) + " AS body FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    tail = F.when(k == 0, "<p>x &amp;lt; y > z</p><script>a</script").when(k == 1, "<STYLE>b{c}</style>tail &quot;q&quot;<broken").when(k == 2, "&nbsp;&#39;").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_text(F.concat("html", tail)).alias("body"))


def _messy(spark: SparkSession, sf_dir: str, **tails: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", *tails.values()).alias("body"))


@query(f"SELECT doc_id, {_normalized('(text || CASE doc_id % 3 WHEN 0 THEN chr(13) || chr(10) || chr(62) || ' + chr(39) + 'From me  ' + chr(39) + ' || repeat(chr(10), 6) || ' + chr(39) + 'end  ' + chr(39) + ' ELSE ' + chr(39) + chr(39) + ' END)')} AS body FROM documents")
def normalize_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _messy(spark, sf_dir, tail=F.when(F.col("doc_id") % 3 == 0, "\r\n>From me  \n\n\n\n\n\nend  ").otherwise(""))
    return docs.select("doc_id", X.normalize_body(F.col("body")).alias("body"))


@query(rf"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'Click to UNSUBSCRIBE' || chr(10) || 'in' || chr(8203) || 'visible' WHEN 1 THEN chr(10) || 'View this email in your browser' || repeat(chr(10), 7) || ' padded ' WHEN 2 THEN chr(10) || 'Trouble viewing?' ELSE '' END AS b FROM documents),
l AS (SELECT doc_id, string_split(regexp_replace(translate(b, chr(8204) || chr(8205) || chr(847) || chr(173) || chr(8203) || chr(65279), ''), '\n$', ''), chr(10)) AS ls FROM t),
k AS (SELECT doc_id, list_filter(ls, lambda x: NOT (contains(lower(x), 'unsubscribe')
        OR (contains(lower(x), 'browser') AND (contains(lower(x), 'view this email') OR contains(lower(x), 'view in browser') OR contains(lower(x), 'view this message')))
        OR (contains(lower(x), 'trouble') AND (contains(lower(x), 'viewing') OR contains(lower(x), 'displaying') OR contains(lower(x), 'reading'))))) AS ls FROM l)
SELECT doc_id, {_strip("regexp_replace(array_to_string(list_transform(ls, lambda x: " + _strip("x") + "), chr(10)), '" + chr(92) + "n{4,}', repeat(chr(10), 3), 'g')")} AS body FROM k
""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, "\nClick to UNSUBSCRIBE\nin​visible").when(k == 1, "\nView this email in your browser\n\n\n\n\n\n\n padded ").when(k == 2, "\nTrouble viewing?").otherwise("")
    return _messy(spark, sf_dir, tail=tail).select("doc_id", X.clean_text(F.col("body")).alias("body"))


def _first_cut(test: str, split: str = "string_split(b, chr(10))") -> str:
    """SQL for: lines before the first that passes test, right-trimmed; the body where none does."""
    return f"""
l AS (SELECT doc_id, b, {split} AS ls FROM t),
c AS (SELECT doc_id, b, ls, list_min(list_filter(range(1, len(ls) + 1), lambda i: {test})) AS pos FROM l),
o AS (SELECT doc_id, CASE WHEN pos IS NULL THEN b ELSE {_rstrip("array_to_string(ls[1 : pos - 1], chr(10))")} END AS body, b FROM c)"""


@query(rf"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || '-- ' || chr(10) || 'sig' WHEN 1 THEN chr(10) || 'Best regards, me' WHEN 2 THEN chr(10) || '____' || chr(10) || 'x' ELSE '' END AS b FROM documents),
{_first_cut("regexp_matches(" + _strip("ls[i]") + ", '^([_-]{3,}|--|—)$') OR ((i - 1) * 10 > len(ls) * 8 AND regexp_matches(lower(" + _strip("ls[i]") + "), '^(best regards|kind regards|warm regards|regards,|cheers,|thanks,|thank you,|sincerely,|sent from my (iphone|ipad|android))'))")}
SELECT doc_id, CASE WHEN {_strip("body")} = '' OR body = b THEN b ELSE {_strip("body")} END AS body FROM o
""")
def remove_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, "\n-- \nsig").when(k == 1, "\nBest regards, me").when(k == 2, "\n____\nx").otherwise("")
    docs = _messy(spark, sf_dir, tail=tail)
    cut = X.remove_signature(F.col("body"))
    return docs.select("doc_id", cut.alias("body"))


@query(rf"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN chr(10) || '> old' || chr(10) || ' > more' || chr(10) || 'On Mon, Ann wrote:' || chr(10) || '> hi' WHEN 1 THEN chr(10) || '-----original message-----' || chr(10) || 'x' WHEN 2 THEN chr(10) || 'From: a@b.example' WHEN 3 THEN chr(10) || '> only quoted' ELSE '' END AS b FROM documents),
{_first_cut("regexp_matches(" + _strip("ls[i]") + r", '(?i)^(On .{0,200} wrote:\s*$|-----Original Message-----$|----- Forwarded message -----$|Begin forwarded message:\s*$|From:\s+.+)')")},
k AS (SELECT doc_id, CASE WHEN pos IS NULL THEN ls ELSE ls[1 : pos - 1] END AS ls FROM c),
m AS (SELECT doc_id, ls, coalesce(list_max(list_filter(range(1, len(ls) + 1), lambda i: NOT regexp_matches(ls[i], '^{_WS}*>'))), 0) AS own FROM k)
SELECT doc_id, {_rstrip("array_to_string(ls[1 : own], chr(10))")} AS body FROM m
""")
def strip_reply_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, "\n> old\n > more\nOn Mon, Ann wrote:\n> hi").when(k == 1, "\n-----original message-----\nx").when(k == 2, "\nFrom: a@b.example").when(k == 3, "\n> only quoted").otherwise("")
    return _messy(spark, sf_dir, tail=tail).select("doc_id", X.strip_reply_chain(F.col("body")).alias("body"))


@query(rf"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN chr(10) || ' -- ' || chr(10) || 'sig' WHEN 1 THEN chr(10) || 'Sent from my phone' ELSE '' END AS b FROM documents),
{_first_cut("regexp_matches(" + _strip("ls[i]") + r", '^--\s*$|^__+$') OR starts_with(lower(" + _strip("ls[i]") + "), 'sent from my')")}
SELECT doc_id, body FROM o
""")
def strip_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    tail = F.when(k == 0, "\n -- \nsig").when(k == 1, "\nSent from my phone").otherwise("")
    return _messy(spark, sf_dir, tail=tail).select("doc_id", X.strip_signature(F.col("body")).alias("body"))


@query(rf"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN chr(10) || 'Privacy Policy' || chr(10) || 'one' || chr(10) || 'To UNSUBSCRIBE click' || chr(10) || 'two' ELSE '' END AS b FROM documents),
l AS (SELECT doc_id, b, string_split(b, chr(10)) AS ls FROM t),
c AS (SELECT doc_id, b, ls, list_max(list_filter(range(1, len(ls) + 1), lambda i: i > floor(len(ls)::DOUBLE * 0.66::DOUBLE) AND regexp_matches(lower(ls[i]), 'unsubscribe|manage preferences|privacy policy|confidential|privileged|intended recipient|this message may contain|do not distribute|do not share'))) AS pos FROM l)
SELECT doc_id, CASE WHEN pos IS NULL THEN b ELSE {_rstrip("array_to_string(ls[1 : pos - 1], chr(10))")} END AS body FROM c
""")
def strip_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 7 == 0, "\nPrivacy Policy\none\nTo UNSUBSCRIBE click\ntwo").otherwise("")
    return _messy(spark, sf_dir, tail=tail).select("doc_id", X.strip_footer(F.col("body")).alias("body"))


@query()
def clean_for_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 2 == 0, "\r\n\r\n\r\n\r\nmore\n--\nsig").otherwise("\nOn Tue, Bo wrote:\n> x")
    return _messy(spark, sf_dir, tail=tail).select("doc_id", X.clean_for_embedding(F.col("body")).alias("body"))


@query("SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END AS snippet FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE text END AS t FROM documents)")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(chunk, F.col("text")).alias("snippet"))


@query("SELECT doc_id || ':0' AS chunk_id, substr(text, 1, 5000) AS chunk_text, length(substr(text, 1, 10000)) AS body_chars FROM documents")
def record_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.left("text", F.lit(5000)).alias("chunk_text"), F.length(F.left("text", F.lit(10000))).cast("long").alias("body_chars"))


_CHUNK_WORDS = r"list_filter(regexp_split_to_array(text, '[\s\v]+'), lambda w: w <> '')"


@query(rf"""
WITH RECURSIVE w AS (SELECT doc_id, text, {_CHUNK_WORDS} AS w FROM documents),
l AS (SELECT doc_id, i, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w WHERE length(text) > 1200)),
p AS (SELECT doc_id, any_value(w) AS w, [0::HUGEINT] || list(e ORDER BY i) AS e FROM l JOIN w USING (doc_id) GROUP BY doc_id),
r AS (
  SELECT doc_id, 1 AS i, 1::BIGINT AS s, greatest(1, list_max(list_filter(range(1, least(len(w), 1201) + 1), lambda j: e[j + 1] - e[1] - 1 <= 1200))) AS t, w, e FROM p
  UNION ALL
  SELECT doc_id, i + 1, n, greatest(n, coalesce(list_max(list_filter(range(n, least(len(w), n + 1200) + 1), lambda j: e[j + 1] - e[n] - 1 <= 1200)), n)), w, e
  FROM (SELECT *, coalesce(list_max(list_filter(range(s + 1, t + 1), lambda b: e[t + 1] - e[b] >= 200)), t + 1) AS n FROM r WHERE t < len(w))
)
SELECT doc_id, i - 1 AS chunk_index, array_to_string(w[s : t], ' ') AS chunk_text FROM r
UNION ALL SELECT doc_id, 0, text FROM w WHERE length(text) <= 1200 AND len(w) > 0
""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exploded(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")


# ---- Raw mail ---------------------------------------------------------------------------------------------------------


def _raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a raw message of every document: an envelope, an encoded and a folded header, and a body of nested parts:
    the text in base64, the same as HTML for other readers, and an attachment; every fourth has HTML alone."""
    n, text = F.col("doc_id"), F.col("text")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), (n % 12 + 1).cast("int"))
    day, year = (n % 28 + 1).cast("string"), (F.lit(2000) + n % 25).cast("string")
    encoded = F.replace(F.base64(F.encode(text, "utf-8")), F.lit("\r\n"), F.lit(""))
    head = F.concat(
        F.lit("From src@mail.example Mon "), month, F.lit(" "), F.lpad(day, 2, " "), F.lit(" 08:10:00 "), year, F.lit("\nFrom: \"Name, "), F.col("lang"), F.lit("\" <"), F.upper("source"),
        F.lit("@Mail.example>\nTo: a@b.example, Bo <bo@B.example>\nDate: Mon, "), day, F.lit(" "), month, F.lit(" "), year, F.lit(" 08:10:00 +0100\nSubject: =?UTF-8?B?"), F.base64(F.encode(F.concat(F.lit("☃ "), n.cast("string")), "utf-8")),
        F.lit("?=\n part\nMESSAGE-ID: <m"), n.cast("string"), F.lit("@mail.example>\nReferences: <r1>\n\t<r2>\nReferences: <r"), n.cast("string"), F.lit("> <r0>\nno colon here\n"),
    )
    html = F.concat(F.lit("<p>Number "), n.cast("string"), F.lit(" &amp; more</p><script>x()</script>"))
    parts = F.concat(
        F.lit("Content-Type: multipart/mixed; boundary=\"mix\"\n\npreamble\n--mix\nContent-Type: multipart/alternative; boundary=alt\n\n--alt\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
        encoded, F.lit("\n--alt\nContent-Type: text/html\n\n"), html, F.lit("\n--alt--\n--mix\nContent-Type: application/pdf; name=\"f.pdf\"\nContent-Disposition: attachment; filename=\"f"), n.cast("string"),
        F.lit(".pdf\"\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(F.col("source"), "utf-8")), F.lit("\n--mix--\n"),
    )
    alone = F.concat(F.lit("Content-Type: text/html; charset=utf-8\n\n"), html, F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(head, F.when(n % 4 == 3, alone).otherwise(parts)), "utf-8").alias("raw"))


_MONTH_SQL = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"


@query(r"""
SELECT doc_id, 'Name, ' || lang AS from_name, lower(source) || '@mail.example' AS from_email, 'a@b.example,bo@b.example' AS recipients, '☃ ' || doc_id || ' part' AS subject,
       printf('%04d-%02d-%02dT08:10:00+01:00', 2000 + doc_id % 25, doc_id % 12 + 1, doc_id % 28 + 1) AS date, 'm' || doc_id || '@mail.example' AS message_id, 'r' || doc_id || ' r0' AS reference_ids
FROM documents
""")
def raw_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    rows = _raw_mail(spark, sf_dir).select("doc_id", H.headers_of("raw").alias("h"))
    sender = H.address(H.header(h, "from"))
    return rows.select(
        "doc_id", sender["name"].alias("from_name"), sender["email"].alias("from_email"), F.array_join(F.transform(H.address_list(H.header(h, "to")), lambda a: a["email"]), ",").alias("recipients"),
        H.header(h, "subject").alias("subject"), H.header(h, "date").alias("date"), H.message_id(H.header(h, "message-id")).alias("message_id"), F.array_join(H.reference_list(H.header(h, "references")), " ").alias("reference_ids"),
    )


@query(rf"""
SELECT doc_id, CASE WHEN doc_id % 4 <> 3 AND t <> '' THEN t END AS plain, CASE WHEN doc_id % 4 = 3 THEN '<p>Number ' || doc_id || ' &amp; more</p><script>x()</script>' || chr(10) WHEN t = '' THEN '<p>Number ' || doc_id || ' &amp; more</p><script>x()</script>' || chr(10) END AS html,
       CASE WHEN doc_id % 4 <> 3 THEN 'f' || doc_id || '.pdf application/pdf ' || strlen(source) ELSE '' END AS attachments
FROM (SELECT *, {_strip("text")} AS t FROM documents)
""")
def mime_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_mail(spark, sf_dir).select("doc_id", body_of("raw").alias("b"))
    files = F.transform("b.attachments", lambda f: F.concat_ws(" ", f["filename"], f["content_type"], f["size"].cast("string")))
    return rows.select("doc_id", F.col("b.plain").alias("plain"), F.col("b.html").alias("html"), F.array_join(files, ",").alias("attachments"))


@query(r"""
SELECT printf('%04d-%02d', 2000 + doc_id % 25, doc_id % 12 + 1) AS period, count(*) AS emails, count(DISTINCT doc_id) AS ids, min(doc_id) AS lowest, max(doc_id) AS highest
FROM documents GROUP BY 1
""")
def mbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailboxes of all documents' messages, written by many tasks, scanned in byte ranges that cut messages and lines."""
    folder = f"{scratch_folder(spark)}/mbox-{uuid.uuid4().hex}"
    _raw_mail(spark, sf_dir).select(F.concat(F.decode("raw", "utf-8"), F.lit("\n")).alias("value")).write.text(folder)
    rows = read_mbox(spark, f"{folder}/part-*", split_bytes=100_000).select("period", H.message_id(H.header(H.headers_of("raw"), "message-id")).alias("id"))
    number = F.regexp_extract("id", "^m([0-9]+)@", 1).cast("long")
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("emails"), F.count_distinct(number).alias("ids"), F.min(number).alias("lowest"), F.max(number).alias("highest"))


@query(rf"""
SELECT CASE WHEN doc_id % 4 = 3 OR t = '' THEN 'html' ELSE 'plain' END AS kind, count(*) AS n, count(*) FILTER (doc_id % 4 <> 3) AS with_file,
       count(DISTINCT printf('%04d-%02d', 2000 + doc_id % 25, doc_id % 12 + 1)) AS months
FROM (SELECT doc_id, {_strip("text")} AS t FROM documents) GROUP BY 1
""")
def preprocess_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole step from raw messages to clean records, counted by what their bodies came from."""
    place = _raw_mail(spark, sf_dir).select("raw", F.lit("m").alias("mbox_file"), F.col("doc_id").alias("offset"), F.lit(1).cast("long").alias("length"))
    clean = preprocess(place, keep=False).clean
    kind = F.when(F.col("content")[0]["body"].startswith("Number "), "html").otherwise("plain")
    return clean.select(kind.alias("kind"), F.size(F.coalesce("attachments", F.array())).alias("files"), F.substring("headers.date", 1, 7).alias("month")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("files") > 0).alias("with_file"), F.count_distinct("month").alias("months"))


# ---- Validation and questions -----------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line for each document; every rule of the validator is broken by some."""
    made = F.array(*[F.lit(x) for x in _FAULTS])
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(made, (F.col("doc_id") % len(_FAULTS) + 1).cast("int")).alias("line"))


_GOOD = '"content":[{"type":"text","body":"hi"}]'
_FAULT_CODES: dict[str, tuple[str, ...]] = {
    '{"headers":{"from":{"email":"a@b.c"},"date":"2024-01-02T03:04:05-05:00"},' + _GOOD + "}": (),
    "{bad json}": ("json",),
    "[1]": ("record.type",),
    "{" + _GOOD + "}": ("headers.type",),
    '{"headers":{}}': ("content.type", "content.empty"),
    '{"headers":{},"content":[],"attachments":[{"filename":"f","size":3}]}': (),
    '{"headers":{},"tags":"x",' + _GOOD + "}": ("tags.type",),
    '{"headers":{},"tags":["a"," ",3],' + _GOOD + "}": ("tags.value", "tags.value"),
    '{"headers":{"from":{"name":"n"}},' + _GOOD + "}": ("headers.from.email",),
    '{"headers":{"to":"x","cc":[{"name":"n"},{"email":"c@d.e"}]},' + _GOOD + "}": ("headers.to.type", "headers.cc.email"),
    '{"headers":{"date":"yesterday"},' + _GOOD + "}": ("headers.date",),
    '{"headers":{"date":"Mon, 1 Jan 2024 01:02:03 +0000","references":["a",""]},' + _GOOD + "}": ("headers.references.value",),
    '{"headers":{"references":" "},' + _GOOD + "}": ("headers.references.value",),
    '{"headers":{"references":5},' + _GOOD + "}": ("headers.references.type",),
    '{"headers":{},"attachments":{"a":1},' + _GOOD + "}": ("attachments.type",),
    '{"headers":{},"attachments":[7,{"size":"big"}],' + _GOOD + "}": ("attachments.value", "attachments.size"),
    '{"headers":{},"content":[{"type":"text","body":" "},{"type":"image"}]}': ("content.body", "content.text"),
}
_FAULTS = tuple(_FAULT_CODES)
_FAULT_ROWS = ", ".join(f"({i}, '{c}')" for i, codes in enumerate(_FAULT_CODES.values()) for c in codes if c != "json")


@query(f"SELECT code, count(*) AS n FROM documents JOIN (VALUES {_FAULT_ROWS}) v(i, code) ON doc_id % {len(_FAULTS)} = i GROUP BY 1")
def validation_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(_records(spark, sf_dir)).select(F.explode("issues.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_GOOD_ONES = ", ".join(str(i) for i, codes in enumerate(_FAULT_CODES.values()) if not codes)


@query(f"SELECT count(*) AS total, count(*) FILTER (doc_id % {len(_FAULTS)} IN ({_GOOD_ONES})) AS valid, count(*) FILTER (doc_id % {len(_FAULTS)} NOT IN ({_GOOD_ONES})) AS errors FROM documents")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(validated(_records(spark, sf_dir)))


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


@query(rf"""
SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains([{_STOP_SQL}], w) AND NOT regexp_matches(w, '^\p{{Nd}}+$')), ' ') AS keywords
FROM benchmark
""")
def tokens_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(keyword_array(F.col("text")), " ").alias("keywords"))
