"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

One pass over the text finds every base match: splitting a text at a pattern gives the lengths between matches. Their
running sum over the exploded matches of a text, a window, gives the places in time linear in the matches. The values are
hashed and counted by distinct repositories and owners over the corpus, in stages with partial sums, so a value that a
third of all rows carry is combined before each shuffle; matches and counts are both written before they are joined, so
that adaptive execution can split such a value's matches. A value of few owners is live-looking and gains a span of its
own kind; a value that many owners carry is a copied example and gains none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterloom.llm.common import table, written

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run of hex digits or an access key is matched whole, so asking for its length in the pattern finds the same places.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
#: Live-looking: at most so many distinct owners and so many distinct repositories carry the value.
MAX_OWNERS = 2
MAX_REPOSITORIES = 8
KINDS = ("assign", "access", "hex", "live")


_PARTS = "array<struct<kind:int,gap:int,n:int,value:string>>"


def _parts(text: Column, pattern: str, kind: int, value_group: int) -> Column:
    """Of a pattern's leftmost non-overlapping matches, in order: the code points since the match before, those of the
    match itself, and its value."""
    gaps = F.transform(F.split(text, pattern), lambda g: F.length(g))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("n"), value.alias("value"))
    matched = F.filter(zipped, lambda p: p["n"].isNotNull())  # the gap after the last match has none
    parts = F.transform(matched, lambda p: F.struct(F.lit(kind).alias("kind"), p["gap"].alias("gap"), p["n"].alias("n"), p["value"].alias("value")))
    return F.when(text.rlike(pattern), parts).otherwise(F.array().cast(_PARTS))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, owner, repository, parts (the matches of each kind in order)."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repository_col).cast("string").alias("repository"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    return read.select("doc_id", "owner", "repository", F.concat(_parts(text, ASSIGN, 0, 2), _parts(text, ACCESS, 1, 0), _parts(text, HEX, 2, 0)).alias("parts"))


def placed(found: DataFrame) -> DataFrame:
    """One row per base match of candidates() with _row: _row, owner, repository, start, kind, end, value, value_key."""
    each = found.select("_row", "owner", "repository", F.posexplode("parts").alias("at", "p")).select("_row", "owner", "repository", "at", "p.*")
    so_far = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    each = each.withColumn("end", so_far).where((F.col("kind") > 0) | (F.length("value") >= MIN_ASSIGNED))
    return each.select("_row", "owner", "repository", (F.col("end") - F.col("n")).alias("start"), "kind", "end", "value", F.xxhash64("value").alias("value_key"))


def ownership(matches: DataFrame) -> DataFrame:
    """(value_key, owners, repositories, times) over all candidate values of the corpus."""
    one = matches.select("value_key", F.coalesce("owner", F.lit("")).alias("owner"), F.xxhash64("owner", F.lit("/"), "repository").alias("repository"))
    by_repository = one.groupBy("value_key", "owner", "repository").agg(F.count(F.lit(1)).alias("times"))
    by_owner = by_repository.groupBy("value_key", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("times").alias("times"))
    return by_owner.groupBy("value_key").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("times").alias("times"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per input row: doc_id, spans (array of struct start, kind, end, value, owners, repositories).

    Every base match is a span of kind 0 to 2. A match whose value at most max_owners owners and max_repositories
    repositories carry gains a second span of kind 3 over the same place. Nulls: a null text is empty; a null owner is
    one owner of its own; rows without an id keep their row. Repeated rows are one repository. An empty table gives no
    rows, and other columns are ignored.
    """
    found = candidates(docs, id_col, text_col, owner_col, repository_col).withColumn("_row", F.monotonically_increasing_id())
    found, _ = written(found)  # the row numbers are fixed from here on, and the text isn't read again
    matches, _ = written(placed(found.where(F.size("parts") > 0)))
    owned, _ = written(ownership(matches))
    judged = matches.join(owned, "value_key")
    of_row = judged.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end", "value", "owners", "repositories")).alias("base"))

    def extra(base: Column) -> Column:
        live = F.filter(base, lambda s: (s["owners"] <= max_owners) & (s["repositories"] <= max_repositories))
        return F.transform(live, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), s["owners"].alias("owners"), s["repositories"].alias("repositories")))

    of_row = of_row.select("_row", F.array_sort(F.concat("base", extra(F.col("base")))).alias("spans"))
    empty = F.array().cast(dict(of_row.dtypes)["spans"])
    return found.select("_row", "doc_id").join(of_row, "_row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)

    def n(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"),
    )


_FOUND_SQL = r"""
found AS (
  SELECT rid, doc_id, source, kind, name, val,
         (SELECT coalesce(sum(length(gaps[j]) + length(coalesce(ms[j - 1], ''))), 0) FROM range(1, i + 1) r(j))::BIGINT AS st,
         length(m) AS n
  FROM (
    SELECT rid, doc_id, source, kind, name, ms, string_split_regex(text, pat) AS gaps,
           unnest(ms) AS m, unnest(vs) AS val, generate_subscripts(ms, 1) AS i
    FROM (
      SELECT d.*, p.*, regexp_extract_all(text, pat, 0) AS ms, regexp_extract_all(text, pat, grp) AS vs
      FROM docs d, pats p WHERE regexp_matches(text, pat)
    )
  )
  WHERE length(val) >= least_n
)"""

OP9_SQL = (
    r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), pats AS (
  SELECT * FROM (VALUES
    (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
    (2, 'hex', '[0-9a-f]{24,}', 0, 24)) t(kind, name, pat, grp, least_n)
), """
    + _FOUND_SQL.replace("SELECT rid, doc_id, source, kind, name, ms, string_split_regex", "SELECT rid, doc_id, source, kind, name, least_n, ms, string_split_regex")
    + r""", owned AS (
  SELECT val, count(DISTINCT source) AS owners, count(DISTINCT (source, doc_id)) AS repositories FROM found GROUP BY val
), spans AS (
  SELECT rid, kind, name, st, st + n AS en FROM found
  UNION
  SELECT rid, 3, 'live', st, st + n FROM found JOIN owned USING (val) WHERE owners <= 2 AND repositories <= 8
), agg AS (
  SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
         string_agg(name || ':' || st || ':' || en, ',' ORDER BY st, kind, en) FILTER (kind < 3) AS base,
         string_agg(name || ':' || st || ':' || en, ',' ORDER BY st, kind, en) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN agg USING (rid)
"""
)
