"""Every registered mail query against its SQL on the small tables."""

import pytest
from pyspark.sql import functions as F

from letterloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, same_rows):
    same_rows(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name, added", [
    ("remove_signature", "\n-- \nsig"), ("strip_reply_chain", "On Mon, Ann wrote:"), ("strip_signature", "Sent from my phone"),
    ("strip_footer", "To UNSUBSCRIBE click"), ("clean_text", "Click to UNSUBSCRIBE"), ("normalize_body", "\r\n>From me"),
])
def test_added_parts_go(name, added, spark, sf_dir):
    """The cleaners' queries add parts to the texts that must be gone; else they would pass for nothing."""
    assert catalog.QUERIES[name](spark, sf_dir).where(F.col("body").contains(added)).count() == 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def slow_chunks(text, size=1200, overlap=200):
    """Every end and every start tried, lengths taken from the joined words."""
    if len(text) <= size:
        return [text] if text.strip() else []
    words, out, start = text.split(), [], 0
    while True:
        end = start + 1
        while end < len(words) and len(" ".join(words[start : end + 1])) <= size:
            end += 1
        out.append(" ".join(words[start:end]))
        if end >= len(words):
            return out
        start = next((b for b in range(end - 1, start, -1) if len(" ".join(words[b:end])) + 1 >= overlap), end)


def test_chunks_of_long_texts(spark, tmp_path):
    texts = [" ".join(f"w{i * i % 977}" for i in range(n)) for n in (3, 400, 1500, 1501, 4000)] + ["", "x" * 3000 + " y" * 1600]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.chunk_index): r.chunk_text for r in catalog.QUERIES["chunk_text"](spark, str(tmp_path)).collect()}
    assert found == {(i, n): c for i, t in rows for n, c in enumerate(slow_chunks(t))}


@pytest.mark.parametrize("name", ["precision_at_5", "reciprocal_rank"])
def test_every_stated_query_counts(name, spark):
    ids = {r.vec_id for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert {r.query for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.01").collect()} == ids and len(ids) > 10


def test_signatures_of_odd_texts_equal_sql(spark, tmp_path):
    """Texts without a signature keep the blanks at their ends, and an empty last line counts among the lines."""
    import duckdb

    ends = ["", "\n", "\n\n", " \n", "\r\n", " "]
    tops = ["one\ntwo", "  one\n\ntwo", "\n\none", "\t\n", "a\nb\nc\nd\nBest regards", "a\nb\nc\nd\ne\nthanKs,", "a\nb\nc\nd\ne\nSİncerely, x", "a\nb\nc\nd\ne\nCheers, f\ng", "x\n -- ", "---\nx"]
    texts = [a + b for a in tops for b in ends for _ in range(4)]  # each with every tail that the query adds
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = {(r.doc_id, r.body) for r in catalog.QUERIES["remove_signature"](spark, str(tmp_path)).collect()}
    assert found == set(con.sql(catalog.ORACLES["remove_signature"]).fetchall())
    assert (3, "one\ntwo") in found and (7, "one\ntwo\n") in found


def test_cleaning_of_odd_texts_equals_sql(spark, tmp_path):
    """Blanks of every kind before other kinds of line breaks, and letters whose lower case is ASCII."""
    import duckdb

    texts = [f"{a}one{b}\n{b}{c}{a}two{a}{b}" for a in ("", " ", "\t ", "\x85", "\u2028", "\xa0") for b in ("", "  ", "\x1f", "\u3000 ", "\r") for c in ("", "\n\n\n", "UNSUBSCR\u0130BE\n", "Trouble reading\n", "bro\u200bwser, view this email", ">From ")]
    texts = [t for t in texts for _ in range(12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("clean_text", "normalize_body", "remove_signature"):
        assert {(r.doc_id, r.body) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == set(con.sql(catalog.ORACLES[name]).fetchall())


def test_long_runs_of_blanks_take_linear_time(spark, tmp_path):
    """A run of blanks inside a line is looked at once, not once for each of its blanks."""
    import time

    spark.createDataFrame([(0, "a" + " " * 400_000 + "b\nc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("clean_text", "normalize_body"):
        began = time.perf_counter()
        assert len(catalog.QUERIES[name](spark, str(tmp_path)).first().body) > 400_000
        assert time.perf_counter() - began < 20


def test_nearest_so_far_equals_every_distance():
    """Blocks added one by one keep the same k rows as all distances measured: ties by id, copies, far-off and lone values."""
    import numpy as np

    from letterloom.operators.metrics import _Nearest

    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(300, 8)), 3, axis=0).astype(np.float32).astype(np.float64)
    v[::7] += 1e6
    v[50:60] = np.round(v[50:60])
    ids, labels = rng.permutation(900), rng.integers(0, 3, 900)
    q = np.arange(0, 900, 20)
    near = _Nearest(ids[q], v[q], labels[q], 10)
    for at in np.split(np.arange(900), [5, 16, 300, 301, 700]):
        near.add(ids[at], v[at], labels[at])
    rows = near.rows().to_pylist()
    assert len(rows) == 10 * len(q)
    for i, one in enumerate(q):
        d = np.square(v - v[one]).sum(axis=1)
        first = [j for j in np.lexsort((ids, d)) if j != one][:10]
        assert [(r["vec_id"], r["distance"], r["relevant"]) for r in rows[10 * i : 10 * i + 10]] == [(ids[j], d[j], labels[j] == labels[one]) for j in first]
