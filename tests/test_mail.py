"""MBOX scanning, header and body parsing, and the way from mailbox to search."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from letterloom import api
from letterloom.__main__ import main, run_pipeline
from letterloom.functions import headers as H
from letterloom.functions import mime
from letterloom.functions.chunks import chunk_text
from letterloom.functions.embed import HashingProvider
from letterloom.plans import stages
from letterloom.plans.engine import Engine
from letterloom.plans.prompts import ChatBackend, StubBackend, context
from letterloom.plans.query import heuristic_plan, json_object, merged_plan, parse, plan_query
from letterloom.plans.store import Store
from letterloom.plans.workspace import Workspace
from letterloom.serve import route
from letterloom.settings import Settings
from letterloom.operators.stats import summary_text
from letterloom.operators.validate import checked_summary
from letterloom.sources.mail import clean_names, count_mail, head_lines, observed, raw_messages, read_mail
from letterloom.sources.mailjson import read_clean
from letterloom.sources.mbox import envelope, read_mbox, read_message

ENCODED = """From dora@example.com Mon Jan  3 08:10:00 +0000 2003
Message-ID: <m1@example.com>
From: Dora <Dora@Example.com>
To: Team <team@example.com>, "Bo, B" <bo@example.com>
Date: Mon, 3 Jan 2003 08:10:00 +0000
Subject: =?ISO-8859-1?Q?Gar=E7on_seul?=
X-Gmail-Labels: Inbox,Work

Three beds are free.
From this is not a boundary
-- 
Dora

"""
HTML = """From emil@example.com Tue Jun 12 13:45:00 2012
Message-ID: <m2@example.com>
From: emil@example.com
In-Reply-To: <m1@example.com>
Date: Tue, 12 Jun 2012 23:45:00 -0500
Subject: Re: Soil
 status
Content-Type: text/html; charset=utf-8

<html><body><h1>Compost</h1><p>Peat &amp; sand</p><script>x()</script></body></html>

"""
MULTI = """From fay@example.com Fri Apr 19 17:25:00 UTC 2024
From: Fay <fay@example.com>
Date: Fri, 19 Apr 2024 17:25:00 +0000
Subject: Harvest ledger
Content-Type: multipart/mixed; boundary="mix"

--mix
Content-Type: multipart/alternative; boundary=alt

--alt
Content-Type: text/plain

Ledger attached.
--alt
Content-Type: text/html

<b>Ledger</b>
--alt--
--mix
Content-Type: application/pdf; name="beds.pdf"
Content-Disposition: attachment; filename="beds.pdf"
Content-Transfer-Encoding: base64

SGVsbG8=
--mix--

"""
SPAM = """From promo@example.com Wed Nov  2 10:00:00 +0000 2022
Message-ID: <m4@example.com>
From: Promo <promo@example.com>
Date: Wed, 2 Nov 2022 10:00:00 +0000
Subject: Sale
X-Mailer: Sailthru 9

Save now.
"""


@pytest.fixture(scope="module")
def mailbox(tmp_path_factory):
    path = tmp_path_factory.mktemp("box") / "mail.mbox"
    path.write_text("noise before\n" + ENCODED + HTML + MULTI + SPAM)
    return str(path)


@pytest.mark.parametrize("line, ok", [
    (b"From a@b Mon Jan  1 00:00:00 2024", True), (b"From a@b Mon Jan  1 00:00:00 +0000 2024", True), (b"From a@b Tue Feb 10 12:59:59 UTC 2024", True),
    (b"From missing fields", False), (b"From a@b Mon Jan 40 00:00:00 2024", False), (b"From a@b Mon Jan  1 99:00:00 2024", False),
    (b"From this is not a boundary", False), (b">From a@b Mon Jan  1 00:00:00 2024", False), (b"From a@b mon Jan  1 00:00:00 2024", False), (b"From \xff Mon Jan  1 00:00:00 2024", False),
])
def test_envelope(line, ok):
    assert (envelope(line) is not None) == ok


def test_ranges_see_each_message_once(spark, mailbox):
    whole = [tuple(r) for r in read_mbox(spark, mailbox).orderBy("offset").select("offset", "length", "period").collect()]
    assert [p for _, _, p in whole] == ["2003-01", "2012-06", "2024-04", "2022-11"]
    for split in (1, 7, 100, 333):
        assert [tuple(r) for r in read_mbox(spark, mailbox, split_bytes=max(split, 40)).orderBy("offset").select("offset", "length", "period").collect()] == whole
    assert read_mbox(spark, mailbox, start_offset=whole[0][0] + 5).count() == 3
    offset, length, _ = whole[1]
    assert read_message("", mailbox, offset, length).startswith(b"From emil@")
    with pytest.raises(Exception, match="beyond"):
        read_mbox(spark, mailbox, start_offset=10**6).count()


def test_preprocess(spark, mailbox):
    made = stages.preprocess(read_mbox(spark, mailbox))
    clean = {r["headers"]["subject"]: r for r in made.clean.collect()}
    first = clean["Garçon seul"]
    assert first["headers"]["date"] == "2003-01-03T08:10:00+00:00"
    assert first["content"][0]["body"] == "Three beds are free.\nFrom this is not a boundary"
    assert first["headers"]["from"].asDict() == {"name": "Dora", "email": "dora@example.com"}
    assert first["tags"] == ["Inbox", "Work"]
    assert clean["Re: Soil status"]["content"][0]["body"] == "Compost\n\nPeat & sand"
    report = clean["Harvest ledger"]
    assert report["content"][0]["body"] == "Ledger attached."
    assert report["attachments"][0].asDict() == {"filename": "beds.pdf", "content_type": "application/pdf", "size": 5}
    assert [tuple(r) for r in made.spam.select("subject", "reason").collect()] == [("Sale", "mailer:sailthru")]
    assert stages.find(made.index, message_id="<M1@example.com>".strip("<>")).count() == 1
    with pytest.raises(ValueError):
        stages.find(made.index)


def test_mail_inputs(spark, mailbox, tmp_path):
    made = stages.preprocess(read_mbox(spark, mailbox))
    assert read_mail(spark, mailbox).count() == 4 == count_mail(spark, mailbox)
    raw = raw_messages(spark, mailbox, made.index.where("message_id = 'm2@example.com'")).collect()
    assert len(raw) == 1 and raw[0]["raw"].startswith(b"From emil@")
    path = tmp_path / "x.jsonl"
    path.write_text('{"headers": {"subject": "s"}, "content": []}\n\n{bad json}\n')
    records, errors = read_clean(spark, str(path))
    assert records.count() == 1 and [r["kind"] for r in errors.collect()] == ["json_decode"] and count_mail(spark, str(path)) == 2
    rows, seen = observed(read_mail(spark, mailbox), "seen")
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 4} and head_lines(spark, mailbox, 2).count() == 2
    assert clean_names("a/b.mbox", "o")["spam"] == "o/b.spam.jsonl"
    lines = spark.read.text(str(path)).withColumnRenamed("value", "line").where("line <> ''")
    assert checked_summary(lines) == {"total": 2, "valid": 0, "errors": 2}
    with pytest.raises(ValueError):
        checked_summary(lines, strict=True)


def test_summary_text():
    text = summary_text("box", 4, {"b": 1, "a": 2}, 0, 1000, 250, 10)
    assert "reduction: 75.0%" in text and text.index("  a: 2") < text.index("  b: 1")


def test_header_quirks():
    assert H.decode_words("=?UTF-8?B?SGVsbG8g4piD?=") == "Hello ☃"
    assert H.decode_words("=?bad") == "=?bad"
    assert H.header_map(b"From x\nA: 1\n  more\nno colon\n last\nA: 2\n\nB: 3") == {"a": "2"}
    assert H.decode_base64("SGVs*bG8=") == b"Hello" and H.decode_base64("SGVsbG8") == b"Hel"
    assert H.normal_date("Mon, 1 Jan 2024 01:02:03 +0000") == "2024-01-01T01:02:03+00:00" and H.normal_date("soon") == "soon"
    assert mime.decoded(b"a=\nb=3D", "quoted-printable") == b"ab="


def test_message_ids_and_addresses(spark):
    rows = spark.createDataFrame([("<a@b>",), ("a>",), ("<a",), ("<>",), (None,)], "v string").select(H.message_id(F.col("v")).alias("m")).collect()
    assert [r["m"] for r in rows] == ["a@b", "a", "<a", None, None]
    one = spark.createDataFrame([('"A, B" <x@Y.z>, q@r, none',)], "v string").select(H.address_list(F.col("v")).alias("a")).first()["a"]
    assert [a["email"] for a in one] == ["x@y.z", "q@r"]


words = st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=400)


@settings(max_examples=150, deadline=None)
@given(words, st.integers(5, 60), st.integers(0, 30))
def test_chunks_hold_every_word(text, size, overlap):
    made = chunk_text(text, size, overlap)
    assert all(len(c) <= size or " " not in c for c in made) or len(text) <= size
    have = [w for c in made for w in c.split()]
    want = text.split()
    at = 0
    for w in have:
        if at < len(want) and w == want[at]:
            at += 1
    assert set(have) == set(want)


def test_chunk_example():
    made = chunk_text(" ".join(["word"] * 400), 200, 50)
    assert len(made) == 13 and {len(c) for c in made} == {199}


def test_pipeline_to_search(spark, mailbox, tmp_path, capsys):
    workspace, settings_ = Workspace(str(tmp_path / "w")), Settings(embedding_dimension=32)
    run_pipeline(spark, [mailbox], workspace, settings_)
    assert {s["status"] for s in workspace.state["stages"].values()} == {"done"}
    store = Store(spark, workspace.path("db"))
    engine = Engine(store, HashingProvider(32))
    assert api.statistics(engine)["emails"] == 3
    found = api.search(engine, "harvest ledger", 5)
    assert found["results"][0]["subject"] == "Harvest ledger"
    assert api.search(engine, "how many emails in 2024")["results"] == [{"n": 1}]
    assert api.search(engine, "who did I email most in 2003")["results"] == [{"from_address": "dora@example.com", "n": 1}]
    # the sender's own clock counts: late on 12 June in its zone
    row = store.read("emails").where("subject = 'Re: Soil status'").first()
    assert str(row["date"]) == "2012-06-12 23:45:00" and row["year"] == 2012
    ident = found["results"][0]["email_id"]
    assert api.email(engine, ident)["subject"] == "Harvest ledger" and api.email(engine, "x") is None
    near = api.similar(engine, ident, 2)
    assert len(near) == 2 and ident not in {r["email_id"] for r in near}
    # again: nothing is stored twice
    rows = store.read("emails")
    store.append(rows.limit(1), "emails")
    assert store.dedupe("emails", "email_id", dry_run=True) == 1 and store.read("emails").count() == 4
    assert store.dedupe("emails", "email_id") == 1 and store.read("emails").count() == 3
    assert route(engine, "GET", "/health")[1]["status"] == "ok" and route(engine, "GET", f"/emails/{ident}/similar?limit=1")[0] == 200
    assert route(engine, "POST", "/search", {"query": "how many emails in 2024"})[1]["count"] == 1
    assert [route(engine, "GET", p)[0] for p in ("/search", "/emails/none", "/nope")] == [422, 404, 404]
    backend = StubBackend(['{"filters": {"year": 2024, "drop": 1}}', "It is [1]."])
    answer = Engine(store, HashingProvider(32), backend).answer("ledger", 5)
    assert answer.answer == "It is [1]." and answer.plan.filters == {"year": 2024} and "Harvest ledger" in backend.prompts[-1]
    assert main(["workspace-info", workspace.root]) == 0 and "done" in capsys.readouterr().out
    assert workspace.refresh(["ingest"]) and not workspace.done("ingest")


def test_store_upsert(spark, tmp_path):
    store = Store(spark, str(tmp_path / "u"))
    store.create(spark.createDataFrame([("a", [1.0], 1), ("b", [2.0], 1)], "email_id string, subject_vector array<float>, chunk_count int"), "email_vectors")
    store.upsert(spark.createDataFrame([("b", [3.0], 2), ("c", [4.0], 1)], "email_id string, subject_vector array<float>, chunk_count int"), "email_vectors", ["email_id"])
    assert {r["email_id"]: r["subject_vector"] for r in store.read("email_vectors").collect()} == {"a": [1.0], "b": [3.0], "c": [4.0]}
    store.compact("email_vectors")
    assert store.read("email_vectors").count() == 3 and store.names() == ["email_vectors"]
    store.drop("email_vectors")
    assert store.names() == [] and store.read("email_vectors").count() == 0


def test_repair_and_refusal(spark, mailbox, tmp_path):
    """Mail whose stored vectors are missing or belong to other chunks is embedded anew, or refused."""
    clean = stages.preprocess(read_mbox(spark, mailbox)).clean
    store, by = Store(spark, str(tmp_path / "r")), HashingProvider(16)
    with pytest.raises(ValueError, match="without stored vectors"):
        stages.ingest(store, clean, by, repair=False)
    vectors, chunks = stages.vectorize(stages.to_emails(clean), by)
    store.create(vectors.withColumn("subject_vector", F.array_repeat(F.lit(0.5), 16)), "email_vectors")
    store.create(chunks, "chunk_vectors")
    assert stages.ingest(store, clean, by, repair=False) == 3
    assert {tuple(r[0]) for r in store.read("emails").select("subject_vector").collect()} == {(0.5,) * 16}
    assert stages.ingest(store, clean, by) == 0 and store.read("emails").count() == 3
    assert store.read("email_chunks").where("body_vector is null or size(body_vector) <> 16").count() == 0


def test_record_forms(spark, tmp_path):
    """Senders, recipients, references and places in every form that records come in."""
    rows = [
        {"headers": {"from": "Ann <A@b.c>", "to": ["x@y.z", {"name": "Q", "email": "Q@r.s"}], "cc": "Bo <b@o.o>", "references": "<r1> <r2>", "date": "Mon, 1 Jan 2024 01:02 EST", "subject": "s"}, "content": [{"type": "text", "body": "hi"}], "mbox_file": "f", "mbox_offset": 5, "mbox_length": 7},
        {"headers": {"from": {"name": "N", "email": "N@M.o"}, "to": [], "references": ["r9"], "date": "2024-01-02T03:04:05Z"}, "content": [{"type": "text", "body": "yo"}], "mbox": {"file": "g", "offset": 1, "length": 2}},
    ]
    path = tmp_path / "x.clean.jsonl"
    path.write_text("\n\n" + "\n".join(map(json.dumps, rows)) + "\n{bad\n")
    records, errors = read_clean(spark, str(path))
    one, two = stages.to_emails(records).orderBy("mbox_file").collect()
    assert (one["from_address"], one["from_name"], one["to_addresses_str"], one["cc_addresses_str"]) == ("a@b.c", "Ann", "x@y.z,q@r.s", "b@o.o")
    assert (one["mbox_file"], one["mbox_offset"], one["mbox_length"], str(one["date"])) == ("f", 5, 7, "2024-01-01 01:02:00")
    assert (two["from_address"], two["from_name"], two["mbox_file"], two["mbox_offset"]) == ("n@m.o", "N", "g", 1)
    assert [r["headers"]["references"] for r in records.orderBy("mbox.file").collect()] == [["<r1>", "<r2>"], ["r9"]]
    assert [(r["number"], r["error"], r["raw"]) for r in errors.collect()] == [(5, "line 5 is no JSON", "{bad")]
    good, bad = stages.good_records(spark.read.text(str(path)).withColumnRenamed("value", "line").where("line <> ''"))
    assert good.count() == 1 and bad.count() == 2 and one["email_id"] != two["email_id"]  # the validator asks for lists
    rows[0]["headers"].pop("cc")
    assert _records(spark, *map(json.dumps, rows)).count() == 2


@pytest.mark.parametrize("date, iso", [
    ("Mon, 1 Jan 2024 01:02:03 +0530", "2024-01-01T01:02:03+05:30"), ("1 Jan 2024 01:02 GMT", "2024-01-01T01:02:00+00:00"), ("Mon, 1 Jan 2024 01:02:03 PDT", "2024-01-01T01:02:03-07:00"),
    ("Mon, 1 Jan 2024 01:02:03 -0000", "2024-01-01T01:02:03"), ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00"), ("soon", None),
])
def test_dates_as_iso(spark, date, iso):
    from letterloom.sources.mailjson import iso_text

    assert spark.createDataFrame([(date,)], "d string").select(iso_text(F.col("d")).alias("i")).first()["i"] == iso


def _mail(ident, body):
    return json.dumps({"headers": {"from": "a@b.c", "message_id": ident, "subject": "s", "date": "2024-01-02T03:04:05Z"}, "content": [{"type": "text", "body": body}]})


def _records(spark, *lines):
    return stages.good_records(spark.createDataFrame([(x,) for x in lines], "line string"))[0]


def test_whole_bodies_are_chunked(spark, tmp_path):
    """A word beyond the part of a body that is stored is in a chunk."""
    store, by = Store(spark, str(tmp_path / "long")), HashingProvider(16)
    assert stages.ingest(store, _records(spark, _mail("m", "plain words " * 3000 + "needle at the end")), by) == 1
    assert len(store.read("emails").first()["body_plain"]) == stages.BODY_CHARS
    assert store.read("email_chunks").where(F.col("chunk_text").contains("needle")).count() == 1


def test_ingest_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    """A stop after the chunks are stored: the next run adds the mail and no chunk twice; row limits take the first mails."""
    store, by = Store(spark, str(tmp_path / "stop")), HashingProvider(16)
    records = _records(spark, _mail("m1", "one " * 900), _mail("m2", "two"))
    append = store.append

    def failing(rows, name):
        if name == "emails":
            raise RuntimeError("stop")
        append(rows, name)

    monkeypatch.setattr(store, "append", failing)
    with pytest.raises(RuntimeError):
        stages.ingest(store, records, by)
    held = store.read("email_chunks").count()
    monkeypatch.setattr(store, "append", append)
    assert held > 2 and not store.exists("emails")
    assert stages.ingest(store, records, by, limit=1) == 1 and stages.ingest(store, records, by) == 1
    assert store.read("email_chunks").count() == held and store.read("emails").count() == 2
    assert stages.vectorize(stages.to_emails(records), by, limit=1)[0].count() == 1


def test_replace_survives_a_stop(spark, tmp_path):
    store = Store(spark, str(tmp_path / "rep"))
    store.create(spark.createDataFrame([("a", [1.0], 1)], "email_id string, subject_vector array<float>, chunk_count int"), "email_vectors")
    (tmp_path / "rep" / "email_vectors").rename(tmp_path / "rep" / "_email_vectors_old")
    assert store.read("email_vectors").count() == 1
    store.ensure_meta({"embedding_dimension": 2})
    with pytest.raises(ValueError, match="isn't 2 long"):
        store.upsert(store.read("email_vectors"), "email_vectors", ["email_id"])


def test_lookup_prefers_the_exact_id(spark):
    index = spark.createDataFrame([("e1", "a@b", "a@b", "m", 0, 1), ("e2", "A@B", "a@b", "m", 1, 1)], "email_id string, message_id string, message_id_lower string, mbox_file string, offset long, length long")
    assert stages.find(index, message_id="A@B").first()["email_id"] == "e2" and stages.find(index, message_id="a@B").first()["email_id"] == "e1"


def test_made_mailboxes(spark, tmp_path):
    from letterloom.sources.generate import made_mail, write_mailboxes

    mail = made_mail(spark, 300, 3)
    made = stages.preprocess(read_mbox(spark, write_mailboxes(mail, str(tmp_path / "made")), split_bytes=5000))
    kinds = {r["kind"]: r["count"] for r in mail.groupBy("kind").count().collect()}
    assert made.parsed.count() == 300 and made.spam.count() == kinds["spam"] and made.clean.count() == 300 - kinds["spam"]
    mails = stages.to_emails(made.clean)
    assert mails.where("has_attachment").count() == kinds["mixed"] and mails.where("message_id = ''").count() > 40
    assert mails.where("subject like 'Re: %'").select("thread_id").distinct().count() == 7
    assert mails.where(~F.col("body_plain").startswith("About the ")).count() == 0 and mails.where(F.col("body_plain").contains("From here on")).count() > 10
    made.parsed.unpersist()


def test_settings_of_a_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# comment\nLETTERLOOM_TOP_K=7\nexport LETTERLOOM_DB_PATH='x y'\nOTHER=1\nLETTERLOOM_RRF_K=1\n")
    monkeypatch.setenv("LETTERLOOM_RRF_K", "9")
    found = Settings.load(str(tmp_path / ".env"))
    assert (found.top_k, found.db_path, found.rrf_k, found.chunk_size) == (7, "x y", 9, 1200)


def test_sentence_provider(monkeypatch):
    import pickle
    import sys
    import types

    import numpy as np

    from letterloom.functions.embed import provider

    by = provider("sentence", dimension=3, model="small", revision="r1", query_prefix="q: ")
    assert (by.model, by.revision) == ("sentence-transformers/all-MiniLM-L6-v2", "r1")
    monkeypatch.setitem(sys.modules, "sentence_transformers", None)
    with pytest.raises(RuntimeError, match="sentence-transformers"):
        by.encode(["a"])

    class Model:
        def __init__(self, name, revision):
            self.given = name, revision

        def encode(self, texts, normalize_embeddings):
            return np.array([[len(t), 0, 1] for t in texts])

    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Model))
    assert by.encode(["ab", None]).tolist() == [[2, 0, 1], [0, 0, 1]] and by.encode_query("a").tolist() == [4, 0, 1]
    assert pickle.loads(pickle.dumps(by))._loaded is None
    with pytest.raises(ValueError, match="dimensions"):
        provider("sentence", dimension=4).encode(["a"])


def test_commands(spark, mailbox, tmp_path, capsys):
    assert main(["index", mailbox, "--output", str(tmp_path / "i")]) == 0 and spark.read.parquet(str(tmp_path / "i")).count() == 4
    assert main(["split", mailbox, "--output", str(tmp_path / "s"), "--years", "2024", "2003"]) == 0
    assert set(json.loads(capsys.readouterr().out)) == {"2003-01", "2024-04"}
    assert main(["preprocess", mailbox, "--output", str(tmp_path / "p")]) == 0 and spark.read.json(str(tmp_path / "p" / "clean")).count() == 3
    clean, rules_file = tmp_path / "c.jsonl", tmp_path / "r.json"
    clean.write_text(_mail("m1", "x") + "\n{bad\n")
    rules_file.write_text(json.dumps([{"id": "r", "type": "sender", "value": "a@b.c"}]))
    assert main(["ignore-apply", str(clean), "--rules", str(rules_file), "--kept", str(tmp_path / "k"), "--ignored", str(tmp_path / "g")]) == 0
    assert json.loads(capsys.readouterr().out) == {"kept": 0, "ignored": 1, "undecodable": 1, "by_rule": {"r": 1}}
    assert [r[0] for r in spark.read.text(str(tmp_path / "k")).collect()] == ["{bad"]


def test_meta_mismatch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.ensure_meta({"embedding_dimension": 8})
    store.ensure_meta({"embedding_dimension": 8})
    with pytest.raises(ValueError, match="mismatch"):
        store.ensure_meta({"embedding_dimension": 9})


@pytest.mark.parametrize("text, expected", [
    ("mail of 2011", {"year": 2011}), ("plans sent in March", {"month": 3}), ("visits of Oct", {"month": 10}),
    ("anything from kim@made.example", {"from_address": "kim@made.example"}), ("who did I talk to most in 2011", {"intent": "aggregation", "aggregate_by": "from_address", "year": 2011}),
    ("how many messages in 2018", {"intent": "count", "year": 2018}), ("mail with attachment", {"has_attachment": True}), ("mail no attachment", {"has_attachment": False}),
    ("to emil@x.y about tax", {"to_address": "emil@x.y"}), ("from me", {"from_address": None}),
])
def test_questions(text, expected):
    parsed = parse(text)
    assert {k: getattr(parsed, k) for k in expected} == expected


def test_question_parts():
    parsed = parse("notes on the orchard fence in 2018")
    assert "2018" not in parsed.semantic and {"orchard", "fence"} <= set(parsed.keywords)
    assert parse("maybe market").month == 3 or parse("maybe market").month == 5
    assert parse("maybe market", whole_month_words=True).month is None
    plan = heuristic_plan(parsed)
    assert merged_plan(plan, {"intent": "nonsense", "filters": {"bad": 1, "year": 2021}}).filters == {"year": 2021}
    assert json_object('x {"a": 1} y') == {"a": 1} and json_object("no") is None

    class Broken:
        def complete(self, *a, **k):
            raise RuntimeError

    assert plan_query("emails in 2020", Broken()).filters == {"year": 2020}


def test_backend_limits():
    assert ChatBackend(None, "gpt-5-mini")._limits(5, 0.1) == {"max_completion_tokens": 5} and "temperature" in ChatBackend(None, "other")._limits(5, 0.1)
    assert "unknown date" in context([{"subject": None}])


def test_rules_file(spark, tmp_path):
    from letterloom.operators import rules

    path = tmp_path / "r.json"
    rules.write_template(str(path))
    loaded = rules.load_rules(str(path))
    assert {r.rule_type for r in loaded} <= set(rules.RULE_TYPES) and len(loaded) == len(rules.RULE_TYPES)
    path.write_text(json.dumps([{"type": "sender"}, {"type": "domain", "value": "x.y"}]))
    (one,) = rules.load_rules(str(path))
    assert one.reason == "unspecified" and len(one.rule_id) == 8


def test_streaming_inbox(spark, mailbox, tmp_path):
    from letterloom.streaming.inbox import daily_sender_stream, follow

    inbox = tmp_path / "inbox"
    made = stages.preprocess(read_mbox(spark, mailbox))
    made.clean.coalesce(1).write.json(str(inbox))
    for f in inbox.glob("part-*.json"):
        f.rename(f.with_suffix(".jsonl"))
    store = Store(spark, str(tmp_path / "db"))
    for _ in range(2):
        follow(spark, str(inbox), store, HashingProvider(16), str(tmp_path / "ck")).awaitTermination(120)
        assert store.read("emails").count() == 3
    query = daily_sender_stream(spark, str(inbox)).writeStream.outputMode("complete").format("memory").queryName("days").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(n) from days").first()[0] == 3


def test_stage_names():
    assert stages.stage_set("download,clean") == ["model", "preprocess"] and stages.stage_set(None) == list(stages.STAGES)
    with pytest.raises(ValueError):
        stages.stage_set("nope")


def test_bodies_and_headers_come_in_slices():
    """A batch of many messages is worked through in slices of bounded size, one longer message alone; no row is lost."""
    import pyarrow as pa

    from letterloom.functions import headers, mime

    raw = [b"From: a@b.example\nSubject: s%d\n\n" % i + b"x" * n for i, n in enumerate([1 << 20] * 9 + [6 << 20, 10, 0])] + [None]
    for made in (list(mime._bodies([pa.array(raw, pa.binary())])), list(headers._headers([pa.array(raw, pa.binary())]))):
        assert sum(map(len, made)) == len(raw) and [len(x) for x in made] == [3, 3, 3, 1, 3]
    assert [len(x) for x in headers.slices([pa.array([], pa.binary())])] == [0]


def test_small_ranges_of_a_large_mailbox_share_tasks(spark, tmp_path):
    """As many tasks as are asked for, however small the ranges; each message once, wherever ranges and tasks cut."""
    from letterloom.sources.mbox import MboxReader

    texts = [f"From a@b.example Mon Jan  {i % 9 + 1} 08:00:00 2024\nSubject: {i}\n\n{'x' * (i * 37 % 900)}\nFrom me\n\n" for i in range(400)]
    (tmp_path / "m.mbox").write_text("".join(texts))
    starts = [sum(map(len, texts[:i])) for i in range(400)]
    for split, tasks in ((1, 7), (64, 3), (100, 16), (5000, 1)):
        reader = MboxReader({"path": f"{tmp_path}/m.mbox", "splitBytes": split, "tasks": tasks})
        parts = reader.partitions()
        assert len(parts) <= tasks + 2
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["offset"], r["raw"].decode()) for r in rows] == list(zip(starts, texts))
    found = read_mbox(spark, f"{tmp_path}/m.mbox", split_bytes=100)
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 2 and found.count() == 400
