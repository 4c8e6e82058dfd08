"""Command line: python -m letterloom <command>."""

from __future__ import annotations

import argparse
import json
import os
import sys

from letterloom import api
from letterloom.functions.embed import provider
from letterloom.operators import rules, stats
from letterloom.plans import stages
from letterloom.plans.engine import Engine
from letterloom.plans.store import Store
from letterloom.plans.workspace import Workspace
from letterloom.settings import Settings
from letterloom.sources.mailjson import read_clean, read_lines
from letterloom.sources.mbox import read_mbox, read_message


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("letterloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _engine(a, s: Settings) -> Engine:
    return Engine(Store(_spark(), a.db or s.db_path), provider(s.embedding, dimension=s.embedding_dimension))


def run_pipeline(spark, mboxes: list[str], workspace: Workspace, s: Settings, wanted: str | None = None, resume: bool = True, refresh: bool = False, years: list[int] | None = None, limit: int | None = None) -> None:
    """The stages in order, vectorize and ingest over the first mails where a limit is given, each marked in the workspace; finished ones are passed over on resume."""
    todo = stages.stage_set(wanted)
    workspace.ensure()
    if refresh:
        workspace.refresh(todo)
    by = provider(s.embedding, dimension=s.embedding_dimension)
    for path in mboxes:
        workspace.link_input(path)
    for stage in todo:
        if resume and workspace.done(stage):
            continue
        workspace.update(stage, "running")
        try:
            details: dict = {}
            if stage == "split":
                periods = stages.write_split(read_mbox(spark, workspace.path("inputs")), workspace.path("split"), years)
                details = {r["period"]: {"emails": r["emails"], "bytes": r["bytes"]} for r in periods.collect()}
            elif stage == "preprocess":
                made = stages.preprocess(spark.read.parquet(workspace.path("split")))
                made.clean.write.mode("overwrite").json(workspace.path("clean"))
                made.spam.write.mode("overwrite").json(workspace.path("spam"))
                made.index.write.mode("overwrite").parquet(workspace.path("db", "mbox_index"))
                reasons = {r["reason"]: r["n"] for r in stats.histogram(made.spam).collect()}
                total = made.parsed.count()
                details = {"processed": total, "clean": total - sum(reasons.values()), "spam": sum(reasons.values())}
                with open(workspace.path("reports", "summary.txt"), "w", encoding="utf-8") as f:
                    size = made.parsed.selectExpr("coalesce(sum(length), 0)").first()[0]
                    folder = lambda name: sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(workspace.path(name)) for x in names)
                    f.write(stats.summary_text("inputs", details["clean"], reasons, 0, size, folder("clean"), folder("spam")))
                made.parsed.unpersist()
            elif stage == "vectorize":
                store, records = Store(spark, workspace.path("embeddings")), stages.good_records(read_lines(spark, workspace.path("clean", "*.json")))[0]
                vectors, chunk_vectors = stages.vectorize(stages.to_emails(records), by, s.chunk_size, s.chunk_overlap, limit)
                store.create(vectors, "email_vectors")
                store.create(chunk_vectors, "chunk_vectors")
            elif stage == "ingest":
                good, bad = stages.good_records(read_lines(spark, workspace.path("clean", "*.json")))
                store, ready = Store(spark, workspace.path("db")), Store(spark, workspace.path("embeddings"))
                for name in ("email_vectors", "chunk_vectors"):
                    store.create(ready.read(name), name)
                bad.write.mode("overwrite").json(workspace.path("logs", "errors"))
                details = {"stored": stages.ingest(store, good, by, s.chunk_size, s.chunk_overlap, limit=limit)}
                if details["stored"] >= s.compact_every:
                    for name in ("emails", "email_chunks"):
                        store.compact(name)
                store.index_fulltext()
        except KeyboardInterrupt:
            workspace.update(stage, "interrupted")
            raise
        except Exception as error:
            workspace.update(stage, "failed", error=str(error)[:500])
            raise
        workspace.update(stage, "done", **details)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="letterloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments, **aliases):
        c = sub.add_parser(name, **aliases)
        for names, options in arguments:
            c.add_argument(*names, **options)
        return c

    db = (["--db"], {})
    command("pipeline", (["mbox"], {"nargs": "+"}), (["--workspace"], {"required": True}), (["--stages"], {}), (["--refresh"], {"action": "store_true"}), (["--no-resume"], {"action": "store_true"}), (["--years"], {"type": int, "nargs": "*"}), (["--limit"], {"type": int}))
    command("split", (["mbox"], {}), (["--output"], {"required": True}), (["--years"], {"type": int, "nargs": "*"}))
    command("index", (["mbox"], {}), (["--output"], {"required": True}))
    command("preprocess", (["mbox"], {}), (["--output"], {"required": True}))
    command("query", (["text"], {}), (["--limit"], {"type": int, "default": 20}), db, aliases=["search"])
    command("stats", db)
    command("serve", (["--host"], {"default": "127.0.0.1"}), (["--port"], {"type": int, "default": 8000}), db)
    command("dedupe", (["--dry-run"], {"action": "store_true"}), db)
    command("message", (["--email-id"], {}), (["--message-id"], {}), (["--workspace"], {"required": True}), (["--output"], {}))
    command("validate", (["path"], {}), (["--strict"], {"action": "store_true"}), (["--max-errors"], {"type": int}))
    command("ignore-init", (["path"], {}))
    command("ignore-apply", (["clean"], {}), (["--rules"], {"required": True}), (["--kept"], {"required": True}), (["--ignored"], {"required": True}))
    command("workspace-init", (["path"], {}))
    command("workspace-info", (["path"], {}))
    command("version")
    a, s = p.parse_args(argv), Settings.load()
    if a.command == "pipeline":
        run_pipeline(_spark(), a.mbox, Workspace(a.workspace), s, a.stages, not a.no_resume, a.refresh, a.years, a.limit)
    elif a.command == "split":
        print(json.dumps({r["period"]: {"emails": r["emails"], "bytes": r["bytes"]} for r in stages.write_split(read_mbox(_spark(), a.mbox), a.output, a.years).collect()}))
    elif a.command == "index":
        stages.build_index(read_mbox(_spark(), a.mbox)).write.mode("overwrite").parquet(a.output)
    elif a.command == "preprocess":
        made = stages.preprocess(read_mbox(_spark(), a.mbox))
        made.clean.write.mode("overwrite").json(f"{a.output}/clean")
        made.spam.write.mode("overwrite").json(f"{a.output}/spam")
        made.index.write.mode("overwrite").parquet(f"{a.output}/mbox_index")
        made.parsed.unpersist()
    elif a.command in ("query", "search"):
        print(json.dumps(api.search(_engine(a, s), a.text, a.limit), indent=2, default=str))
    elif a.command == "stats":
        print(json.dumps(api.statistics(_engine(a, s)), indent=2, default=str))
    elif a.command == "serve":
        from letterloom.serve import serve

        serve(_engine(a, s), a.host, a.port).serve_forever()
    elif a.command == "dedupe":
        store = Store(_spark(), a.db or s.db_path)
        print(json.dumps({name: store.dedupe(name, key, a.dry_run) for name, key in (("emails", "email_id"), ("email_chunks", "chunk_id"))}))
    elif a.command == "message":
        spark, workspace = _spark(), Workspace(a.workspace)
        row = stages.find(spark.read.parquet(workspace.path("db", "mbox_index")), a.email_id, a.message_id).first()
        if row is None:
            print("not found", file=sys.stderr)
            return 1
        raw = read_message(workspace.path("inputs"), row["mbox_file"], row["offset"], row["length"])
        if a.output:
            with open(a.output, "wb") as f:
                f.write(raw)
        else:
            sys.stdout.buffer.write(raw)
    elif a.command == "validate":
        from letterloom.operators.validate import checked_summary

        print(json.dumps(checked_summary(read_lines(_spark(), a.path), a.strict, a.max_errors)))
    elif a.command == "ignore-init":
        rules.write_template(a.path)
    elif a.command == "ignore-apply":
        from pyspark.sql import functions as F

        records, errors = read_clean(_spark(), a.clean)
        columns = {"from_address": F.col("headers.from.email"), "subject": F.col("headers.subject"), "labels": F.col("tags"), "list_id": F.col("headers.list_id"), "message_id": F.col("headers.message_id")}
        kept, ignored = rules.routed(records, rules.load_rules(a.rules), columns)
        # Lines that are no JSON match no rule: they stay, as they are, for the stages that report them.
        kept.select("line").unionByName(errors.select(F.col("raw").alias("line"))).write.mode("overwrite").text(a.kept)
        ignored.drop("line").write.mode("overwrite").json(a.ignored)
        by_rule = {r["ignore_rule_id"]: r["count"] for r in ignored.groupBy("ignore_rule_id").count().collect()}
        print(json.dumps({"kept": kept.count(), "ignored": sum(by_rule.values()), "undecodable": errors.count(), "by_rule": by_rule}))
    elif a.command == "workspace-init":
        Workspace(a.path).ensure()
    elif a.command == "workspace-info":
        w = Workspace(a.path)
        print(json.dumps({"config": w.config, "state": w.state}, indent=2))
    else:
        print("0.1.0")
    return 0


if __name__ == "__main__":
    sys.exit(main())
