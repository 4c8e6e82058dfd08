"""The service surface as plain functions that return JSON-ready values."""

from __future__ import annotations

from letterloom.operators import dedupe, stats
from letterloom.operators.filters import by_id
from letterloom.plans.engine import Engine


def _rows(frame) -> list[dict]:
    return [{k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in r.asDict().items()} for r in frame.collect()]


def health(engine: Engine) -> dict:
    return {"status": "ok", "tables": engine.store.names()}


def search(engine: Engine, query: str, limit: int = 20, rag: bool = False) -> dict:
    response = engine.answer(query, limit) if rag else engine.search(query, limit)
    rows = _rows(response.results)
    return {"query": query, "type": response.plan.intent, "count": len(rows), "results": rows, "answer": response.answer}


def email(engine: Engine, email_id: str) -> dict | None:
    found = _rows(by_id(engine.store.read("emails").drop("subject_vector"), email_id))
    return found[0] if found else None


def statistics(engine: Engine) -> dict:
    mails = engine.store.read("emails")
    return {
        "emails": stats.count_where(mails).first()["n"], "chunks": stats.count_where(engine.store.read("email_chunks")).first()["n"],
        "by_year": _rows(stats.count_by_year(mails)), "top_senders": _rows(stats.top_senders(mails)),
        "duplicates": _rows(dedupe.duplicate_stats(mails, "email_id"))[0],
    }


def similar(engine: Engine, email_id: str, limit: int = 10) -> list[dict]:
    return _rows(engine.similar(email_id, limit))
