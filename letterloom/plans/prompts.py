"""Prompts for optional language models, and a protocol for their backends."""

from __future__ import annotations

from collections.abc import AsyncIterator, Sequence
from datetime import datetime
from typing import Protocol, runtime_checkable

RAG_BODY, SUMMARY_BODY = 500, 800


@runtime_checkable
class LLMBackend(Protocol):
    def complete(self, prompt: str, max_tokens: int = 1024, temperature: float = 0.3) -> str: ...

    def stream(self, prompt: str, max_tokens: int = 1024, temperature: float = 0.3) -> AsyncIterator[str]: ...


class StubBackend:
    """Answers from a list, for tests and offline use; remembers what it was asked."""

    def __init__(self, answers: Sequence[str] = ()):
        self.answers, self.prompts = list(answers), []

    def complete(self, prompt: str, max_tokens: int = 1024, temperature: float = 0.3) -> str:
        self.prompts.append(prompt)
        return self.answers.pop(0) if self.answers else ""

    async def stream(self, prompt: str, max_tokens: int = 1024, temperature: float = 0.3):
        for word in self.complete(prompt, max_tokens, temperature).split():
            yield word


class ChatBackend:
    """A chat-completion service behind a client object with chat.completions.create."""

    def __init__(self, client, model: str):
        self.client, self.model = client, model

    def _limits(self, max_tokens: int, temperature: float) -> dict:
        if self.model.startswith("gpt-5"):
            return {"max_completion_tokens": max_tokens}
        return {"max_tokens": max_tokens, "temperature": temperature}

    def complete(self, prompt: str, max_tokens: int = 1024, temperature: float = 0.3) -> str:
        made = self.client.chat.completions.create(model=self.model, messages=[{"role": "user", "content": prompt}], **self._limits(max_tokens, temperature))
        return made.choices[0].message.content or ""

    async def stream(self, prompt: str, max_tokens: int = 1024, temperature: float = 0.3):
        for part in self.client.chat.completions.create(model=self.model, messages=[{"role": "user", "content": prompt}], stream=True, **self._limits(max_tokens, temperature)):
            if text := part.choices[0].delta.content:
                yield text


def cut(text: str | None, size: int) -> str:
    text = text or ""
    return text if len(text) <= size else text[:size] + "..."


def long_date(value) -> str:
    return value.strftime("%B %d, %Y") if isinstance(value, datetime) else "unknown date"


def context(mails: Sequence[dict], size: int = RAG_BODY) -> str:
    """Mails as numbered blocks: sender's name or address, date, subject, and the body cut to size."""
    blocks = []
    for n, m in enumerate(mails, 1):
        who = m.get("from_name") or m.get("from_address") or "unknown"
        blocks.append(f"[{n}] {long_date(m.get('date'))}, {who}: {m.get('subject') or '(no subject)'}\n{cut(m.get('body_plain'), size)}")
    return "\n\n".join(blocks)


def rag_prompt(question: str, mails: Sequence[dict]) -> str:
    return f"Answer the question from the mails below and cite them by number. Say so if they don't answer it.\n\n{context(mails)}\n\nQuestion: {question}\nAnswer:"


def expansion_prompt(question: str) -> str:
    return f"Write other wordings and related terms for this search in a mail archive, one in each line.\n\nSearch: {question}"


def plan_prompt(question: str) -> str:
    return (
        "Turn the question about a mail archive into a JSON object with the keys intent (search, count or aggregation), "
        "aggregate_by, filters, semantic, fulltext, use_vector and use_fulltext. Filters may be from, to, from_domain, year, "
        f"month, start_date, end_date, has_attachment and labels. Answer with the object only.\n\nQuestion: {question}"
    )


def summary_prompt(mails: Sequence[dict]) -> str:
    return f"Summarise these mails: who wants what, what was decided, and what is open.\n\n{context(mails, SUMMARY_BODY)}"
