"""The service functions over HTTP, with the standard library's server."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from letterloom import api
from letterloom.plans.engine import Engine


def route(engine: Engine, method: str, target: str, body: dict | None = None) -> tuple[int, object]:
    """(status, value) of a request; value is JSON-ready."""
    url = urlsplit(target)
    given = {k: v[-1] for k, v in parse_qs(url.query).items()} | (body or {})
    if url.path == "/health":
        return 200, api.health(engine)
    if url.path == "/stats":
        return 200, api.statistics(engine)
    if url.path == "/search":
        text = given.get("query") or given.get("q")
        if not text:
            return 422, {"detail": "query is missing"}
        return 200, api.search(engine, text, int(given.get("limit", 20)), str(given.get("rag", "")).lower() in ("1", "true"))
    if m := re.fullmatch(r"/emails/([^/]+)(/similar)?", url.path):
        if api.email(engine, m[1]) is None:
            return 404, {"detail": "not found"}
        return 200, api.similar(engine, m[1], int(given.get("limit", 10))) if m[2] else api.email(engine, m[1])
    return 404, {"detail": "not found"}


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, body: dict | None = None) -> None:
            try:
                status, value = route(engine, self.command, self.path, body)
            except ValueError as error:
                status, value = 422, {"detail": str(error)}
            raw = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            self.answer()

        def do_POST(self) -> None:  # noqa: N802
            self.answer(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}"))

    return ThreadingHTTPServer((host, port), Handler)
