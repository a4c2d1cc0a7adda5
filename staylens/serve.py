"""The search over HTTP: a question is posted, its progress and result come back as server-sent events."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .plans.engine import HybridSearch, server_sent

MOST_BODY = 1 << 20  #: bytes of a request that are read


def server(engine: HybridSearch, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server of ``POST /api/query`` with ``{"query": text, "hyde": flag}`` and ``GET /api/health``; ``serve_forever`` runs it.

    A body that is no JSON object and a blank question are answered with 400, other paths with 404.
    """

    class Handler(BaseHTTPRequestHandler):
        def _json(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802 - named by the base class
            self._json(*((200, {"status": "ok"}) if self.path == "/api/health" else (404, {"error": "not found"})))

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/api/query":
                return self._json(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(min(int(self.headers.get("Content-Length") or 0), MOST_BODY)))
                query, hyde = str(body.get("query") or ""), bool(body.get("hyde"))
            except (ValueError, AttributeError):
                return self._json(400, {"error": "the body is no JSON object"})
            if not query.strip():
                return self._json(400, {"error": "the question is blank"})
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream; charset=utf-8")
            self.send_header("Cache-Control", "no-cache")
            self.end_headers()
            for line in server_sent(engine.events(query, hyde)):
                self.wfile.write(line.encode())
                self.wfile.flush()
            return None

        def log_message(self, *args: object) -> None:
            """Requests are not logged."""

    return ThreadingHTTPServer((host, port), Handler)
