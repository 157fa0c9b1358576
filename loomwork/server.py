"""A mock server over generated collections: ``/`` lists them, ``/name`` gives rows, ``/name/i`` the row of a number.

For development: ``/name?offset=N&limit=N`` brings at most PAGE rows to this process, anew for every request. Rows are found
by their number, so any row of a collection of any size can be asked for.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.generate import ROW, Generator, Options

PAGE = 1000


def answer(spark: SparkSession, source: str, path: str, seed: int = 0) -> tuple[int, object]:
    """Status and body of a GET."""
    at = urlsplit(path)
    parts = [p for p in at.path.split("/") if p]
    generator = Generator(spark, source, Options(seed))
    frames = generator.run()
    if not parts:
        return 200, {"collections": sorted(frames)}
    if parts[0] not in frames or len(parts) > 2 or len(parts) == 2 and not parts[1].isdigit():
        return 404, {"error": "not found"}
    asked = {k: int(v[0]) for k, v in parse_qs(at.query).items() if k in ("offset", "limit") and v[0].isdigit()}
    first = int(parts[1]) if len(parts) == 2 else asked.get("offset", 0)
    count = 1 if len(parts) == 2 else min(PAGE, asked.get("limit", PAGE))
    made = generator.embedded(generator.made[parts[0]])
    rows = made.frame.where(F.col(ROW).between(first, first + count - 1)).orderBy(ROW)
    shown = made.shown().columns
    found = [json.loads(r) for r in rows.select(*[F.col(f"`{c}`") for c in shown]).toJSON().collect()]
    if len(parts) == 1:
        return 200, found
    return (200, found[0]) if found else (404, {"error": "not found"})


def serve(spark: SparkSession, source: str, port: int = 8080) -> ThreadingHTTPServer:
    """A server that isn't started yet; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            try:
                status, body = answer(spark, source, self.path)
            except Exception as e:  # the client is told, the server goes on
                status, body = 500, {"error": str(e)}
            self.reply(status, body)

        def do_POST(self):  # noqa: N802
            self.reply(405, {"error": "only GET"})

        do_PUT = do_DELETE = do_PATCH = do_POST

        def reply(self, status: int, body: object) -> None:
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
