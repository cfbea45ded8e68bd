"""Thin wrappers around the plans: HTTP, and JSON-RPC over standard input and output."""

from __future__ import annotations

import json
import sys
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from sondage import __version__
from sondage.config import Config
from sondage.errors import EmbedderError, IndexNotFound, InvalidMode, InvalidPattern
from sondage.plans import render
from sondage.plans.index import build_index, index_status
from sondage.plans.search import search

#: Status codes of the engine's errors.
STATUS = {InvalidMode: 400, InvalidPattern: 400, IndexNotFound: 404, EmbedderError: 500}
_PATH = {"path": {"type": "string"}}
TOOLS = [
    {"name": "search", "description": "Search indexed source files.", "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "mode": {"type": "string"}, "top_k": {"type": "integer"}}, "required": ["query"]}},
    {"name": "index", "description": "Index a directory.", "inputSchema": {"type": "object", "properties": _PATH | {"force": {"type": "boolean"}}}},
    {"name": "status", "description": "What the index holds.", "inputSchema": {"type": "object", "properties": _PATH}},
]


class Service:
    """What can be asked, whatever the protocol."""

    def __init__(self, spark: SparkSession, root: str, index: str, config: Config):
        self.spark, self.root, self.index_path, self.config = spark, root, index, config

    def hits(self, query: str, mode: str = "hybrid", top_k: int | None = None, **_):
        return search(self.spark, self.index_path, query, mode, top_k or self.config.top_k, rrf_k=self.config.rrf_k, threshold=self.config.score_threshold)

    def search(self, **asked) -> dict:
        began = time.perf_counter()
        rows = [json.loads(x) for x in render.as_json(self.hits(**asked))]
        return {"results": rows, "total": len(rows), "duration_ms": int((time.perf_counter() - began) * 1000)}

    def index(self, force: bool = False, **_) -> dict:
        return build_index(self.spark, self.root, self.index_path, self.config, force=force)

    def status(self, **_) -> dict:
        return index_status(self.spark, self.index_path)

    def health(self, **_) -> dict:
        return {"status": "ok", "version": __version__}


def answer(service: Service, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """Status and answer of an HTTP request."""
    routes = {("POST", "/search"): service.search, ("POST", "/index"): service.index, ("GET", "/status"): service.status, ("GET", "/health"): service.health}
    handler = routes.get((method, path.partition("?")[0]))
    if handler is None:
        return 404, {"error": "no such route"}
    try:
        return 200, handler(**(json.loads(body) if body else {}))
    except (ValueError, TypeError) as e:
        return 400, {"error": str(e)}
    except tuple(STATUS) as e:
        return STATUS[type(e)], {"error": f"{type(e).__name__}: {e}"}


def call(service: Service, request: dict) -> dict | None:
    """The answer to a JSON-RPC request; None to a notification."""
    method, params, key = request.get("method"), request.get("params") or {}, request.get("id")
    if key is None:
        return None

    def reply(**x) -> dict:
        return {"jsonrpc": "2.0", "id": key} | x

    if method == "initialize":
        return reply(result={"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "sondage", "version": __version__}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": TOOLS})
    if method == "tools/call":
        name, asked = params.get("name"), params.get("arguments") or {}
        try:
            if name == "search":
                began = time.perf_counter()
                rows = service.hits(**asked).collect()
                text = render.block(rows, time.perf_counter() - began)
            elif name in ("index", "status"):
                text = json.dumps(getattr(service, name)(**asked))
            else:
                return reply(error={"code": -32602, "message": f"no such tool: {name}"})
        except Exception as e:
            return reply(result={"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True})
        return reply(result={"content": [{"type": "text", "text": text}]})
    return reply(error={"code": -32601, "message": f"no such method: {method}"})


def serve_stdio(service: Service, source=None, sink=None) -> None:
    """Answer one request per line until the input ends."""
    sink = sink or sys.stdout
    for line in source or sys.stdin:
        if not line.strip():
            continue
        try:
            out = call(service, json.loads(line))
        except ValueError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if out is not None:
            print(json.dumps(out), file=sink, flush=True)


def http_server(service: Service, host: str, port: int) -> ThreadingHTTPServer:
    """A server that is not yet running."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            code, out = answer(service, self.command, self.path, self.rfile.read(size))
            data = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def run(spark: SparkSession, root: str, index: str, config: Config, args) -> None:
    """Serve until interrupted; with ``watch`` the directory is followed meanwhile."""
    service, following = Service(spark, root, index, config), None
    if args.watch:
        from sondage.streaming.watch import watch_directory

        following = watch_directory(spark, root, index, f"{index}/watch", config)
    try:
        if args.stdio:
            serve_stdio(service)
        else:
            http_server(service, args.host or config.host, args.port or config.port).serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        if following is not None:
            following.stop()
