"""Command line: index, search, serve, status."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time

from sondage import config as configuration
from sondage.errors import SondageError
from sondage.operators.embedding import embedder_of
from sondage.plans import render
from sondage.plans.index import build_index, index_status
from sondage.plans.search import Mode, search
from sondage.session import session
from sondage.sources.index_store import project_dir


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sondage", description="Hybrid search over source files, on Spark.")
    p.add_argument("--json", action="store_true", help="machine-readable output")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("--config", help="TOML file")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("index", "index a directory"), ("status", "what an index holds")):
        c = sub.add_parser(name, help=text)
        c.add_argument("path", nargs="?", default=".")
        if name == "index":
            c.add_argument("--model", help="directory with model.onnx and tokenizer.json, or 'dummy' for trials")
            c.add_argument("--force", action="store_true", help="index all files anew")
    c = sub.add_parser("search", help="search an index")
    c.add_argument("query")
    c.add_argument("--mode", default="hybrid", help=", ".join(m.value for m in Mode))
    c.add_argument("-k", "--top-k", type=int)
    c.add_argument("--model", help="another model than the index was made with")
    c.add_argument("--approximate", action="store_true", help="look into the nearest stored cells of vectors only")
    c.add_argument("--path", default=".")
    c = sub.add_parser("serve", help="answer requests over HTTP or standard input")
    c.add_argument("--path", default=".")
    c.add_argument("--model", help="directory with model.onnx and tokenizer.json, or 'dummy' for trials")
    c.add_argument("--host")
    c.add_argument("--port", type=int)
    c.add_argument("--stdio", action="store_true", help="JSON-RPC on standard input and output")
    c.add_argument("--watch", action="store_true", help="follow changes of the directory")
    return p


def main(argv: list[str] | None = None) -> int:
    """Run a command; errors of the engine go to standard error and give status 1."""
    from pathlib import Path

    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING, stream=sys.stderr)
    config = configuration.load(args.config) if args.config else configuration.Config()
    if getattr(args, "model", None):
        config.model = args.model
    root = str(Path(args.path).resolve())
    index = project_dir(config.index_dir, root)
    spark = session()
    try:
        if args.command == "index":
            counts = build_index(spark, root, index, config, force=args.force)
            print(json.dumps(counts) if args.json else ", ".join(f"{v} {k}" for k, v in counts.items()))
        elif args.command == "status":
            found = index_status(spark, index)
            print(json.dumps(found) if args.json else "\n".join(f"{k}: {v}" for k, v in found.items()))
        elif args.command == "search":
            began = time.perf_counter()
            hits = search(spark, index, args.query, args.mode, args.top_k or config.top_k, embedder=embedder_of(args.model) if args.model else None, rrf_k=config.rrf_k, threshold=config.score_threshold, approximate=args.approximate)
            if args.json:
                rows = [json.loads(x) for x in render.as_json(hits)]
                print(json.dumps({"results": rows, "total": len(rows), "duration_ms": int((time.perf_counter() - began) * 1000)}))
            else:
                print(render.coloured(hits))
        else:
            from sondage import server

            server.run(spark, root, index, config, args)
    except SondageError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
