"""Command line: ``index`` a folder, or ``serve`` tool calls as JSON lines on standard input."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from lodestone.engine import Engine
from lodestone.sources import config


def answer(engine: Engine, line: str) -> dict:
    """One call {"tool": ..., "arguments": {...}}: its rows, or the error."""
    try:
        call = json.loads(line)
        tool = call["tool"]
        if tool.startswith("_") or not callable(getattr(engine, tool, None)):
            raise ValueError(f"unknown tool {tool}")
        out = getattr(engine, tool)(**call.get("arguments", {}))
    except Exception as e:  # a failed call must not end the service
        return {"error": f"{type(e).__name__}: {e}"}
    if isinstance(out, dict):
        return {k: [json.loads(x) for x in v.toJSON().collect()] for k, v in out.items()}
    return {"rows": [json.loads(x) for x in out.toJSON().collect()]} if isinstance(out, DataFrame) else {"result": out}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("--store", help="folder of the tables (any path Spark can write)")
    parser.add_argument("--config", help=f"settings in TOML, by default {config.FILE}; the environment's LODESTONE_STORE, _PROFILE and _NICE come before it")
    parser.add_argument("--profile", help="name of the embedding model's profile")
    sub = parser.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("path")
    index.add_argument("--project", required=True)
    index.add_argument("--full", action="store_true")
    index.add_argument("--nice", type=int, help="how far indexing gives way to other processes here; 0: not at all")
    sub.add_parser("serve")
    args = parser.parse_args(argv)
    file = config.load(args.config)
    store = config.setting("store", args.store, file)
    if not store:
        parser.error("no store: give --store, LODESTONE_STORE or store in the settings file")
    if args.command == "index" and (nice := config.nice_value(args.nice, file)):
        os.nice(nice)  # before Spark starts, so that its processes follow
    profile = config.setting("profile", args.profile, file, "hashed")
    engine = Engine(SparkSession.builder.appName("lodestone").getOrCreate(), store, profile=profile)
    if args.command == "index":
        engine.register_project(args.project, args.path)
        engine.reindex(args.project, args.full)
        return 0
    for line in sys.stdin:
        if line.strip():
            print(json.dumps(answer(engine, line), default=str), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
