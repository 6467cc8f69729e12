"""python -m tessera init|mine|search|stats|kg|wake-up|hook|mcp|compare|instructions"""

from __future__ import annotations

import argparse
import json
import sys
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import prefix_bytes
from tessera.palace import Palace
from tessera.service import Service, stats_text
from tessera.sources import config

INSTRUCTIONS = """Search before answering about earlier work; store each decision as one short text; keep texts self-contained.
mine PATH [WING] ingests a file or folder; search QUERY finds texts; wake-up [--wing WING] prints the digest."""


def main(argv: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(prog="tessera", description=__doc__)
    cli.add_argument("--config", default="tessera.yaml")
    verbs = cli.add_subparsers(dest="verb", required=True)
    for verb in ("init", "stats", "hook", "mcp", "instructions"):
        verbs.add_parser(verb)
    mine = verbs.add_parser("mine")
    mine.add_argument("path")
    mine.add_argument("wing", nargs="?")
    verbs.add_parser("search").add_argument("query")
    verbs.add_parser("kg").add_argument("subject", nargs="?")
    verbs.add_parser("wake-up").add_argument("--wing")
    compare = verbs.add_parser("compare")
    compare.add_argument("a")
    compare.add_argument("b")
    args = cli.parse_args(argv)
    if args.verb == "instructions":
        print(INSTRUCTIONS)
        return 0
    settings = config.load(args.config)
    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    palace = Palace.open(spark, settings.database_path)
    service = Service(palace, settings.default_wing)
    if args.verb == "mine":
        print(palace.mine(args.path, args.wing or settings.default_wing, now=int(time.time()), ignore=settings.ignore_patterns))
    elif args.verb == "search":
        rows = palace.search(args.query, now=int(time.time())).withColumn("short", prefix_bytes(F.col("content"), 200)).collect()
        for i, r in enumerate(rows, 1):
            print(f"─── Result {i} ───\nWing: {r.wing_name}  Room: {r.room_name}  Score: {r.score:.4f}\nSource: {r.source_path}\n{r.short}...\n")
        if not rows:
            print("No results found.")
    elif args.verb == "stats":
        print(stats_text(palace.stats().head()))
    elif args.verb == "kg":
        rows = palace.edges(args.subject).collect()
        for r in rows:
            print(f"{r.subject} —[{r.predicate}]→ {r.object}  (confidence: {r.confidence:.2f})")
        if not rows:
            print("No knowledge graph entries found.")
    elif args.verb == "wake-up":
        print(palace.wake_up(args.wing), end="")
    elif args.verb == "hook":
        try:
            event = json.load(sys.stdin)
        except ValueError:
            event = {}
        print(json.dumps(service.process_hook(event), ensure_ascii=False))
    elif args.verb == "mcp":
        for line in sys.stdin:
            if (answer := service.handle_rpc(line)) is not None:
                print(answer, flush=True)
    elif args.verb == "compare":
        a, b = (np.array(palace.embedder.embed(t)) for t in (args.a, args.b))
        print(f"{float(a @ b):.4f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
