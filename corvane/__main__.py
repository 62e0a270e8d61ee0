"""Command line: python -m corvane COMMAND --index FOLDER ...; results are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane")
    parser.add_argument("--index", required=True, help="folder of the index tables")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "init": [], "status": [], "compact": [], "sync": ["root"], "index-file": ["root", "path"], "remove-file": ["path"], "search": ["query"], "search-files": ["query"],
        "locate": ["query"], "symbol": ["name"], "refs": ["name"], "regex": ["root", "pattern"], "find-files": ["glob"], "traverse": ["key"], "watch": ["root", "events", "checkpoint"],
    }.items():
        p = commands.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        p.add_argument("--top-k", type=int, default=10)
        p.add_argument("--quality", default="thorough")
        p.add_argument("--depth", type=int, default=2)
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from corvane.config import Config
    from corvane.plans.engine import Engine

    spark = SparkSession.builder.appName("corvane").getOrCreate()
    engine = Engine(spark, args.index, Config.from_env(top_k=args.top_k))

    def show(df) -> None:
        for line in df.toJSON().toLocalIterator():
            print(line)

    match args.command:
        case "init":
            engine.store.purge()
            print(json.dumps({"status": "ready", "index": args.index}))
        case "sync":
            print(json.dumps(engine.sync(args.root)))
        case "index-file":
            listing = engine.listing(args.root).filter(F.col("path") == args.path)
            print(json.dumps(engine.sync_files(listing, delete_removed=False)))
        case "remove-file":
            engine.remove([args.path])
            print(json.dumps({"removed": args.path}))
        case "compact":
            engine.compact()
            print(json.dumps({"status": "compacted"}))
        case "status":
            show(engine.status())
        case "search":
            show(engine.search(args.query, args.quality).orderBy("rank"))
        case "search-files":
            show(engine.search_files(args.query, args.quality, args.top_k).orderBy("rank"))
        case "locate":
            show(engine.locate(args.query, k=args.top_k))
        case "symbol":
            show(engine.symbol(args.name, args.top_k))
        case "refs":
            show(engine.refs(args.name))
        case "regex":
            show(engine.regex(args.root, args.pattern, args.top_k))
        case "find-files":
            show(engine.find_files(args.glob, args.top_k))
        case "traverse":
            show(engine.traverse(args.key, args.depth))
        case "watch":
            engine.watch(args.root, args.events, args.checkpoint).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
