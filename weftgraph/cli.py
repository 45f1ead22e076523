"""Command line: add nodes and edges to a store, and list them."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .repository import EdgeRepository, NodeRepository
from .sources.store import GraphStore, rows_from_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--data", default="data", help="folder of the store")
    p.add_argument("--format", default="json", choices=("json", "parquet"))
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("add-nodes", "JSON list of nodes, or @file"), ("add-edges", "JSON list of edges, or @file"), ("add", "JSON object with nodes and edges, or @file")):
        sub.add_parser(name).add_argument("json", help=what)
    sub.add_parser("list").add_argument("--limit", type=int, default=None)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    store = GraphStore(spark, args.data, args.format).initialize()
    nodes, edges = NodeRepository(store), EdgeRepository(store)
    load = lambda name: Path(args.data, name).read_text()
    try:
        if args.command == "list":
            for repo in (nodes, edges):
                for row in repo.list(limit=args.limit).select(F.to_json(F.struct("*"))).toLocalIterator():
                    print(row[0])
            return 0
        given = rows_from_json(args.json, load)
        parts = {"add-nodes": {"nodes": given}, "add-edges": {"edges": given}}.get(args.command) or {k: [r for g in given for r in g.get(k, [])] for k in ("nodes", "edges")}
        for repo in (nodes, edges):
            if rows := parts.get(repo.table):
                repo.create(spark.createDataFrame(rows))
                print(f"added {len(rows)} {repo.table}")
        return 0
    except (EngineError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
