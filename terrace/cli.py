"""Command line: what is registered, runs, snapshots and builds.

    python -m terrace.cli info | env | schema PATH | run QUERY DIR
    python -m terrace.cli snapshot {list,show,register,verify} ...
    python -m terrace.cli build {list,lineage} ...

Exit code 0: done; 1: a check failed; 2: wrong use.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import asdict
from datetime import date

from terrace import __version__, registry
from terrace.plans import identity


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("terrace").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrace")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("info", help="version and registered queries")
    commands.add_parser("env", help="versions of what is installed")
    schema = commands.add_parser("schema", help="columns, presence and examples of a layer")
    schema.add_argument("path")
    run = commands.add_parser("run", help="one query over a folder of tables")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out", help="a Parquet folder for the result, instead of its first rows")
    snapshot = commands.add_parser("snapshot").add_subparsers(dest="action", required=True)
    for name in ("list", "show", "register", "verify"):
        a = snapshot.add_parser(name)
        a.add_argument("--root", default="snapshots")
        if name != "list":
            a.add_argument("dataset")
        if name in ("show",):
            a.add_argument("snapshot_id")
        if name == "register":
            a.add_argument("source")
            a.add_argument("--collected", type=date.fromisoformat, default=date.today())
    build = commands.add_parser("build").add_subparsers(dest="action", required=True)
    for name in ("list", "lineage"):
        a = build.add_parser(name)
        a.add_argument("--root", default="builds")
        if name == "lineage":
            a.add_argument("build_id")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    told: object = None
    if args.command == "info":
        told = {"version": __version__, "queries": sorted(registry.queries())}
    elif args.command == "env":
        told = identity.environment()
    elif args.command == "schema":
        from terrace.operators.quality import schema_report
        from terrace.plans.catalog import read_artifact

        schema_report(read_artifact(_session(), args.path)).show(1000, truncate=60)
    elif args.command == "run":
        query = registry.queries().get(args.query)
        if query is None:
            print(f"no query {args.query}", file=sys.stderr)
            return 2
        result = query(_session(), args.folder)
        if args.out:
            result.write.parquet(args.out)
        else:
            result.show(40, truncate=60)
    elif args.command == "snapshot":
        store = identity.SnapshotStore(args.root)
        if args.action == "list":
            told = [s.citation() for s in store.list()]
        elif args.action == "show":
            told = asdict(store.load(args.dataset, args.snapshot_id))
        elif args.action == "register":
            from terrace.sources.records import scan_jsonl

            found = scan_jsonl(_session(), args.source).first()
            told = asdict(store.register(args.source, args.dataset, args.collected, found["rows"], found["keys"]))
        else:
            states = {k: v for k, v in store.verify_all().items() if k.startswith(args.dataset + "/")}
            print(json.dumps(states, indent=2))
            return int(not all(states.values()))
    else:
        builds = identity.BuildStore(args.root)
        told = [f"{b.build_id} {b.dataset} {b.layer}" for b in (builds.all() if args.action == "list" else builds.lineage(args.build_id))]
    if told is not None:
        print(json.dumps(told, indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
