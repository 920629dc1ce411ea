"""Command line: build, runs, show, history, diff, approve, reject, replay, tool, serve, verify, rebuild-manifests."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import FeedError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluice")
    for name, default in (("corpus", "corpus"), ("ledger", "ledger"), ("deploy", "deploy")):
        p.add_argument(f"--{name}", default=default)
    sub = p.add_subparsers(dest="verb", required=True)
    build = sub.add_parser("build")
    build.add_argument("client")
    build.add_argument("--seed", type=int)
    build.add_argument("--max-iterations", type=int, default=3)
    runs = sub.add_parser("runs")
    runs.add_argument("--limit", type=int, default=50)
    runs.add_argument("--json", action="store_true")
    sub.add_parser("show").add_argument("run_id")
    for verb in ("approve", "reject"):
        d = sub.add_parser(verb)
        d.add_argument("run_id")
        d.add_argument("--by", required=True)
        d.add_argument("--note", default="")
    history = sub.add_parser("history")
    history.add_argument("run_id")
    diff = sub.add_parser("diff")
    diff.add_argument("run_id")
    diff.add_argument("iteration", type=int)
    replay = sub.add_parser("replay")
    replay.add_argument("--seed", type=int, default=42)
    replay.add_argument("--adversarial")
    replay.add_argument("--headline", help="file for the figures")
    tool = sub.add_parser("tool", help="call a tool over the corpus or the runs")
    tool.add_argument("name")
    tool.add_argument("arguments", nargs="?", default="{}", help="a JSON object")
    serve = sub.add_parser("serve", help="answer the JSON routes until interrupted")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    sub.add_parser("verify")
    sub.add_parser("rebuild-manifests")
    return p


def run(args: argparse.Namespace, spark) -> object:
    """What the command gives, as plain data."""
    from . import tools
    from .operators import manifest
    from .operators.reports import text_table, write_headline
    from .service import RunService, replay
    from .sources import files

    service = RunService(spark, args.corpus, args.ledger, args.deploy)
    match args.verb:
        case "build":
            return service.start_run(args.client, args.seed, args.max_iterations)
        case "runs":
            found = service.list_runs(args.limit)
            return found if args.json else text_table(found, ("run_id", "client", "status", "iterations", "created_at"))
        case "show":
            return service.get_run(args.run_id)
        case "approve" | "reject":
            return service.decide(args.run_id, {"decision": args.verb, "approver": args.by, "note": args.note})
        case "history":
            return service.history(args.run_id)
        case "diff":
            return service.ledger.diff(args.run_id, args.iteration)
        case "replay":
            figures = replay(service, args.seed, adversarial_client=args.adversarial)
            if args.headline:
                write_headline(figures, args.headline)
            return figures
        case "tool":
            sources, control = tools.source_tools(spark, args.corpus), tools.control_tools(service)
            box = sources if args.name in sources.tools else control
            return box.call(args.name, **tools.arguments(args.arguments))
        case "serve":
            with tools.server(service, args.host, args.port) as server:
                server.serve_forever()
        case "verify":
            manifest.verify_all(spark, args.corpus)
            return "all manifests hold"
        case _:
            clients = files.list_clients(spark, args.corpus)
            for c in clients:
                manifest.write_manifest(manifest.build_manifest(spark, args.corpus, c), f"{args.corpus}/{c}/manifest.json")
            return clients


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sluice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = run(args, spark)
        print(out if isinstance(out, str) else json.dumps(out, indent=2, default=str))
    except FeedError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
