"""Named tools over a corpus and over runs, and the JSON routes that a browser or client calls.

A tool takes keyword arguments and gives plain data; an error of the engine comes back as
{"error": text}. Routes answer with a status and a body: 404 for what isn't there, 409 for
a decision that a run doesn't wait for, 400 for a bad request.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import PurePosixPath
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .errors import FeedError, InvalidTransition, RunNotFound
from .operators import manifest
from .plans.contract import to_dict
from .service import RunService
from .sources import files


class ToolBox:
    """Tools by name, with the names of the calls made."""

    def __init__(self, tools: dict[str, Callable]):
        self.tools, self.calls = tools, []

    def call(self, name: str, /, **args) -> object:
        self.calls.append(name)
        try:
            if name not in self.tools:
                raise FeedError(f"unknown tool {name!r}")
            return self.tools[name](**args)
        except (FeedError, TypeError) as e:
            return {"error": str(e)}


def arguments(text: str) -> dict:
    """The arguments of a call, from a JSON object."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise FeedError(f"arguments aren't JSON: {e}") from e
    if not isinstance(found, dict):
        raise FeedError("arguments are a JSON object")
    return found


def source_tools(spark: SparkSession, corpus: str) -> ToolBox:
    """Read-only tools over contracts and samples. Profiles are those of the manifest, not recomputed."""

    def known(client: str) -> str:
        if files.safe_name(client) not in files.list_clients(spark, corpus):
            raise FeedError(f"unknown client {client!r}")
        return client

    def names(client: str) -> list[str]:
        return [PurePosixPath(p).name for p in files.sample_paths(spark, corpus, known(client))]

    def read_spec(client: str) -> dict:
        return to_dict(files.load_contract(spark, corpus, known(client)))

    def peek_sample(client: str, name: str, rows: int = 5) -> list[str]:
        paths = {PurePosixPath(p).name: p for p in files.sample_paths(spark, corpus, known(client))}
        if files.safe_name(name) not in paths:
            raise FeedError(f"{client} has no sample {name!r}")
        return [r.line for r in files.peek(files.read_texts(spark, paths[name]), rows).orderBy("idx").collect()]

    def profile_sample(client: str, name: str) -> dict:
        return manifest.pinned_profile(manifest.load_manifest(spark, corpus, known(client)), name)

    return ToolBox({
        "list_clients": lambda: files.list_clients(spark, corpus), "read_spec": read_spec, "list_samples": names,
        "peek_sample": peek_sample, "profile_sample": profile_sample,
    })


def control_tools(service: RunService) -> ToolBox:
    """Tools over runs: start, show, decide."""

    def decision(verdict: str) -> Callable:
        return lambda run_id, approver, note="": service.decide(run_id, {"decision": verdict, "approver": approver, "note": note})

    return ToolBox({
        "build_pipeline": lambda client, seed=None, max_iterations=3: service.start_run(client, seed, max_iterations),
        "list_runs": service.list_runs, "get_run": service.get_run, "get_iteration": service.ledger.load_iteration,
        "get_history": service.history, "approve_run": decision("approve"), "reject_run": decision("reject"),
    })


#: Method, path, and the names of what the path holds.
ROUTES = [
    ("GET", r"/api/runs", "runs"), ("GET", r"/api/runs/(?P<run_id>[^/]+)", "run"), ("GET", r"/api/runs/(?P<run_id>[^/]+)/history", "history"),
    ("GET", r"/api/runs/(?P<run_id>[^/]+)/iterations/(?P<iteration>\d+)", "iteration"),
    ("GET", r"/api/runs/(?P<run_id>[^/]+)/iterations/(?P<iteration>\d+)/diff", "diff"),
    ("POST", r"/api/runs/(?P<run_id>[^/]+)/decision", "decision"),
]


def respond(service: RunService, method: str, target: str, body: str = "") -> tuple[int, object]:
    """(status, data) of a request."""
    url = urlsplit(target)
    query = {k: v[-1] for k, v in parse_qs(url.query).items()}
    found = [(name, m.groupdict(), verb) for verb, path, name in ROUTES if (m := re.fullmatch(path, url.path))]
    if not found:
        return 404, {"error": f"no route {url.path}"}
    here = [(name, args) for name, args, verb in found if verb == method]
    if not here:
        return 405, {"error": f"{method} isn't for {url.path}"}
    name, args = here[0]
    if "iteration" in args:
        args["iteration"] = int(args["iteration"])
    try:
        match name:
            case "runs":
                return 200, service.list_runs(int(query.get("limit", 50)))
            case "run":
                return 200, service.get_run(**args)
            case "history":
                return 200, service.history(**args)
            case "iteration":
                return 200, service.ledger.load_iteration(**args)
            case "diff":
                service.ledger.load_iteration(**args)
                return 200, {"changes": service.ledger.diff(**args), "text": service.ledger.text_diff(**args)}
            case _:
                return 200, service.decide(args["run_id"], json.loads(body or "null"))
    except RunNotFound as e:
        return 404, {"error": str(e)}
    except InvalidTransition as e:
        return 409, {"error": str(e)}
    except (FeedError, ValueError) as e:
        return 400, {"error": str(e)}


def server(service: RunService, host: str = "127.0.0.1", port: int = 8000) -> HTTPServer:
    """A server of the routes, one request at a time; the caller runs and closes it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, data = respond(service, self.command, self.path, self.rfile.read(size).decode("utf-8", "replace"))
            raw = json.dumps(data, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, format: str, *args) -> None:  # noqa: A002
            pass

    return HTTPServer((host, port), Handler)
