"""Tools and routes: what they give, and how they answer what they can't."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from sluice import cli, tools
from sluice.errors import FeedError
from sluice.operators import manifest
from sluice.service import RunService, new_run_id

SPEC = """```yaml feed-contract
client: calm
feed_name: daily
format: csv
expected_row_count: 3
columns:
  - {source: "Ref", target: trade_id}
  - {source: "Amt", target: amount, dtype: decimal}
  - {source: "Ccy", target: currency}
  - {source: "Day", target: value_date, dtype: date, date_format: "%Y-%m-%d"}
  - {source: "Acct", target: account_id}
  - {source: "Cpty", target: counterparty}
  - {source: "Note", target: description}
```
"""
HEADER = "Ref,Amt,Ccy,Day,Acct,Cpty,Note"


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tools")
    samples = root / "corpus" / "calm" / "samples"
    samples.mkdir(parents=True)
    (samples.parent / "spec.md").write_text(SPEC)
    (samples / "a.csv").write_text(HEADER + "\n" + "".join(f"R{i},{i}.50,GBP,2026-09-0{i + 1},A,B,n\n" for i in range(3)))
    manifest.write_manifest(manifest.build_manifest(spark, str(root / "corpus"), "calm", {"expected_outcome": "pass"}), str(samples.parent / "manifest.json"))
    return RunService(spark, str(root / "corpus"), str(root / "ledger"), str(root / "deploy"), latency_budget_ms=600_000)


def test_source_tools(spark, service):
    box = tools.source_tools(spark, service.corpus)
    assert box.call("list_clients") == ["calm"] and box.call("list_samples", client="calm") == ["a.csv"]
    assert box.call("read_spec", client="calm")["client"] == "calm"
    assert box.call("peek_sample", client="calm", name="a.csv", rows=0) == [HEADER]
    assert len(box.call("peek_sample", client="calm", name="a.csv", rows=99)) == 4
    assert box.call("profile_sample", client="calm", name="a.csv")["amount_sum"] == "4.50"
    for name, args in (
        ("read_spec", {"client": "none"}), ("read_spec", {"client": "../calm"}), ("peek_sample", {"client": "calm", "name": "b.csv"}),
        ("profile_sample", {"client": "calm", "name": "b.csv"}), ("list_samples", {}), ("nothing", {}),
    ):
        assert list(box.call(name, **args)) == ["error"], name
    assert len(box.calls) == 12


def test_runs_by_tools_and_routes(service):
    box, run_id = tools.control_tools(service), new_run_id("calm", 7)
    assert box.call("build_pipeline", client="calm", seed=7)["status"] == "awaiting_approval"
    assert [r["run_id"] for r in box.call("list_runs")] == [run_id]
    assert box.call("get_iteration", run_id=run_id, iteration=1)["passed"]
    assert len(box.call("get_history", run_id=run_id)) > 3
    ask = lambda method, path, body="": tools.respond(service, method, path, body)
    base = f"/api/runs/{run_id}"
    assert ask("GET", "/api/runs?limit=5")[1][0]["run_id"] == run_id and ask("GET", base)[1]["client"] == "calm"
    assert ask("GET", f"{base}/iterations/1/diff") == (200, {"changes": [], "text": ""})
    assert ask("GET", f"{base}/iterations/1")[0] == ask("GET", f"{base}/history")[0] == 200
    for method, path, body, status in (
        ("GET", "/api/runs/none", "", 404), ("GET", f"{base}/iterations/9", "", 404), ("GET", f"{base}/iterations/9/diff", "", 404), ("GET", "/other", "", 404),
        ("GET", "/api/runs?limit=x", "", 400), ("POST", f"{base}/decision", "", 400), ("POST", f"{base}/decision", "{", 400),
        ("POST", f"{base}/decision", '{"decision": "maybe", "approver": "A"}', 400), ("POST", "/api/runs", "", 405),
    ):
        assert ask(method, path, body)[0] == status, (method, path, body)
    said = json.dumps({"decision": "reject", "approver": "A"})
    assert ask("POST", f"{base}/decision", said)[1]["status"] == "rejected"
    assert ask("POST", f"{base}/decision", said)[0] == 409
    assert list(box.call("approve_run", run_id=run_id, approver="A")) == ["error"]


def test_server(service):
    with tools.server(service, port=0) as server:
        thread = threading.Thread(target=server.serve_forever, daemon=True)
        thread.start()
        base = f"http://127.0.0.1:{server.server_address[1]}"
        with urllib.request.urlopen(f"{base}/api/runs", timeout=60) as got:
            assert got.headers["Content-Type"] == "application/json" and len(json.load(got)) == 1
        with pytest.raises(urllib.error.HTTPError, match="404"):
            urllib.request.urlopen(f"{base}/api/runs/none", timeout=60)
        server.shutdown()
        thread.join(10)


def test_command_line(spark, service):
    args = ["--corpus", service.corpus, "--ledger", service.ledger.root, "--deploy", str(service.deploy)]
    run = lambda *more: cli.run(cli.parser().parse_args([*args, *more]), spark)
    assert run("tool", "list_samples", '{"client": "calm"}') == ["a.csv"]
    assert run("tool", "get_run", '{"run_id": "calm-00000000000000-none"}').keys() == {"error"}
    for bad in ("[]", "{"):
        with pytest.raises(FeedError):
            run("tool", "list_clients", bad)
