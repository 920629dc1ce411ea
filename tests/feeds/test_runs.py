"""A small corpus of three clients, from contract to approval."""

import json

import pytest

from sluice.errors import ContractError, FeedError, InvalidTransition, RunNotFound
from sluice.operators import guard, manifest
from sluice.service import RunService, decision_of, new_run_id, replay, route

COLUMNS = """columns:
  - {source: "Ref", target: trade_id}
  - {source: "Acct", target: account_id}
  - {source: "Day", target: value_date, dtype: date, date_format: "%d/%m/%Y"}
  - {source: "Amt", target: amount, dtype: decimal, sign_column: "Side", negative_marker: "DR"}
  - {source: "Side", target: null}
  - {source: "Ccy", target: currency}
  - {source: "Cpty", target: counterparty}
  - {source: "Note", target: description}
"""
LINES = [f'R{i},A{i % 3},{i + 1:02d}/09/2026,"{1000 * i + 5:,}.50",{"DR" if i % 2 else "CR"},GBP,Bank {i},n{i}' for i in range(14)]
SCENARIOS = {
    "calm": {"expected_outcome": "pass"},
    "flipped": {"expected_outcome": "heal", "injected_defect": "amount_sign_dropped"},
    "short": {"expected_outcome": "escalate"},
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for client in SCENARIOS:
        d = root / client / "samples"
        d.mkdir(parents=True)
        n = 15 if client == "short" else 14
        (root / client / "spec.md").write_text(f"```yaml feed-contract\nclient: {client}\nfeed_name: daily\nformat: csv\nexpected_row_count: {n}\n{COLUMNS}```\n")
        (d / "day1.csv").write_text("Ref,Acct,Day,Amt,Side,Ccy,Cpty,Note\n" + "\n".join(LINES) + "\n")
    for client, scenario in SCENARIOS.items():
        manifest.write_manifest(manifest.build_manifest(spark, str(root), client, scenario), str(root / client / "manifest.json"))
    return root


@pytest.fixture(scope="module")
def service(spark, corpus, tmp_path_factory):
    work = tmp_path_factory.mktemp("work")
    return RunService(spark, str(corpus), str(work / "ledger"), str(work / "deploy"), latency_budget_ms=600_000)


def test_manifest_and_its_verification(spark, corpus):
    m = manifest.load_manifest(spark, str(corpus), "calm")
    (pin,) = m["samples"]
    total = sum((-1 if i % 2 else 1) * (1000 * i + 5.5) for i in range(14))
    assert (pin["expected_rows"], pin["amount_sum"], pin["distinct"]["account_id"]) == (14, f"{total:.2f}", 3)
    assert manifest.pinned_profile(m, "day1.csv") == pin
    manifest.verify_all(spark, str(corpus))
    extra = corpus / "calm" / "samples" / "day2.csv"
    try:
        extra.write_text((corpus / "calm" / "samples" / "day1.csv").read_text())
        with pytest.raises(ContractError, match="day2.csv: on disk but not pinned"):
            manifest.verify_manifest(spark, str(corpus), "calm")
    finally:
        extra.unlink()
    for bad in ("none", "../calm"):
        with pytest.raises(ContractError):
            manifest.load_manifest(spark, str(corpus), bad)


def test_replay(service):
    got = replay(service, 42, adversarial_client=None)
    assert (got["scenarios"], got["first_pass_rate"], got["healed_rate"], got["mean_iterations"]) == ("3 / 3", "1 / 3", "1 / 1", "2.00")
    assert got["checkpoints"] == str(8 + 10 + 11) and got["tool_calls"] == 9 and got["escalated"] == "short"
    assert got["errors"] == {"H1_runtime": 0, "H2_schema": 0, "H3_completeness": 3, "H4_drift": 1, "H5_latency": 0, "H6_dag_contract": 0}
    assert service.published() == ["calm", "flipped"]


def test_ledger_views(service):
    runs = service.list_runs()
    assert len(runs) == 3 and not service.ledger.active()
    healed = new_run_id("flipped", 42)
    run = service.get_run(healed)
    assert [i["passed"] for i in run["iteration_list"]] == [False, True] and run["iteration_list"][0]["errors"][0]["check"] == "H4_drift"
    nodes = [h["node"] for h in service.history(healed)]
    assert nodes == ["__start__", "__start__", "load_spec", "plan", "generate", "evaluate", "generate", "evaluate", "await_approval", "publish"]
    assert service.state_at(healed, 2)["tool_calls"][0] == "list_samples"
    assert ("contract.columns[3].sign_column", "null", '"Side"') in service.ledger.diff(healed, 2) and service.ledger.diff(healed, 1) == []
    assert "+" in service.ledger.text_diff(healed, 2)
    approval = json.loads((service.deploy / "flipped" / "approval.json").read_text())
    assert set(approval["sha256"]) == {"plan.json", "mapping.yaml", "dag.json"}
    with pytest.raises(InvalidTransition):
        service.decide(healed, {"decision": "reject", "approver": "x"})
    with pytest.raises(FeedError):
        service.ledger.create({"run_id": healed, "client": "flipped", "provider": "p", "status": "planning"})
    with pytest.raises(FeedError):
        service.ledger.update(healed, run_id="other")
    for call in (lambda: service.get_run("nope"), lambda: service.state_at(healed, 99), lambda: service.ledger.load_iteration(healed, 9)):
        with pytest.raises(RunNotFound):
            call()


def test_adversarial_plans_are_caught(spark, corpus, service):
    from sluice.plans.plan import compile_plan
    from sluice.service import evaluate
    from sluice.sources import files

    root = str(corpus)
    spec, pins, paths = files.load_contract(spark, root, "calm"), manifest.load_manifest(spark, root, "calm"), files.sample_paths(spark, root, "calm")
    for name in manifest.ADVERSARIAL:
        plan, must_fail = manifest.adversarial_plan(name, compile_plan(spec))
        budget = 5000 if name == "sleeps_past_budget" else 600_000
        found = evaluate(spark, plan, spec, pins, paths, latency_budget_ms=budget)[0].filter("severity = 'error'").collect()
        failed = {f.check for f in found}
        assert set(must_fail) <= failed, name


def test_routes_and_decisions():
    assert [route(True, 1, 3), route(False, 1, 3), route(False, 3, 3)] == ["await_approval", "generate", "escalate"]
    assert decision_of({"decision": "approve", "approver": "me"}) == ("approve", "me", "")
    for bad in ({"decision": "maybe", "approver": "me"}, {"decision": "approve", "approver": " "}, None):
        with pytest.raises(FeedError):
            decision_of(bad)
    assert new_run_id("a", 1) == new_run_id("a", 1) != new_run_id("a", 2) and new_run_id("a") != new_run_id("a")


def test_guard():
    assert guard.scan("import csv, json\nfrom datetime import date\nopen('x')\nopen('x', 'r')\n'a'.replace('a', 'b')\n") == []
    for bad in ("import os", "from os import path", "from . import x", "open('x', 'a')", "open('x', mode=m)", "eval('1')", "p.unlink()", "x.__dict__", "__builtins__", "def"):
        assert guard.scan(bad), bad
    assert guard.scan("from pipeline import x\nimport airflow\n", guard.DAG_MODULES) == []


def test_streaming_arrivals(spark, corpus, tmp_path):
    from sluice.plans.plan import compile_plan
    from sluice.sources import files
    from sluice.streaming.arrivals import ingest, node_counts

    folder = tmp_path / "in"
    folder.mkdir()
    text = (corpus / "calm" / "samples" / "day1.csv").read_text()
    plan = compile_plan(files.load_contract(spark, str(corpus), "calm"))
    go = lambda: ingest(spark, str(folder), plan, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (folder / "a.csv").write_text(text)
    go()
    (folder / "b.csv").write_text(text.replace("05/09/2026", "99/09/2026"))
    go()
    go()
    assert spark.read.parquet(str(tmp_path / "out/rows")).groupBy("sample").count().orderBy("sample").collect() == [("a.csv", 14), ("b.csv", 13)]
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 1
    assert [r.check for r in spark.read.parquet(str(tmp_path / "out/findings")).collect()] == ["H1_runtime"]

    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "1.json").write_text("\n".join(json.dumps({"ts": f"2026-01-01T0{h}:10:00Z", "node": n}) for h, n in ((1, "plan"), (1, "plan"), (9, "load"))))
    q = node_counts(spark, str(tmp_path / "ev")).writeStream.format("memory").queryName("nodes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.node, r.n) for r in spark.table("nodes").collect()] == [("plan", 2)]


def test_command_line(spark, corpus, tmp_path):
    from sluice import cli

    args = cli.parser().parse_args(["--corpus", str(corpus), "--ledger", str(tmp_path / "l"), "--deploy", str(tmp_path / "d"), "verify"])
    assert cli.run(args, spark) == "all manifests hold"
    args = cli.parser().parse_args(["--ledger", str(tmp_path / "l"), "runs", "--json"])
    assert cli.run(args, spark) == []
    args = cli.parser().parse_args(["--ledger", str(tmp_path / "l"), "runs"])
    assert cli.run(args, spark).startswith("run_id  client")


def test_rendering(tmp_path):
    from sluice.operators import reports

    figures = {"b": 1, "a": "é", "nested": {"x": 1}}
    reports.write_headline(figures, str(tmp_path / "h.json"))
    assert (tmp_path / "h.json").read_bytes() == reports.headline_text(dict(reversed(figures.items()))).encode("ascii")
    document = f"top\n{reports.BEGIN}\nold\n{reports.END}\nend\n"
    new = reports.spliced(document, figures)
    assert not reports.is_current(document, figures) and reports.is_current(new, figures) and new.endswith("\nend\n") and "| b | 1 |" in new
    assert reports.shown(list("abcde")) == ["a", "b", "c", "+2 more"] and reports.shown(["a"]) == ["a"]


def test_user_transforms_are_guarded(spark):
    from sluice.errors import PlanError
    from sluice.operators.custom import apply_transform

    rows = spark.createDataFrame([("1",), ("2",)], "a string")
    got = apply_transform(rows, "def transform(rows):\n    return [{'trade_id': r['a'], 'amount': None} for r in rows]\n").collect()
    assert sorted((r.trade_id, r.amount, r.currency) for r in got) == [("1", "", ""), ("2", "", "")]
    for bad in ("import os\ndef transform(rows):\n    return rows\n", "x = 1\n"):
        with pytest.raises(PlanError):
            apply_transform(rows, bad)


def test_output_reader(spark, tmp_path):
    from sluice.sources import files

    (tmp_path / "good.json").write_text('[{"trade_id": "1"}]')
    (tmp_path / "bad.json").write_text("not json")
    rows = files.read_output(spark, str(tmp_path), "trade_id string").collect()
    assert sorted((r.trade_id or "", r._corrupt or "") for r in rows) == [("", "not json"), ("1", "")]
