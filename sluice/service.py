"""Runs: plan, evaluate, repair, until the checks pass or the budget ends; then a human decides."""

from __future__ import annotations

import hashlib
import json
import secrets
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FeedError, InvalidTransition
from .ledger import Ledger, now
from .operators import checks, guard, manifest, metrics
from .operators.custom import Declarative, Provider
from .operators.transform import read_rows
from .plans.contract import FeedContract
from .plans.plan import IngestionPlan, compile_plan, dag, inject, mapping_document
from .sources import files


def new_run_id(client: str, seed: int | None = None) -> str:
    """client-time-6 hex; a seed makes it the same each time."""
    if seed is not None:
        return f"{client}-{'0' * 14}-{hashlib.sha256(f'{client}:{seed}'.encode()).hexdigest()[:6]}"
    return f"{client}-{datetime.now(UTC):%Y%m%d%H%M%S}-{secrets.token_hex(3)}"


def route(passed: bool, iteration: int, most: int) -> str:
    """What follows an evaluation."""
    return "await_approval" if passed else "generate" if iteration < most else "escalate"


def decision_of(payload) -> tuple[str, str, str]:
    """(decision, approver, note) of a valid decision."""
    if not isinstance(payload, dict) or payload.get("decision") not in ("approve", "reject"):
        raise FeedError("a decision is approve or reject")
    if not str(payload.get("approver") or "").strip():
        raise FeedError("a decision needs an approver")
    return payload["decision"], payload["approver"], payload.get("note") or ""


#: So many files are timed one after another, each by a job of its own; more of them in one scan.
SERIAL_FILES = 16


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[threading.Event]:
    """Cancels the jobs of this thread that run longer; the event tells whether that happened."""
    tag, late = f"evaluate-{secrets.token_hex(6)}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield late
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def timed_rows(spark: SparkSession, plan: IngestionPlan, paths: list[str], iteration: int) -> list[tuple[DataFrame | None, int, int]]:
    """Each file's rows, kept for the checks, how many there are, and milliseconds: those that reading it took, and a declared delay.
    Of many files, which are read in one scan, the first has the rows of all."""

    def one(path: str) -> tuple[DataFrame, int, int]:
        began = time.monotonic()
        rows = read_rows(spark, [path], plan, strict=False).withColumn("iteration", F.lit(iteration)).persist()
        n = rows.count()
        return rows, n, int((time.monotonic() - began) * 1000) + plan.delay_ms

    if len(paths) <= SERIAL_FILES:
        return [one(p) for p in paths]
    rows, found = scan_times(spark, read_rows_a_file(spark, plan, paths, iteration))
    some = (found.get(p.rsplit("/", 1)[-1], (0, 0)) for p in paths)
    return [(rows if i == 0 else None, n, ms + plan.delay_ms) for i, (n, ms) in enumerate(some)]


def read_rows_a_file(spark: SparkSession, plan: IngestionPlan, paths: list[str], iteration: int) -> DataFrame:
    """The rows of many files as one scan for each header that they have."""
    return read_rows(spark, paths, plan, strict=False).withColumn("iteration", F.lit(iteration))


def scan_times(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """The rows, kept, and by sample how many there are and how many milliseconds tasks took over them: one job.

    Each file has tasks of its own, whose times Spark's status store has. Where a task holds rows of several files (as
    after a shuffle), its time is shared out by rows. A file without rows has no entry.
    """
    rows, tag = rows.persist(), f"times-{secrets.token_hex(6)}"
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        with files.partition_a_file(spark):
            counts = rows.groupBy(F.spark_partition_id().alias("p"), "sample").agg(F.count("*").alias("n")).collect()  # a row a file and task
    finally:
        context.removeJobTag(tag)
    took = _task_times(spark, tag)
    held: dict[int, int] = {}
    for r in counts:
        held[r.p] = held.get(r.p, 0) + r.n
    out: dict[str, tuple[int, float]] = {}
    for r in counts:
        n, ms = out.get(r.sample, (0, 0.0))
        out[r.sample] = (n + r.n, ms + took.get(r.p, 0) * r.n / held[r.p])
    return rows, {s: (n, round(ms)) for s, (n, ms) in out.items()}


def _task_times(spark: SparkSession, tag: str) -> dict[int, int]:
    """Run times (ms) by partition of the longest stage of the jobs with a tag: the one that reads."""
    scala = spark.sparkContext._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    tracker, store, best = scala.statusTracker(), scala.statusStore(), {}
    for job in tracker.getJobIdsForTag(tag):
        for stage in tracker.getJobInfo(job).get().stageIds():
            took: dict[int, int] = {}
            tasks = store.taskList(stage, 0, 1 << 30).iterator()
            while tasks.hasNext():
                t = tasks.next()
                if t.taskMetrics().isDefined():
                    took[t.index()] = took.get(t.index(), 0) + t.taskMetrics().get().executorRunTime()
            if sum(took.values()) > sum(best.values()):
                best = took
    return best


def evaluate(
    spark: SparkSession, plan: IngestionPlan, contract: FeedContract, pinned: dict, paths: list[str], iteration: int = 1,
    latency_budget_ms: int = checks.LATENCY_BUDGET_MS, tolerance: float = checks.NULL_TOLERANCE, timeout_s: float = checks.TIMEOUT_S,
) -> tuple[DataFrame, int, int]:
    """Findings of a plan on some files, rows emitted and milliseconds.

    Code with guard findings is not run: those are all that is found. Each file is read once, timed by itself, and
    kept for the checks; a declared delay counts as time. Where reading or checking goes on beyond `timeout_s`, its
    jobs are cancelled; that, or a file that takes longer by its delay, is a finding of H1.
    """
    names = [p.rsplit("/", 1)[-1] for p in paths]

    def failed(messages: list[tuple[str, str, dict]]) -> DataFrame:
        return spark.createDataFrame([(contract.client, sample, iteration, checks.H1, "error", m, proof) for sample, m, proof in messages], checks.FINDINGS)

    if plan.source_code and (bad := guard.scan(plan.source_code)):
        return failed([("", f["message"], {"line": str(f["line"])}) for f in bad]), 0, 0
    began, read = time.monotonic(), []
    with time_limit(spark, timeout_s * max(1, len(paths))) as late:
        try:
            read = timed_rows(spark, plan, paths, iteration)
            canonical = reduce(DataFrame.unionByName, (rows for rows, _, _ in read if rows is not None))
            times = [(contract.client, n, iteration, ms) for n, (_, _, ms) in zip(names, read)]
            found = checks.evaluate_rows(canonical, manifest.pins(spark, pinned), tolerance)
            d = dag(plan)
            dags = spark.createDataFrame(
                [(contract.client, names[0], iteration, d["dag_id"], d["schedule"], d["tasks"], d["edges"], f"{contract.client}__{contract.feed_name}", contract.schedule_cron)],
                "client string, sample string, iteration int, dag_id string, schedule string, tasks array<string>, edges array<array<string>>, expected_id string, expected_schedule string",
            )
            timed = spark.createDataFrame(times, "client string, sample string, iteration int, wall_ms long")
            everything = found.unionByName(checks.check_latency(timed, latency_budget_ms)).unionByName(checks.check_dag(dags))
            collected = everything.collect()  # a few rows per sample and measure
        except Exception:
            if not late.is_set():
                raise
            wall = int((time.monotonic() - began) * 1000)
            return failed([("", f"timed out: more than {timeout_s:g} s a file", {"wall_ms": str(wall)})]), 0, wall
        finally:
            for rows, _, _ in read:
                if rows is not None:
                    rows.unpersist()
    over = [(n, f"{n}: timed out after {timeout_s:g} s", {"wall_ms": str(ms)}) for _, n, _, ms in times if ms > 1000 * timeout_s]
    out = spark.createDataFrame(collected, checks.FINDINGS)
    return out.unionByName(failed(over)) if over else out, sum(n for _, n, _ in read), sum(ms for _, _, ms in read)


class RunService:
    """Starts, decides and shows runs over a corpus folder; publishes to a local folder."""

    def __init__(self, spark: SparkSession, corpus: str, ledger: str, deploy: str, latency_budget_ms: int = checks.LATENCY_BUDGET_MS, provider: Provider | None = None):
        self.spark, self.corpus, self.deploy = spark, corpus.rstrip("/"), Path(deploy)
        self.ledger, self.latency_budget_ms = Ledger(spark, ledger), latency_budget_ms
        self.provider: Provider = provider or Declarative()

    def collect_evidence(self, client: str) -> tuple[str, ...]:
        """Looks at the first sample as a planner does; the names of the calls made."""
        paths = files.sample_paths(self.spark, self.corpus, client)
        if not paths:
            raise FeedError(f"{client}: no samples")
        files.peek(files.read_texts(self.spark, paths[0])).collect()
        manifest.pinned_profile(manifest.load_manifest(self.spark, self.corpus, client), paths[0].rsplit("/", 1)[-1])
        return ("list_samples", "peek_sample", "profile_sample")

    def start_run(self, client: str, seed: int | None = None, max_iterations: int = 3) -> dict:
        """Runs until a human is asked or the budget ends; the run's row."""
        contract = files.load_contract(self.spark, self.corpus, client)
        pinned = manifest.load_manifest(self.spark, self.corpus, client)
        run_id = new_run_id(client, seed)
        self.ledger.create({"run_id": run_id, "client": client, "provider": self.provider.name, "status": "planning", "max_iterations": max_iterations})
        steps: list[dict] = []

        def step(node: str, following: list[str], status: str, iteration: int, state: dict) -> None:
            steps.append({"run_id": run_id, "step": len(steps) - 1, "node": node, "next": following, "status": status, "iteration": iteration, "state": json.dumps(state, sort_keys=True), "created_at": now()})

        step("__input__", ["__start__"], "planning", 0, {})
        step("__start__", ["load_spec"], "planning", 0, {"client": client})
        try:
            step("load_spec", ["plan"], "planning", 0, {"feed": contract.feed_name})
            sound = self.provider.plan(contract, self.collect_evidence(client))
            step("plan", ["generate"], "generating", 0, {"tool_calls": list(sound.tool_calls)})
            defect = (pinned["scenario"] or {}).get("injected_defect")
            paths = files.sample_paths(self.spark, self.corpus, client)
            iteration, following, plan, rows = 0, "generate", sound, []
            while following == "generate":
                iteration += 1
                if iteration > 1:
                    plan = self.provider.repair(sound, [r for r in rows if r["severity"] == "error"])
                elif defect:
                    plan = inject(sound, defect)
                step("generate", ["evaluate"], "evaluating", iteration, {"iteration": iteration})
                found, emitted, wall = evaluate(self.spark, plan, contract, pinned, paths, iteration, self.latency_budget_ms)
                rows = [r.asDict(recursive=True) for r in found.collect()]
                passed = not any(r["severity"] == "error" for r in rows)
                self.ledger.save_iteration({"run_id": run_id, "iteration": iteration, "passed": passed, "wall_ms": wall, "rows_emitted": emitted, "report_json": json.dumps(rows), "plan_json": plan.to_json()})
                following = route(passed, iteration, max_iterations)
                step("evaluate", [following], "evaluating", iteration, {"passed": passed})
            if following == "escalate":
                step("escalate", [], "escalated", iteration, {"reason": "the checks never passed"})
            else:
                step("await_approval", ["publish"], "awaiting_approval", iteration, {"passed": True})
            status = "escalated" if following == "escalate" else "awaiting_approval"
            self.ledger.checkpoint(steps)
            return self.ledger.update(run_id, status=status, iterations=iteration, final_passed=passed)
        except Exception:
            self.ledger.checkpoint(steps)
            self.ledger.update(run_id, status="failed")
            raise

    def decide(self, run_id: str, payload: dict) -> dict:
        """Approves (and publishes) or rejects a run that waits for it; any process may do that."""
        decision, approver, note = decision_of(payload)
        run = self.ledger.get(run_id)
        if run["status"] != "awaiting_approval":
            raise InvalidTransition(f"run {run_id} is {run['status']}")
        node = "publish" if decision == "approve" else "record_rejection"
        last = self.ledger.history(run_id).agg(F.max("step")).first()[0]
        status = "approved" if decision == "approve" else "rejected"
        where = self.publish(run, approver, note) if decision == "approve" else ""
        self.ledger.checkpoint([{"run_id": run_id, "step": last + 1, "node": node, "next": [], "status": status, "iteration": run["iterations"], "state": json.dumps({"decision": decision}), "created_at": now()}])
        return self.ledger.update(run_id, status=status, approved_by=approver, decision_note=note, artifact_dir=where)

    def publish(self, run: dict, approver: str, note: str) -> str:
        """Writes the plan, its mapping and graph, and an approval with their digests."""
        plan = IngestionPlan.from_json(self.ledger.load_iteration(run["run_id"], run["iterations"])["plan_json"])
        folder = self.deploy / files.safe_name(run["client"])
        folder.mkdir(parents=True, exist_ok=True)
        made = {"plan.json": plan.to_json(), "mapping.yaml": mapping_document(plan), "dag.json": json.dumps(dag(plan), indent=2)}
        digests = {}
        for name, text in made.items():
            (folder / name).write_text(text, encoding="utf-8", newline="\n")
            digests[name] = hashlib.sha256(text.encode()).hexdigest()
        approval = {"run_id": run["run_id"], "client": run["client"], "approver": approver, "note": note, "approved_at": now().isoformat(), "iteration": run["iterations"], "sha256": digests}
        (folder / "approval.json").write_text(json.dumps(approval, indent=2) + "\n", encoding="utf-8", newline="\n")
        return str(folder)

    def published(self) -> list[str]:
        """Clients with an approval."""
        return sorted(p.parent.name for p in self.deploy.glob("*/approval.json"))

    def get_run(self, run_id: str) -> dict:
        """A run's row with its iterations."""
        return self.ledger.get(run_id) | {"iteration_list": [r.asDict(recursive=True) for r in self.ledger.iteration_summaries(run_id).collect()]}

    def list_runs(self, limit: int = 50) -> list[dict]:
        return [r.asDict() for r in self.ledger.list(max(1, min(limit, 500))).collect()]

    def history(self, run_id: str) -> list[dict]:
        self.ledger.get(run_id)
        return [r.asDict() for r in self.ledger.history(run_id).collect()]

    def state_at(self, run_id: str, step: int) -> dict:
        return json.loads(self.ledger.state_at(run_id, step))


def replay(service: RunService, seed: int = 42, clients: list[str] | None = None, adversarial_client: str | None = None) -> dict:
    """Runs every client, approves what passes, puts the adversarial plans to the checks, and reduces it all."""
    spark, found, runs, cases = service.spark, [], [], []
    for client in clients or files.list_clients(spark, service.corpus):
        run = service.start_run(client, seed)
        if run["status"] == "awaiting_approval":
            run = service.decide(run["run_id"], {"decision": "approve", "approver": "replay"})
        pinned = manifest.load_manifest(spark, service.corpus, client)
        tools = service.state_at(run["run_id"], 2)["tool_calls"]
        runs.append((run["run_id"], client, run["status"], run["iterations"], pinned["scenario"]["expected_outcome"], tools))
    wrong = manifest.adversarial_cases(spark, service.corpus)
    if adversarial_client and not wrong:
        wrong = [{"name": n, "against_client": adversarial_client, "must_fail": list(must), "pipeline": ""} for n, (_, must) in manifest.ADVERSARIAL.items()]
    for case in wrong:
        client, name = case["against_client"], case["name"]
        contract, pinned = files.load_contract(spark, service.corpus, client), manifest.load_manifest(spark, service.corpus, client)
        plan = manifest.plan_of_case(case, compile_plan(contract))
        rows = [r for r in evaluate(spark, plan, contract, pinned, files.sample_paths(spark, service.corpus, client), 1, service.latency_budget_ms)[0].collect() if r.severity == "error"]
        cases.append((name, case["must_fail"], sorted({r.check for r in rows})))
        found += [(name, r.check, r.severity) for r in rows]
    ids = [r[0] for r in runs]
    iterations = service.ledger.iterations().filter(F.col("run_id").isin(ids))
    reported = iterations.select("run_id", F.explode(F.from_json("report_json", "array<struct<check:string,severity:string>>")).alias("f")).select(F.col("run_id").alias("source"), "f.check", "f.severity")
    findings = reported.unionByName(spark.createDataFrame(found, "source string, check string, severity string"))
    return metrics.headline(
        spark.createDataFrame(runs, "run_id string, client string, status string, iterations int, expected string, tool_calls array<string>"),
        iterations, findings, spark.createDataFrame(cases, "name string, must_fail array<string>, failed array<string>"),
        service.ledger.checkpoints().filter(F.col("run_id").isin(ids)), checks.checks_frame(spark),
    )
