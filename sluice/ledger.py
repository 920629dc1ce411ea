"""Run ledger: append-only Parquet tables; what is current is the last version of a key.

One writer at a time. An update is a further row with a higher version; readers take the
last by an aggregation. Uniqueness of a run id is looked up before its first row.
"""

from __future__ import annotations

import difflib
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FeedError, RunNotFound
from .operators.reports import stored_errors
from .operators.tables import lagged, latest, newest
from .plans.plan import IngestionPlan, mapping_document, plan_diff
from .schemas import CHECKPOINTS, ITERATIONS, RUNS, STATES, TERMINAL

FIXED = {"run_id", "created_at", "version"}


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Ledger:
    """Tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, name: str, schema: str, rows: list[dict]) -> None:
        names = [x.strip().split(" ")[0] for x in _split(schema)]
        frame = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    # --- runs ---

    def runs(self) -> DataFrame:
        """Every run's current row."""
        return latest(self._read("runs", RUNS), ["run_id"], ["version"])

    def create(self, run: dict) -> None:
        if not self.runs().filter(F.col("run_id") == run["run_id"]).isEmpty():
            raise FeedError(f"run {run['run_id']} exists already")
        at = now()
        self._append("runs", RUNS, [{"iterations": 0, "artifact_dir": "", "created_at": at, "updated_at": at} | run | {"version": time.time_ns()}])

    def get(self, run_id: str) -> dict:
        row = self.runs().filter(F.col("run_id") == run_id).first()
        if row is None:
            raise RunNotFound(f"no run {run_id!r}")
        return row.asDict()

    def update(self, run_id: str, /, **changes) -> dict:
        known = set(self.runs().columns)
        if wrong := (set(changes) & FIXED) | (set(changes) - known):
            raise FeedError(f"cannot update {sorted(wrong)}")
        if "status" in changes and changes["status"] not in STATES:
            raise FeedError(f"unknown status {changes['status']!r}")
        row = self.get(run_id) | changes | {"updated_at": now(), "version": time.time_ns()}
        self._append("runs", RUNS, [row])
        return row

    def list(self, limit: int = 50) -> DataFrame:
        """The newest runs, ties by id."""
        return newest(self.runs(), "created_at", "run_id", limit)

    def active(self) -> bool:
        """Whether any run goes on."""
        return not self.runs().filter(~F.col("status").isin(*TERMINAL)).isEmpty()

    # --- iterations ---

    def iterations(self) -> DataFrame:
        return latest(self._read("iterations", ITERATIONS), ["run_id", "iteration"], ["version"])

    def save_iteration(self, row: dict) -> None:
        """Insert or replace one iteration."""
        self.save_iterations([row])

    def save_iterations(self, rows: list[dict]) -> None:
        """Insert or replace iterations; of equal ones the last counts."""
        at = time.time_ns()
        self._append("iterations", ITERATIONS, [row | {"version": at + i} for i, row in enumerate(rows)])

    def iteration_summaries(self, run_id: str) -> DataFrame:
        """iteration, passed (NULL: never evaluated), wall_ms and the error findings, in order."""
        rows = self.iterations().filter(F.col("run_id") == run_id)
        return rows.select("iteration", "passed", "wall_ms", stored_errors(F.col("report_json")).alias("errors")).orderBy("iteration")

    def load_iteration(self, run_id: str, iteration: int) -> dict:
        row = self.iterations().filter((F.col("run_id") == run_id) & (F.col("iteration") == iteration)).first()
        if row is None:
            raise RunNotFound(f"run {run_id!r} has no iteration {iteration}")
        return row.asDict()

    def diff(self, run_id: str, iteration: int) -> list[tuple[str, str, str]]:
        """(field, old, new) of an iteration's plan against the one before; nothing for the first."""
        if iteration <= 1:
            return []
        before, after = (IngestionPlan.from_json(self.load_iteration(run_id, i)["plan_json"]) for i in (iteration - 1, iteration))
        return plan_diff(before, after)

    def text_diff(self, run_id: str, iteration: int) -> str:
        """The same as a unified diff of the mapping documents."""
        if iteration <= 1:
            return ""
        a, b = (mapping_document(IngestionPlan.from_json(self.load_iteration(run_id, i)["plan_json"])).splitlines(keepends=True) for i in (iteration - 1, iteration))
        return "".join(difflib.unified_diff(a, b, f"iter-{iteration - 1}/mapping.yaml", f"iter-{iteration}/mapping.yaml"))

    # --- checkpoints ---

    def checkpoint(self, rows: list[dict]) -> None:
        self._append("checkpoints", CHECKPOINTS, rows)

    def checkpoints(self) -> DataFrame:
        return self._read("checkpoints", CHECKPOINTS)

    def history(self, run_id: str) -> DataFrame:
        """Steps, oldest first; a step's node is what the step before had next."""
        steps = self.checkpoints().filter(F.col("run_id") == run_id).withColumn("next0", F.get("next", F.lit(0)))
        return lagged(steps, ["run_id"], ["step"], "next0", "node", "__start__").drop("next0", "state").orderBy("step")

    def state_at(self, run_id: str, step: int) -> str:
        row = self.checkpoints().filter((F.col("run_id") == run_id) & (F.col("step") == step)).first()
        if row is None:
            raise RunNotFound(f"run {run_id!r} has no step {step}")
        return row.state


def _split(schema: str) -> list[str]:
    """Fields of a DDL schema."""
    out, depth, one = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(one)
            one = ""
        else:
            one += ch
    return [*out, one]
