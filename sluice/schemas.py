"""Schemas and fixed names shared by all modules."""

from __future__ import annotations

#: The canonical columns, in order.
CANONICAL = ("trade_id", "account_id", "value_date", "amount", "currency", "counterparty", "description")

#: Check names, in order.
H1, H2, H3, H4, H5, H6 = CHECKS = (
    "H1_runtime", "H2_schema", "H3_completeness", "H4_drift", "H5_latency", "H6_dag_contract",
)

ROWS = "client string, sample string, idx long, " + ", ".join(f"{c} string" for c in CANONICAL) + ", error string"
FINDINGS = "client string, sample string, iteration int, check string, severity string, message string, evidence map<string,string>"
PROFILE = "client string, name string, sha256 string, bytes long, expected_rows long, amount_sum string, null_rate map<string,double>, distinct map<string,long>"
RUNS = (
    "run_id string, client string, provider string, status string, iterations int, max_iterations int, created_at timestamp, "
    "updated_at timestamp, approved_by string, decision_note string, final_passed boolean, artifact_dir string, version long"
)
ITERATIONS = "run_id string, iteration int, passed boolean, wall_ms long, rows_emitted long, report_json string, plan_json string, version long"
CHECKPOINTS = "run_id string, step int, node string, next array<string>, status string, iteration int, state string, created_at timestamp"
EVENTS = "ts string, node string, run_id string, detail map<string,string>"

#: Run states; the last four end a run.
STATES = ("planning", "generating", "evaluating", "awaiting_approval", "approved", "rejected", "escalated", "failed")
TERMINAL = frozenset(STATES[4:])
