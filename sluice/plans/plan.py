"""Ingestion plans: what is done with a feed, as data. Defects are edits of a plan."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from ..errors import PlanError
from .contract import ColumnSpec, FeedContract, contract_of, slice_of

#: The tasks of a feed and their order.
TASKS = ("extract", "transform", "load")
EDGES = (("extract", "transform"), ("transform", "load"))

#: Names of the defects.
DEFECTS = (
    "date_format_swapped", "trailer_not_skipped", "wrong_slice", "amount_sign_dropped",
    "thousands_separator_kept", "dag_missing_dependency",
)


@dataclass(frozen=True)
class IngestionPlan:
    """A contract, and how far the plan departs from it."""

    contract: FeedContract
    edges: tuple[tuple[str, str], ...] = EDGES
    strip_thousands: bool = True
    drop_last_row: bool = False
    raw_amounts: bool = False
    delay_ms: int = 0
    source_code: str = ""
    notes: str = ""
    tool_calls: tuple[str, ...] = ()
    validations: tuple[str, ...] = field(default=())

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> IngestionPlan:
        d = json.loads(text)
        return cls(
            **d | {
                "contract": contract_of(d["contract"]), "edges": tuple(map(tuple, d["edges"])),
                "tool_calls": tuple(d["tool_calls"]), "validations": tuple(d["validations"]),
            }
        )


def compile_plan(spec: FeedContract, tool_calls: tuple[str, ...] = ()) -> IngestionPlan:
    """The plan that does what the contract says."""
    rules = ["every row has the canonical columns, in order", "amounts are signed with two decimals", "currencies are three capitals"]
    if spec.expected_row_count is not None:
        rules.append(f"each file yields {spec.expected_row_count} rows")
    if spec.trailer_rows:
        rules.append(f"the last {spec.trailer_rows} line(s) are no data")
    return IngestionPlan(spec, tool_calls=tool_calls, validations=tuple(rules))


def dag(plan: IngestionPlan) -> dict:
    """The plan's task graph."""
    return {
        "dag_id": f"{plan.contract.client}__{plan.contract.feed_name}", "schedule": plan.contract.schedule_cron,
        "tasks": list(TASKS), "edges": [list(e) for e in plan.edges],
    }


def _columns(plan: IngestionPlan, pick, change) -> IngestionPlan:
    """The plan with the first column that `pick` takes changed; unchanged if there is none."""
    cols = list(plan.contract.columns)
    for i, c in enumerate(cols):
        if pick(c):
            cols[i] = change(c)
            return replace(plan, contract=replace(plan.contract, columns=tuple(cols)))
    return plan


def _swapped(fmt: str) -> str:
    return "%".join({"d": "m", "m": "d"}.get(x[:1], x[:1]) + x[1:] if i else x for i, x in enumerate(fmt.split("%")))


def _shifted(c: ColumnSpec) -> ColumnSpec:
    a, b = slice_of(c.source)
    return replace(c, source=f"{a - 1}:{b - 1}")


def inject(plan: IngestionPlan, defect: str) -> IngestionPlan:
    """The plan with a named defect; an unknown one, or one that changes nothing, is an error."""
    fixed = plan.contract.format == "fixed_width"
    if defect == "date_format_swapped":
        out = _columns(plan, lambda c: c.date_format, lambda c: replace(c, date_format=_swapped(c.date_format)))
    elif defect == "trailer_not_skipped":
        out = replace(plan, contract=replace(plan.contract, trailer_rows=0))
    elif defect == "wrong_slice":
        out = plan
        if fixed:
            named = any(c.target == "currency" for c in plan.contract.columns)
            out = _columns(plan, lambda c: (c.target == "currency" or not named) and slice_of(c.source)[0] > 0, _shifted)
    elif defect == "amount_sign_dropped":
        out = _columns(plan, lambda c: c.sign_column, lambda c: replace(c, sign_column=None, negative_marker=None))
    elif defect == "thousands_separator_kept":
        out = replace(plan, strip_thousands=False)
    elif defect == "dag_missing_dependency":
        out = replace(plan, edges=plan.edges[:1])
    else:
        raise PlanError(f"unknown defect {defect!r}")
    if out == plan:
        raise PlanError(f"{defect} doesn't apply to {plan.contract.client}")
    return out


def plan_diff(before: IngestionPlan, after: IngestionPlan) -> list[tuple[str, str, str]]:
    """(field, old, new) of every field that differs."""

    def flat(x, path=""):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from flat(v, f"{path}.{k}" if path else k)
        elif isinstance(x, (list, tuple)):
            for i, v in enumerate(x):
                yield from flat(v, f"{path}[{i}]")
        else:
            yield path, json.dumps(x)

    a, b = dict(flat(asdict(before))), dict(flat(asdict(after)))
    return [(k, a.get(k, ""), b.get(k, "")) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)]


def _note(c: ColumnSpec) -> str | None:
    parts = []
    if c.dtype == "date":
        parts.append(f"date in {c.date_format}, written YYYY-MM-DD")
    if c.dtype == "decimal":
        parts.append("without thousands separators, rounded half up to 2 places")
        if c.sign_column:
            parts.append(f"negative if {c.sign_column} is {c.negative_marker}")
    if c.dtype == "int":
        parts.append("whole number")
    if c.target == "currency":
        parts.append("upper case")
    if c.default is not None:
        parts.append(f"{c.default} if empty")
    return "; ".join(parts) or None


def mapping_document(plan: IngestionPlan) -> str:
    """The field mapping as YAML."""
    q = json.dumps
    lines = [f"client: {q(plan.contract.client)}", f"feed: {q(plan.contract.feed_name)}", f"format: {q(plan.contract.format)}", "fields:"]
    for c in plan.contract.columns:
        lines += [f"- source: {q(c.source)}", f"  target: {q(c.target)}", f"  dtype: {q(c.dtype)}"]
        if note := _note(c):
            lines.append(f"  transform: {q(note, ensure_ascii=False)}")
    return "\n".join(lines) + "\n"
