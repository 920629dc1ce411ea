"""User transforms: Python text that defines transform(rows), guarded.

The text is scanned on the driver; with a finding it isn't sent anywhere. Workers run it in
child processes with the guard's own builtins (`jail`), which hold whatever the guard missed. Rows are dicts of text, in
and out. A transform gets all rows of one file at once, in their order, where the rows say which
file they are of: what it remembers from row to row doesn't depend on batches. Without that, rows
are taken as independent and come batch by batch.

Files are sorted together by their tasks and go to the jail a batch of them at a time, whose code may leave nothing behind; a file is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..plans.contract import FeedContract
from ..plans.plan import IngestionPlan, compile_plan
from ..schemas import CANONICAL, FINDINGS, H1
from . import guard, jail

MODULE = "transform"
#: Rows of a batch that comes out, if not of more than a file.
OUT_ROWS = 10_000
#: Types by which Spark tells files apart and orders rows as Python does.
_KEYS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def _checked(source: str) -> str:
    if found := guard.scan(source):
        raise PlanError("; ".join(f["message"] for f in found))
    if f"def {MODULE}(" not in source:
        raise PlanError(f"the source defines no {MODULE}(rows)")
    return source


def _made(source: str, frame: pd.DataFrame, limits: jail.Limits) -> pd.DataFrame:
    rows = jail.run(source, MODULE, frame.to_dict("records"), limits=limits)
    return pd.DataFrame(rows, columns=list(CANONICAL)).fillna("").astype(str)


def _plain(rows: DataFrame, by: str, order: str | None) -> bool:
    """Whether rows are text, and files and their order go by keys, that need no data frames of their own."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    seen = [c for c in kinds if c not in (by, order)]
    keys = [c for c in (by, order) if c is not None]
    text = T.StringType()
    return bool(seen) and len(kinds) == len(rows.columns) and all(kinds[c] == text for c in seen) and all(c in kinds and (kinds[c] == text or isinstance(kinds[c], _KEYS)) for c in keys)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[object, list[dict]]]]:
    """The files (key, rows) that end in each batch of sorted rows, whose first column is the key."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, names = batch.column(0).to_pylist(), batch.schema.names[1:]
        rows = [dict(zip(names, r)) for r in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        out = []
        for s, e in zip(edges, edges[1:]):
            if held and keys[s] != key:
                out.append((key, held))
                held = []
            key = keys[s]
            held.extend(rows[s:e])
        if out:
            yield out
    if held:
        yield [(key, held)]


def _by_file(rows: DataFrame, source: str, by: str, order: str | None, limits: jail.Limits, schema: str, caught: bool) -> DataFrame:
    """The transform of plain rows by file; caught: a file's error is a row with `fault`."""
    together = guard.leaves_nothing(source)
    names = [by, *CANONICAL, *(["fault"] if caught else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        key_kind: list[pa.DataType] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key_kind[:] = [batch.schema.field(0).type]
                yield batch

        def out() -> pa.RecordBatch:
            columns = zip(*made)
            arrays = [pa.array(next(columns), key_kind[0]), *(pa.array(c, pa.string()) for c in columns)]
            made.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for files in _files(typed()):
            for (key, _), got in zip(files, jail.run_each(source, MODULE, [r for _, r in files], together, limits)):
                if isinstance(got, Exception):
                    if not caught:
                        raise got
                    made.append((key, *[""] * len(CANONICAL), str(got) or type(got).__name__))
                else:
                    tail = (None,) if caught else ()
                    made += [(key, *["" if (v := r.get(c)) is None else v for c in CANONICAL], *tail) for r in got]
                if len(made) >= OUT_ROWS:
                    yield out()
        if made:
            yield out()

    seen = [c for c in rows.columns if c not in (by, order)]
    sort = [F.col(f"`{by}`")] + ([F.col(f"`{order}`").asc_nulls_last()] if order is not None else [])
    dealt = rows.repartition(F.col(f"`{by}`")).sortWithinPartitions(*sort)
    return dealt.select(*(F.col(f"`{c}`") for c in (by, *seen))).mapInArrow(run, schema)


def apply_transform(rows: DataFrame, source: str, by: str | None = None, order: str | None = None, limits: jail.Limits = jail.Limits()) -> DataFrame:
    """Canonical rows that the source's transform makes of raw rows; by: the column that tells files apart, which
    comes out too; order: the column that orders a file's rows. Both are no columns of the rows that the source sees.
    Where the transform fails or is stopped, so does the job."""
    _checked(source)
    schema = ", ".join(f"{c} string" for c in CANONICAL)

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _made(source, batch, limits)

    def of_file(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if order is not None:
            frame = frame.sort_values(order, kind="stable")
        out = _made(source, frame.drop(columns=[c for c in (by, order) if c is not None]), limits)
        out.insert(0, by, key[0])
        return out

    if by is None:
        return rows.mapInPandas(of_batches, schema)
    kind = rows.schema[by].dataType.simpleString()
    if _plain(rows, by, order):
        return _by_file(rows, source, by, order, limits, f"`{by}` {kind}, {schema}", False)
    return rows.groupBy(by).applyInPandas(of_file, f"`{by}` {kind}, {schema}")


def try_transform(rows: DataFrame, source: str, by: str, order: str | None = None, limits: jail.Limits = jail.Limits(), scan: bool = True) -> DataFrame:
    """As apply_transform by file, with a column `fault`: a file whose transform fails or is stopped gives one row, which says
    why, and the other files go on. scan: whether the guard has to find nothing first; the jail holds in either case."""
    if scan:
        _checked(source)
    schema = ", ".join(f"{c} string" for c in CANONICAL)

    def of_file(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if order is not None:
            frame = frame.sort_values(order, kind="stable")
        try:
            out = _made(source, frame.drop(columns=[c for c in (by, order) if c is not None]), limits).assign(fault=None)
        except (jail.JailError, SyntaxError) as e:
            out = pd.DataFrame([[""] * len(CANONICAL) + [str(e) or type(e).__name__]], columns=[*CANONICAL, "fault"])
        out.insert(0, by, key[0])
        return out

    kind = rows.schema[by].dataType.simpleString()
    if _plain(rows, by, order):
        return _by_file(rows, source, by, order, limits, f"`{by}` {kind}, {schema}, fault string", True)
    return rows.groupBy(by).applyInPandas(of_file, f"`{by}` {kind}, {schema}, fault string")


def runtime_faults(tried: DataFrame, client: str, by: str, iteration: int = 1) -> DataFrame:
    """H1 findings, one for each file whose transform failed."""
    proof = F.create_map(F.lit("fault"), F.left("fault", F.lit(500)))
    found = tried.filter(F.col("fault").isNotNull()).select(
        F.lit(client).alias("client"), F.col(by).cast("string").alias("sample"), F.lit(iteration).alias("iteration"), F.lit(H1).alias("check"),
        F.lit("error").alias("severity"), F.concat(F.lit("transform stopped: "), F.left("fault", F.lit(200))).alias("message"), proof.alias("evidence"),
    )
    return found.to(T._parse_datatype_string(FINDINGS))


class Provider(Protocol):
    """Makes plans, and better ones from what the checks found."""

    name: str

    def plan(self, contract: FeedContract, tool_calls: tuple[str, ...]) -> IngestionPlan: ...

    def repair(self, plan: IngestionPlan, errors: list[dict]) -> IngestionPlan: ...


class Declarative:
    """The provider that does what the contract says."""

    name = "declarative"

    def plan(self, contract: FeedContract, tool_calls: tuple[str, ...] = ()) -> IngestionPlan:
        return compile_plan(contract, tool_calls)

    def repair(self, plan: IngestionPlan, errors: list[dict]) -> IngestionPlan:
        """The sound plan, with a note of the first error."""
        from dataclasses import replace

        note = f"repairs {errors[0]['check']}: {errors[0]['message']}" if errors else ""
        return replace(plan, notes=note)
