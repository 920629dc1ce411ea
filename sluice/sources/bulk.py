"""Contracts in bulk: the columns of many specs as rows, and their faults as rows beside them.

The contract blocks are cut out of the texts by DataFrame functions; only the first block of a spec and the number of
its blocks go to a table function, which parses and validates it in the executors as `parse_contract` does. A spec
that can't be read gives one row with a fault and stops nothing.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError
from ..plans.contract import ColumnSpec, FeedContract, contract_of, parse_block
from .files import contract_block

#: What is said of the feed with each of its columns.
FEED = tuple(f.name for f in fields(FeedContract) if f.name not in ("columns", "quirks"))
COLUMN = tuple(f.name for f in fields(ColumnSpec))
_NUMBERS = {"header_rows": T.LongType(), "trailer_rows": T.LongType(), "expected_row_count": T.LongType(), "skip_blank_lines": T.BooleanType()}
#: A contract's `default` is a column's `default_value` here, as DEFAULT is a word of SQL.
SCHEMA = T.StructType(
    [T.StructField(n, _NUMBERS.get(n, T.StringType())) for n in FEED]
    + [T.StructField("position", T.LongType())]
    + [T.StructField("default_value" if n == "default" else n, T.StringType()) for n in COLUMN]
    + [T.StructField("fault", T.StringType())]
)


def _said(kind: T.DataType, value):
    """A value of a contract as one of a row; one of another kind is a fault."""
    if value is None or isinstance(kind, T.StringType):
        return None if value is None else str(value)
    if type(value) is not {"bigint": int, "boolean": bool}[kind.simpleString()]:
        raise ContractError(f"contract: {value!r} is no {kind.simpleString()}")
    return value


class ContractColumns:
    """(blocks, block) to the rows of SCHEMA."""

    def eval(self, blocks: int, block: str):
        try:
            if blocks != 1:
                raise ContractError(f"spec: expected one feed-contract block, found {blocks or 0}")
            spec = contract_of(parse_block(block))
            kinds = {f.name: f.dataType for f in SCHEMA.fields}
            feed = [_said(kinds[n], getattr(spec, n)) for n in FEED]
            rows = [(*feed, i, *(_said(T.StringType(), getattr(c, n)) for n in COLUMN), None) for i, c in enumerate(spec.columns)]
        except ContractError as e:
            rows = [(*[None] * (len(SCHEMA) - 1), str(e))]
        except RecursionError:
            rows = [(*[None] * (len(SCHEMA) - 1), "contract: nested too deep")]
        yield from rows


def contract_rows(specs: DataFrame, text: Column, keep: tuple[str, ...]) -> DataFrame:
    """Columns `keep` of every spec with each column of its contract, or with a fault."""
    found = specs.select(*keep, contract_block(text).alias("_b")).select(*keep, F.col("_b.blocks").alias("_blocks"), F.col("_b.block").alias("_block"))
    made = F.udtf(ContractColumns, returnType=SCHEMA)(F.col("_blocks").outer(), F.col("_block").outer())
    return found.lateralJoin(made).drop("_blocks", "_block")


def quarantined(rows: DataFrame) -> DataFrame:
    """The rows of specs that can't be used."""
    return rows.filter("fault IS NOT NULL")


def usable(rows: DataFrame) -> DataFrame:
    return rows.filter("fault IS NULL").drop("fault")
