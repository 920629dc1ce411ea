"""Profiles: row count, exact sum, null rates and distinct counts, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decimal_of
from ..schemas import CANONICAL


def aggregates(columns=CANONICAL) -> list:
    """Aggregates of one profile; the empty text is a value of its own for distinct counts and no value for null rates."""
    parsed = decimal_of(F.col("amount"))
    out = [
        F.count("*").alias("rows"), F.coalesce(F.sum(parsed.cast("decimal(28,10)")), F.lit(0)).alias("amount_sum"),
        F.count_if(parsed.isNull()).alias("unparseable"),
    ]
    for c in columns:
        empty = F.coalesce(F.col(c), F.lit("")) == ""
        out.append(F.coalesce(F.avg(F.when(empty, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"null_{c}"))
    for c in columns:
        out.append(F.count_distinct(F.coalesce(F.col(c), F.lit(""))).alias(f"distinct_{c}"))
    return out


def profile(rows: DataFrame, by: tuple[str, ...] = ("sample",), columns=CANONICAL) -> DataFrame:
    """One row of aggregates per group; without groups one row even of no rows.

    Several exact distinct counts at once expand each row per column; so each column is
    counted from its own distinct values, which tasks reduce before anything is moved.
    """
    plain = [x for x in aggregates(columns)[: 3 + len(columns)]]
    base = rows.groupBy(*by).agg(*plain)
    pairs = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c), F.lit("")).alias("v")) for c in columns))).alias("x"))
    values = pairs.select(*by, "x.c", "x.v").distinct().groupBy(*by).agg(*(F.count_if(F.col("c") == c).alias(f"distinct_{c}") for c in columns))
    if not by:
        return base.crossJoin(values)  # one row each
    return base.join(values, list(by))


def long_form(profiles: DataFrame, by: tuple[str, ...] = ("sample",), columns=CANONICAL) -> DataFrame:
    """(by, metric, column, observed) of each measure of a profile; sums as text."""
    cells = [F.struct(F.lit("amount_sum").alias("metric"), F.lit("amount").alias("column"), F.col("amount_sum").cast("decimal(38,10)").alias("observed"))]
    for kind in ("null", "distinct"):
        cells += [
            F.struct(F.lit({"null": "null_rate"}.get(kind, kind)).alias("metric"), F.lit(c).alias("column"), F.col(f"{kind}_{c}").cast("decimal(38,10)").alias("observed"))
            for c in columns
        ]
    return profiles.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*")


def as_pins(profiles: DataFrame, columns=CANONICAL) -> DataFrame:
    """sample, rows, amount_sum (two places), null_rate and distinct as maps."""

    def mapping(kind: str):
        return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(f"{kind}_{c}") for c in columns)))

    return profiles.select(
        "sample", "rows", F.col("amount_sum").cast("decimal(38,2)").cast("string").alias("amount_sum"),
        mapping("null").alias("null_rate"), mapping("distinct").alias("distinct"),
    )
