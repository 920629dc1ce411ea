"""Profiles that are kept up to date: counts of values, from which they follow.

A row of a feed adds one to the count of each of its values; a reversing row takes one away. Counts of batches add up in
any order, so a table of them is appended to and never read again for a merge; row counts, exact sums, null rates and
exact distinct counts of all that is in force follow from it without the feed. Tasks add up their rows' values before
anything is moved. Exact sums hold for amounts under 10**14 and counts under 10**13.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decimal_of
from ..schemas import CANONICAL


def value_counts(rows: DataFrame, by: tuple[str, ...] = ("sample",), columns=CANONICAL, sign: int = 1) -> DataFrame:
    """by, column, value and n: how often each value stands in each column; null counts as empty. sign -1 reverses rows."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in columns))
    pairs = rows.select(*by, F.explode(cells).alias("x")).select(*by, "x.column", "x.value")
    return pairs.groupBy(*by, "column", "value").agg((F.count("*") * sign).alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """Counts of all parts together. A value that was reversed more often than it was there is an error."""
    every = reduce(DataFrame.unionByName, parts)
    keys = [c for c in every.columns if c != "n"]
    total = every.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n != 0")
    fault = F.raise_error(F.concat(F.col("column"), F.lit(": reversed more often than it was there: "), F.col("value")))
    return total.withColumn("n", F.when(F.col("n") < 0, fault.cast("long")).otherwise(F.col("n")))


def profile_of(counts: DataFrame, by: tuple[str, ...] = ("sample",), columns=CANONICAL) -> DataFrame:
    """As `profile` of the rows that the merged counts stand for; a group of no rows has none."""
    on = lambda c, x: F.coalesce(F.sum(F.when(F.col("column") == c, x)), F.lit(0))
    n, amount = F.col("n"), decimal_of(F.col("value"))
    rows = on(columns[0], n)
    worth = amount.cast("decimal(24,10)") * n.cast("decimal(13,0)")
    out = [rows.alias("rows"), on("amount", worth).cast("decimal(38,10)").alias("amount_sum"), on("amount", F.when(amount.isNull(), n).otherwise(0)).alias("unparseable")]
    out += [(on(c, F.when(F.col("value") == "", n).otherwise(0)) / F.greatest(rows, F.lit(1))).alias(f"null_{c}") for c in columns]
    out += [F.count_if(F.col("column") == c).alias(f"distinct_{c}") for c in columns]
    return counts.groupBy(*by).agg(*out)


class KeptCounts:
    """Counts in a folder: batches are appended; `compact` puts them together in a new folder."""

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = ("sample",), columns=CANONICAL):
        self.spark, self.path, self.by, self.columns = spark, path, by, tuple(columns)

    def add(self, rows: DataFrame, sign: int = 1) -> None:
        value_counts(rows, self.by, self.columns, sign).write.mode("append").parquet(self.path)

    def reverse(self, rows: DataFrame) -> None:
        self.add(rows, -1)

    def counts(self) -> DataFrame:
        return merged(self.spark.read.parquet(self.path))

    def profile(self) -> DataFrame:
        return profile_of(self.counts(), self.by, self.columns)

    def compact(self, path: str) -> KeptCounts:
        self.counts().write.parquet(path)
        return KeptCounts(self.spark, path, self.by, self.columns)
