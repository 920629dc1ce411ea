"""Relational operators of the ledger and the reports, over any keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregation, so tasks reduce before anything moves."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def newest(df: DataFrame, at: str, key: str, k: int) -> DataFrame:
    """The k newest rows, ties by key, newest first."""
    return df.orderBy(F.col(at).desc(), F.col(key).desc()).limit(k)


def lagged(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, start: str) -> DataFrame:
    """The previous row's value in each key, `start` at the first. A key's rows are sorted in one task, which spills if they are many."""
    return df.withColumn(name, F.coalesce(F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(start)))


def changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the previous row's of their key; that is `before`. A key's rows are sorted in one task."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def compare_keys(pinned: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status: both, missing (pinned only) or unpinned (found only)."""
    a = pinned.select(*keys, F.lit(True).alias("_p"))
    b = found.select(*keys, F.lit(True).alias("_f"))
    status = F.when(F.col("_p").isNotNull() & F.col("_f").isNotNull(), "both").when(F.col("_p").isNotNull(), "missing").otherwise("unpinned")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def ordered_names(df: DataFrame, keys: list[str], value: str, separator: str = ", ") -> DataFrame:
    """keys, n and the values in order, joined."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string")), separator).alias("names"),
    )


def divides(df: DataFrame, keys: list[str], value: str, required: list) -> DataFrame:
    """Keys that have every required value."""
    has = df.filter(F.col(value).isin(*required)).groupBy(*keys).agg(F.collect_set(value).alias("has"))
    return has.filter(F.size(F.array_except(F.array(*map(F.lit, required)), F.col("has"))) == 0)


def first_sound(df: DataFrame, keys: list[str], order: list[str], error: str) -> DataFrame:
    """The first row of each key that has no error; keys that have none are left out."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.filter(F.col(error).isNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)
