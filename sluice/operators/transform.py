"""Canonical rows of a feed: a plan compiled to one expression per canonical column.

strict: whatever the contract doesn't allow is an error of the row, which keeps its
number. lenient: missing and odd values are mended. Errors are a column, not an
exception, so one bad row doesn't stop a job; `require` turns them into one.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decimal_of, first_error, iso_date, money, signed, trim
from ..plans.contract import ColumnSpec
from ..plans.plan import IngestionPlan
from ..schemas import CANONICAL
from ..sources import files


def amount(plan: IngestionPlan, c: ColumnSpec, text: Column, raw: dict[str, Column], strict: bool) -> tuple[Column, list]:
    """An amount as text, and its errors."""
    if plan.raw_amounts:
        return text, []
    clean = text
    if plan.strip_thousands:
        clean = F.replace(text, F.lit(","), F.lit(""))
        if strict:
            clean = F.replace(clean, F.lit(" "), F.lit(""))
    if not strict:
        inner = F.regexp_extract(clean, r"\A\((.*)\)\z", 1)
        clean = F.when(inner != "", F.concat(F.lit("-"), inner)).otherwise(clean)
        clean = F.when(clean.isin("", "-"), F.lit("0")).otherwise(clean)
    value = decimal_of(clean)
    errors = [(value.isNull(), F.concat(F.lit(f"{c.source}: not an amount: "), text))]
    if c.sign_column:
        marker = raw.get(c.sign_column)
        if marker is None:
            errors.insert(0, (F.lit(strict), F.lit(f"{c.sign_column}: no such column")))
            marker = F.lit("")
        elif strict:
            errors.insert(0, (marker.isNull(), F.lit(f"{c.sign_column}: missing")))
        value = signed(value, F.coalesce(marker, F.lit("")), c.negative_marker, any_case=not strict)
    return money(value), errors


def whole(c: ColumnSpec, text: Column, strict: bool) -> tuple[Column, list]:
    """A whole number as text, and its errors."""
    if strict:
        value = F.when(text.rlike(r"\A[+-]?\d+\z"), text.try_cast("decimal(38,0)"))
        return value.cast("string"), [(value.isNull(), F.concat(F.lit(f"{c.source}: not a whole number: "), text))]
    number = decimal_of(text)
    value = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("decimal(38,0)").cast("string")
    return F.when(text == "", "").otherwise(value), [((text != "") & number.isNull(), F.concat(F.lit(f"{c.source}: not a number: "), text))]


def convert(plan: IngestionPlan, c: ColumnSpec, raw: dict[str, Column], strict: bool) -> tuple[Column, list]:
    """One canonical column as text, and (condition, message) of its errors, in order."""
    found = raw.get(c.source)
    if found is None:
        return F.lit(""), [(F.lit(strict), F.lit(f"{c.source}: no such column"))]
    missing = [(found.isNull(), F.lit(f"{c.source}: missing"))] if strict and plan.contract.format == "jsonl" else []
    text = trim(F.coalesce(found, F.lit("")))
    if c.default is not None:
        text = F.when(text == "", F.lit(c.default)).otherwise(text)
    if c.dtype == "date":
        value = iso_date(text, c.date_format)
        bad = value.isNull() if strict else value.isNull() & (text != "")
        value = value if strict else F.when(text == "", "").otherwise(value)
        return value, [*missing, (bad, F.concat(F.lit(f"{c.source}: not a date in {c.date_format}: "), text))]
    if c.dtype == "decimal":
        value, errors = amount(plan, c, text, raw, strict)
        return value, [*missing, *errors]
    if c.dtype == "int":
        value, errors = whole(c, text, strict)
        return value, [*missing, *errors]
    return F.upper(text) if c.target == "currency" else text, missing


def _projected(rows: DataFrame, raw: dict[str, Column], plan: IngestionPlan, strict: bool, numbered: bool) -> list[Column]:
    """The canonical columns (never NULL) and error of a plan."""
    made: dict[str, Column] = {}
    errors: list = [(F.col("_fault").isNotNull(), F.col("_fault"))] if "_fault" in rows.columns else []
    for c in plan.contract.columns:
        if c.target is not None:
            made[c.target], found = convert(plan, c, raw, strict)
            errors += found
    error = first_error(*errors) if errors else F.lit(None).cast("string")
    if numbered:
        error = F.concat(F.lit("data row "), (F.col("idx") + 1).cast("string"), F.lit(": "), error)
    return [*(F.coalesce(made.get(n, F.lit("")), F.lit("")).alias(n) for n in CANONICAL), error.alias("error")]


def project(rows: DataFrame, raw: dict[str, Column], plan: IngestionPlan, strict: bool = True, keep: tuple[str, ...] = ("sample", "idx")) -> DataFrame:
    """Columns `keep`, the canonical columns (never NULL) and error, NULL where a row is sound."""
    return rows.select(*keep, *_projected(rows, raw, plan, strict, "idx" in keep))


def project_plans(rows: DataFrame, raw: dict[str, Column], plans: dict[str, IngestionPlan], strict: bool = True, keep: tuple[str, ...] = ("sample", "idx")) -> DataFrame:
    """Columns `keep`, plan (its name) and what `project` makes of each row by each plan, in one scan of the rows.

    raw holds the fields that any of the plans asks for. Where rows have a column `tail`, trailer lines are among them: it counts
    lines from the end, is NULL for data, and a plan sees the lines beyond those that it takes for the trailer.
    """
    kinds = [("plan", "string"), *((n, "string") for n in (*CANONICAL, "error"))]
    made = []
    for name, plan in plans.items():
        one = F.struct(F.lit(name).alias("plan"), *_projected(rows, raw, plan, strict, "idx" in keep))
        if "tail" in rows.columns:
            one = F.when(F.col("tail").isNull() | (F.col("tail") > plan.contract.trailer_rows), one)
        made.append(one.cast("struct<" + ",".join(f"{n}:{k}" for n, k in kinds) + ">"))
    seen = F.filter(F.array(*made), lambda x: x.isNotNull())
    return rows.select(*keep, F.inline(seen))


def read_rows(spark: SparkSession, paths: list[str], plan: IngestionPlan, strict: bool = True) -> DataFrame:
    """client, sample, idx, the canonical columns and error of every data row of some files."""
    spec = plan.contract
    parts = []
    groups: dict[tuple, list[str]] = {}
    headers = files.header_names_of(spark, paths, spec, strict) if spec.format == "csv" else [()] * len(paths)
    for p, names in zip(paths, headers):
        groups.setdefault(names, []).append(p)
    framing = replace(spec, trailer_rows=spec.trailer_rows + 1) if plan.drop_last_row else spec
    utf8 = files.charset(spec.encoding) == "UTF-8"
    for names, same in groups.items():  # files with equal headers are one scan
        sizes = spark.read.format("binaryFile").load(same).select("path", "length").collect()
        large = [r.path for r in sizes if utf8 and r.length >= files.LARGE_BYTES]
        small = [r.path for r in sizes if r.path not in set(large)]
        scans = [files.framed_lines(files.read_texts(spark, small, spec.encoding), framing, strict)] if small else []
        scans += [files.framed_lines_large(spark, large, framing, strict)] if large else []
        lines = scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1])
        rows, raw = files.records(spark, lines, spec, list(names) or None, strict)
        parts.append(project(rows, raw, plan, strict))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(spec.client).alias("client"), "*")


def require(rows: DataFrame) -> DataFrame:
    """The same rows; running it raises at a row with an error."""
    fault = F.raise_error(F.concat_ws(": ", "sample", "error"))
    checked = F.when(F.col("error").isNotNull(), fault.cast("string")).otherwise(F.col(CANONICAL[0]))
    return rows.withColumn(CANONICAL[0], checked).drop("error")


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and rows with an error."""
    return rows.filter(F.col("error").isNull()).drop("error"), rows.filter(F.col("error").isNotNull())


def load(rows: DataFrame, path: str) -> int:
    """Write canonical rows, partitioned by date; how many there were."""
    seen = Observation("load")
    rows.observe(seen, F.count("*").alias("n")).write.partitionBy("value_date").mode("append").parquet(path)
    return int(seen.get["n"])
