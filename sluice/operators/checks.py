"""The six checks, as frames of findings with one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decimal_of, first_error
from ..plans.plan import EDGES, TASKS
from ..schemas import CANONICAL, CHECKS, FINDINGS, H1, H2, H3, H4, H5, H6
from .profile import long_form, profile

#: Tolerances and limits.
SUM_TOLERANCE, NULL_TOLERANCE = "0.005", 0.05
LATENCY_BUDGET_MS, TIMEOUT_S, MAX_EVIDENCE_ROWS = 5000, 30, 3


def row_violation() -> Column:
    """Why a canonical row is wrong, by the first rule that it breaks; NULL if it is right."""
    typed = [(F.col(c).isNull(), f"{c} is not text") for c in CANONICAL]
    day = F.col("value_date")
    valid_day = day.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
    return first_error(
        *typed,
        (~F.col("amount").rlike(r"\A-?\d+\.\d{2}\z"), F.concat(F.lit("amount "), F.col("amount"), F.lit(" is not a decimal with two places"))),
        (~valid_day, F.concat(F.lit("value_date "), day, F.lit(" is not a date"))),
        (~F.col("currency").rlike(r"\A[A-Z]{3}\z"), F.concat(F.lit("currency "), F.col("currency"), F.lit(" is not three capitals"))),
    )


def findings(df: DataFrame, check: str, message: Column, severity: str = "error", **evidence: Column) -> DataFrame:
    """Findings of rows that have client, sample and iteration."""
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    proof = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select("client", "sample", "iteration", F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message"), proof.alias("evidence"))


def check_runtime(rows: DataFrame) -> DataFrame:
    """One finding per sample with a row that didn't convert: the first such row."""
    bad = rows.filter(F.col("error").isNotNull()).groupBy("client", "sample", "iteration").agg(
        F.min_by("error", "idx").alias("first"), F.count("*").alias("n")
    )
    return findings(bad, H1, F.concat_ws(": ", "sample", "first"), reasons=F.col("first"), rows=F.col("n"))


def top_offenders(rows: DataFrame, by: list[str], order: list, k: int = MAX_EVIDENCE_ROWS) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def check_schema(rows: DataFrame) -> DataFrame:
    """One finding per sample with wrong rows: how many, and the first three."""
    by = ["client", "sample", "iteration"]
    bad = rows.withColumn("reason", row_violation()).filter(F.col("reason").isNotNull()).select(*by, "idx", "reason")
    totals = bad.groupBy(*by).agg(F.count("*").alias("n"))
    shown = top_offenders(bad, by, ["idx"]).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", "reason"))).alias("rows"))
    both = totals.join(shown, by)
    return findings(
        both, H2, F.concat(F.col("sample"), F.lit(": "), F.col("n").cast("string"), F.lit(" row(s) violate the canonical schema")),
        violations=F.col("n"), offending_rows=F.to_json("rows"),
    )


def check_completeness(profiles: DataFrame, pins: DataFrame) -> DataFrame:
    """Samples whose row count isn't the pinned one, or that have no pin. pins: sample, expected_rows, ..."""
    both = profiles.join(pins.select("sample", "expected_rows", F.lit(True).alias("pinned")), "sample", "left")
    wrong = both.filter(F.col("pinned").isNull() | (F.col("rows") != F.col("expected_rows")))
    message = F.when(F.col("pinned").isNull(), F.concat("sample", F.lit(": no profile in the manifest"))).otherwise(
        F.concat(F.col("sample"), F.lit(": expected "), F.col("expected_rows").cast("string"), F.lit(" rows, got "), F.col("rows").cast("string"))
    )
    return findings(wrong, H3, message, expected=F.col("expected_rows"), actual=F.col("rows"))


def drift(observed: DataFrame, baseline: DataFrame, keys: list[str], tolerance: float = NULL_TOLERANCE) -> DataFrame:
    """Measures (keys, metric, column, observed) that are off their baseline (keys, metric, column, expected).

    Measures without a baseline are not compared.
    """
    both = observed.join(baseline, [*keys, "metric", "column"])
    off = F.abs(F.col("observed") - F.col("expected"))
    limit = F.when(F.col("metric") == "amount_sum", F.lit(SUM_TOLERANCE).cast("decimal(38,10)")).when(
        F.col("metric") == "null_rate", F.lit(str(tolerance)).cast("decimal(38,10)")
    ).otherwise(F.lit("0").cast("decimal(38,10)"))
    return both.filter(off > limit)


def pins_long(pins: DataFrame) -> DataFrame:
    """(sample, metric, column, expected) of pinned profiles."""
    number = lambda c: c.cast("decimal(38,10)")
    sums = pins.select("sample", F.lit("amount_sum").alias("metric"), F.lit("amount").alias("column"), number(F.col("amount_sum")).alias("expected"))
    rates = pins.select("sample", F.lit("null_rate").alias("metric"), F.explode("null_rate").alias("column", "v")).select("sample", "metric", "column", number(F.col("v")).alias("expected"))
    counts = pins.select("sample", F.lit("distinct").alias("metric"), F.explode("distinct").alias("column", "v")).select("sample", "metric", "column", number(F.col("v")).alias("expected"))
    return sums.unionByName(rates).unionByName(counts)


def check_drift(profiles: DataFrame, pins: DataFrame, tolerance: float = NULL_TOLERANCE) -> DataFrame:
    """A finding per measure off its pin; a warning per sample without pins."""
    wrong = drift(long_form(profiles, ("client", "sample", "iteration")), pins_long(pins), ["sample"], tolerance)
    plain = lambda c: F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    message = F.concat(F.col("sample"), F.lit(": "), F.col("metric"), F.lit(" of "), F.col("column"), F.lit(" is "), plain(F.col("observed")), F.lit(", baseline "), plain(F.col("expected")))
    found = findings(wrong, H4, message, metric=F.col("metric"), column=F.col("column"), expected=F.col("expected"), observed=F.col("observed"))
    lost = profiles.join(pins.select("sample"), "sample", "left_anti")
    return found.unionByName(findings(lost, H4, F.concat(F.lit("skipped: "), F.col("sample"), F.lit(" has no profile")), "warning"))


def latency_level(ms: Column, budget_ms: int = LATENCY_BUDGET_MS) -> Column:
    """error beyond the budget, warning beyond half of it, else NULL."""
    return F.when(ms > budget_ms, "error").when(ms > budget_ms / 2, "warning")


def check_latency(times: DataFrame, budget_ms: int = LATENCY_BUDGET_MS) -> DataFrame:
    """times: client, sample, iteration, wall_ms."""
    marked = times.withColumn("level", latency_level(F.col("wall_ms"), budget_ms)).filter(F.col("level").isNotNull())
    message = F.concat(F.col("sample"), F.lit(": "), F.col("wall_ms").cast("string"), F.lit(f" ms, budget {budget_ms} ms"))
    return findings(marked, H5, message, wall_ms=F.col("wall_ms"), budget_ms=F.lit(budget_ms)).withColumn(
        "severity", F.when(F.col("evidence")["wall_ms"].cast("long") > budget_ms, "error").otherwise("warning")
    )


def dag_mismatch(dags: DataFrame) -> DataFrame:
    """(keys..., field, expected, actual) of declared graphs that differ from their contracts.

    dags: dag_id, schedule, tasks, edges, and expected_id and expected_schedule. Tasks are compared as bags, edges as sets.
    """
    pair = lambda e: F.concat_ws(">", e)
    edges = F.array_sort(F.array_distinct(F.transform(F.filter("edges", lambda e: F.size(e) == 2), pair)))
    want_edges = F.array(*(F.lit(f"{a}>{b}") for a, b in sorted(EDGES)))
    want_tasks = F.array(*map(F.lit, sorted(TASKS)))
    cases = [
        ("dag_id", F.col("expected_id"), F.col("dag_id")), ("schedule", F.col("expected_schedule"), F.col("schedule")),
        ("tasks", F.array_join(want_tasks, ","), F.array_join(F.array_sort("tasks"), ",")), ("edges", F.array_join(want_edges, ","), F.array_join(edges, ",")),
    ]
    rows = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), a.alias("expected"), b.alias("actual")) for f, a, b in cases)), lambda x: ~x["expected"].eqNullSafe(x["actual"]))
    keys = [c for c in dags.columns if c not in ("dag_id", "schedule", "tasks", "edges", "expected_id", "expected_schedule")]
    return dags.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def check_dag(dags: DataFrame) -> DataFrame:
    """dags as for dag_mismatch, with client, sample and iteration."""
    return findings(dag_mismatch(dags), H6, F.concat(F.col("field"), F.lit(" differs from contract")), field=F.col("field"), expected=F.col("expected"), actual=F.col("actual"))


def verdict(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, passed (no error) and the number of errors."""
    return found.groupBy(*keys).agg(
        (~F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False))).alias("passed"), F.count_if(F.col("severity") == "error").alias("errors")
    )


def evaluate_rows(rows: DataFrame, pins: DataFrame, tolerance: float = NULL_TOLERANCE) -> DataFrame:
    """Findings of H1 to H4 over rows with client, sample, idx, iteration, the canonical columns and error.

    A sample with a conversion error has only that finding: nothing came of it to be looked at.
    """
    by = ["client", "sample", "iteration"]
    broken = check_runtime(rows)
    sound = rows.join(broken.select(*by), by, "left_anti")
    profiles = profile(sound, tuple(by))
    return broken.unionByName(check_schema(sound)).unionByName(check_completeness(profiles, pins)).unionByName(check_drift(profiles, pins, tolerance))


def evaluate_plans(rows: DataFrame, pins: DataFrame, tolerance: float = NULL_TOLERANCE) -> DataFrame:
    """As evaluate_rows by plan: rows have a column plan besides, and so do the findings. Plans have no / in their names."""
    plans = rows.select("plan").distinct()
    name = F.concat("plan", F.lit("/"), F.col("sample"))
    every = F.broadcast(plans).crossJoin(pins).withColumn("sample", name).drop("plan")  # a row a plan and sample
    found = evaluate_rows(rows.withColumn("sample", name).drop("plan"), every, tolerance)
    found = found.withColumn("plan", F.substring_index("sample", "/", 1))
    plain = F.expr("substring(sample, length(plan) + 2)")
    return found.withColumns({"message": F.replace("message", F.col("sample"), plain), "sample": plain})


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDINGS)


def checks_frame(spark: SparkSession) -> DataFrame:
    """The checks and their order."""
    return spark.createDataFrame(list(enumerate(CHECKS, 1)), "ordinal int, check string")


def tolerant_sum(amount: Column) -> tuple[Column, Column]:
    """Exact sum of what parses, and how many values don't."""
    value = decimal_of(amount)
    return F.coalesce(F.sum(value.cast("decimal(28,10)")), F.lit(0)), F.count_if(value.isNull())
