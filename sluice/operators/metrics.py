"""Reductions of run reports to headline figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(status: Column, iterations: Column) -> Column:
    """pass, heal, escalate, or the status of a run that did none of these."""
    return (
        F.when((status == "approved") & (iterations == 1), "pass").when(status == "approved", "heal")
        .when(status == "escalated", "escalate").otherwise(status)
    )


def with_total(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, and of all as 'total'; a null key stays null."""
    counts = df.rollup(key).agg(F.count("*").alias("n"), F.grouping(key).alias("_all"))
    return counts.select(F.when(F.col("_all") == 1, "total").otherwise(F.col(key)).alias(key), "n")


def zero_filled(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """The dimension's rows with n, 0 where there are none, and the total of all."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    filled = dimension.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.join(total)  # total is one row


def headline(runs: DataFrame, iterations: DataFrame, findings: DataFrame, adversarial: DataFrame, checkpoints: DataFrame, checks: DataFrame) -> dict:
    """The figures of a replay.

    runs: run_id, client, status, iterations, expected, tool_calls (array); iterations: run_id, iteration, passed;
    findings: source, check, severity; adversarial: name, must_fail and failed (arrays); checkpoints: run_id.
    """
    first = iterations.groupBy("run_id").agg(F.min_by("passed", "iteration").alias("first_passed"))
    seen = runs.join(first, "run_id", "left").withColumn("observed", outcome(F.col("status"), F.col("iterations")))
    heal = F.col("expected") == "heal"
    r = seen.agg(
        F.count("*").alias("runs"), F.count_if(F.col("observed") == F.col("expected")).alias("matched"), F.count_if("first_passed").alias("first_pass"),
        F.count_if(heal).alias("heal_runs"), F.count_if(heal & (F.col("observed") == "heal")).alias("healed"),
        F.coalesce(F.avg("iterations"), F.lit(0.0)).alias("mean_iterations"), F.coalesce(F.sum(F.size("tool_calls")), F.lit(0)).alias("tool_calls"),
        F.array_sort(F.flatten(F.collect_set("tool_calls"))).alias("tools"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("observed") == "escalate", F.col("client")))), ", ").alias("escalated"),
    ).first()
    a = adversarial.agg(F.count("*").alias("n"), F.count_if(F.size(F.array_except("must_fail", "failed")) == 0).alias("rejected")).first()
    by_check = zero_filled(findings.filter("severity = 'error'"), checks, "check").orderBy("ordinal").collect()
    return {
        "scenarios": f"{r.matched} / {r.runs}", "first_pass_rate": f"{r.first_pass} / {r.runs}", "healed_rate": f"{r.healed} / {r.heal_runs}",
        "adversarial_rejected": f"{a.rejected} / {a.n}", "mean_iterations": f"{r.mean_iterations:.2f}", "checkpoints": str(checkpoints.count()),
        "errors": {x["check"]: x["n"] for x in by_check}, "total_errors": by_check[0]["total"] if by_check else 0,
        "tool_calls": r.tool_calls, "tools": sorted(set(r.tools)), "escalated": r.escalated,
    }
