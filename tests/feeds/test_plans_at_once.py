"""Many plans over one scan: the findings of each are those of its own run."""

from pyspark.sql import functions as F

from sluice.operators import checks
from sluice.operators.profile import as_pins, profile
from sluice.operators.transform import project, project_plans
from sluice.plans.contract import ColumnSpec, FeedContract
from sluice.plans.plan import compile_plan, inject

SPEC = FeedContract(
    client="c", feed_name="f", format="csv", trailer_rows=1,
    columns=(ColumnSpec("k", "trade_id"), ColumnSpec("d", "value_date", "date", "%d/%m/%Y"), ColumnSpec("a", "amount", "decimal", sign_column="m", negative_marker="D"), ColumnSpec("c", "currency"), ColumnSpec("m")),
)
DEFECTS = ("date_format_swapped", "amount_sign_dropped", "thousands_separator_kept", "trailer_not_skipped")


def test_findings_by_plan(spark):
    rows = [(s, i, f"{s}-{i}", f"{i + 1:02d}/03/2026", "1,250.00" if i % 4 == 0 else "7.5", "usd", "D" if i % 3 else "C", None) for s in ("x", "y") for i in range(20)]
    rows += [(s, 20, "TRAILER", "", "", "", "", 1) for s in ("x", "y")]
    raw = spark.createDataFrame(rows, "sample string, idx long, k string, d string, a string, c string, m string, tail int")
    fields = {c.source: F.col(c.source) for c in SPEC.columns}
    sound = compile_plan(SPEC)
    plans = {"sound": sound} | {d: inject(sound, d) for d in DEFECTS}
    whole = project(raw.filter("tail is null"), fields, sound)
    pins = as_pins(profile(whole)).withColumnRenamed("rows", "expected_rows")
    tagged = lambda df: df.withColumns({"client": F.lit("c"), "iteration": F.lit(1)})
    many = project_plans(raw, fields, plans, strict=False)
    assert many.count() == 5 * 40 + 2 and "Union" not in many._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: (r.sample, r.check, r.severity, r.message)
    got = checks.evaluate_plans(tagged(many), pins).collect()
    for name, plan in plans.items():
        own = raw if plan.contract.trailer_rows == 0 else raw.filter("tail is null")
        want = checks.evaluate_rows(tagged(project(own, fields, plan, strict=False)), pins).collect()
        assert sorted(map(key, (r for r in got if r.plan == name))) == sorted(map(key, want)), name
    assert {r.plan for r in got if r.severity == "error"} == set(DEFECTS)
