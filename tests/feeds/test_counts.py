"""Profiles from counts of values: equal to profiles of the rows that are left."""

import random

import pytest
from pyspark.errors import PySparkException

from sluice.operators.counts import KeptCounts, merged, value_counts
from sluice.operators.profile import profile
from sluice.schemas import CANONICAL

SCHEMA = "sample string, " + ", ".join(f"{c} string" for c in CANONICAL)


def rows_of(r, n):
    value = lambda c: r.choice(["", None, "n/a", "1.25", "-3", "0.1", f"{r.randrange(50)}.5"]) if c == "amount" else r.choice(["", None, "a", "b", f"v{r.randrange(9)}"])
    return [(f"s{r.randrange(3)}", *(value(c) for c in CANONICAL)) for _ in range(n)]


def test_ten_merges_and_reversals(spark, tmp_path):
    r = random.Random(3)
    kept = KeptCounts(spark, f"{tmp_path}/counts")
    batches = [rows_of(r, 40) for _ in range(10)]
    for b in batches:
        kept.add(spark.createDataFrame(b, SCHEMA))
    for k in (2, 5, 7):
        kept.reverse(spark.createDataFrame(batches[k], SCHEMA))
    left = [x for k, b in enumerate(batches) if k not in (2, 5, 7) for x in b]
    want = sorted(map(tuple, profile(spark.createDataFrame(left, SCHEMA)).collect()))
    for table in (kept, kept.compact(f"{tmp_path}/compact")):
        got = table.profile()
        assert sorted(map(tuple, got.collect())) == want and got.columns == profile(spark.createDataFrame(left, SCHEMA)).columns


def test_reversing_all_and_too_much(spark):
    rows = spark.createDataFrame(rows_of(random.Random(4), 20), SCHEMA)
    assert merged(value_counts(rows), value_counts(rows, sign=-1)).count() == 0
    with pytest.raises(PySparkException):
        merged(value_counts(rows), value_counts(rows, sign=-1), value_counts(rows, sign=-1)).collect()
