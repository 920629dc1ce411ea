"""Contracts in bulk against the single parser."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sluice.errors import ContractError
from sluice.plans.contract import contract_blocks, parse_contract
from sluice.sources import bulk, files

LINES = [
    "```yaml feed-contract", "```", "  ```", "```yaml", "client: c1", "feed_name: f", "format: csv", "format: xml", "columns:", "  - {source: A, target: amount, dtype: decimal}",
    "  - source: B", "    target: currency", "  - {source: D, dtype: date}", "  - plain", "columns: none", "header_rows: 2", "header_rows: two", "odd: 1", "", "# said", "  - [a, {b: c]", "client: \r",
]
SOUND = "# t\n```yaml feed-contract\nclient: c1\nfeed_name: f\nformat: csv\ncolumns:\n  - {source: A, target: amount, dtype: decimal, default: 0}\n  - {source: B}\n```\n"


def one(text):
    """Sources and fault by the single parser."""
    try:
        spec = parse_contract(text or "")
    except ContractError as e:
        return [], str(e)
    return [(i, c.source, c.target, c.dtype, c.default) for i, c in enumerate(spec.columns)], None


def test_equal_to_the_single_parser(spark):
    rng = random.Random(4)
    texts = [None, "", SOUND, SOUND * 2, SOUND.replace("\n", "\r\n"), "```yaml feed-contract\n" + "x: [" * 5000 + "\n```"]
    texts += ["\n".join(rng.choices(LINES, k=rng.randint(1, 12))) for _ in range(200)]
    texts += ["```yaml feed-contract\n" + "\n".join(["client: c1", "feed_name: f", "format: csv", "columns:", *rng.choices(LINES[9:], k=rng.randint(1, 4))]) + "\n```" for _ in range(200)]
    specs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    rows = bulk.contract_rows(specs, F.coalesce("text", F.lit("")), ("id",))
    got = {}
    for r in rows.collect():
        got.setdefault(r.id, []).append(r)
    assert sorted(got) == list(range(len(texts)))
    sound = 0
    for i, text in enumerate(texts):
        if text and "nested too deep" in (got[i][0].fault or ""):
            continue
        columns, fault = one(text)
        if fault is None and got[i][0].fault:  # a number that is none: the rows have types
            assert "is no" in got[i][0].fault
            continue
        assert sorted((r.position, r.source, r.target, r.dtype, r.default_value) for r in got[i] if r.fault is None) == columns
        assert [r.fault for r in got[i] if r.fault] == ([fault] if fault else []), text
        sound += fault is None
    assert sound > 10
    assert bulk.usable(rows).count() + bulk.quarantined(rows).count() == rows.count()
    assert bulk.contract_rows(specs.limit(0), F.col("text"), ("id",)).collect() == []


@pytest.mark.parametrize("closed", [True, False])
def test_a_long_block_takes_time_in_proportion(spark, closed):
    text = F.concat(F.lit("```yaml feed-contract\n"), F.repeat(F.lit("x: y\n"), 300_000), F.lit("```" if closed else ""))
    begun = time.monotonic()
    (row,) = spark.range(1).select(files.contract_block(text).alias("b")).select("b.blocks", F.length("b.block").alias("n")).collect()
    assert time.monotonic() - begun < 60
    assert (row.blocks, row.n) == ((1, 5 * 300_000 - 1) if closed else (0, None))
    assert contract_blocks("```yaml feed-contract\nx: y\n```") == ["x: y"]
