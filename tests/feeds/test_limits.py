"""Time limits, times per file, cases on disk, events, fences."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sluice import service
from sluice.errors import ContractError
from sluice.operators import manifest, metrics, reports, tables
from sluice.operators.transform import read_rows, require
from sluice.plans.contract import contract_blocks
from sluice.plans.plan import compile_plan
from sluice.sources import files

SPEC = """```yaml feed-contract
client: c
feed_name: daily
format: csv
columns:
  - {source: "k", target: trade_id}
  - {source: "d", target: value_date, dtype: date, date_format: "%Y-%m-%d"}
  - {source: "a", target: amount, dtype: decimal}
  - {source: "y", target: currency}
```
"""


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("limits")
    d = root / "c" / "samples"
    d.mkdir(parents=True)
    (root / "c" / "spec.md").write_text(SPEC)
    for name, n in (("one.csv", 3), ("two.csv", 5)):
        (d / name).write_text("k,d,a,y\n" + "".join(f"{i},2026-01-0{i + 1},{i}.50,EUR\n" for i in range(n)))
    manifest.write_manifest(manifest.build_manifest(spark, str(root), "c"), str(root / "c" / "manifest.json"))
    return str(root)


@pytest.fixture(scope="module")
def parts(spark, corpus):
    return compile_plan(files.load_contract(spark, corpus, "c")), files.load_contract(spark, corpus, "c"), manifest.load_manifest(spark, corpus, "c"), files.sample_paths(spark, corpus, "c")


def checks_of(found):
    return sorted((f.check, f.sample) for f in found.filter("severity = 'error'").collect())


def test_each_file_has_its_own_time(spark, parts, monkeypatch):
    plan, spec, pins, paths = parts
    found, emitted, wall = service.evaluate(spark, plan, spec, pins, paths, latency_budget_ms=600_000)
    assert checks_of(found) == [] and emitted == 8 and wall > 0
    timed = service.timed_rows

    def slow_second(*args):
        return [(r, n, ms + (700_000 if i else 0)) for i, (r, n, ms) in enumerate(timed(*args))]

    monkeypatch.setattr(service, "timed_rows", slow_second)
    found, _, _ = service.evaluate(spark, plan, spec, pins, paths, latency_budget_ms=600_000, timeout_s=10_000)
    assert checks_of(found) == [("H5_latency", "two.csv")]
    monkeypatch.setattr(service, "timed_rows", timed)
    monkeypatch.setattr(service, "SERIAL_FILES", 0)  # side by side
    assert checks_of(service.evaluate(spark, plan, spec, pins, paths, latency_budget_ms=600_000)[0]) == []


def test_a_declared_delay_beyond_the_limit_times_out(spark, parts):
    from dataclasses import replace

    plan, spec, pins, paths = parts
    found, _, _ = service.evaluate(spark, replace(plan, delay_ms=31_000), spec, pins, paths, latency_budget_ms=600_000)
    assert checks_of(found) == [("H1_runtime", "one.csv"), ("H1_runtime", "two.csv")]


def test_jobs_beyond_the_limit_are_cancelled(spark, parts, monkeypatch):
    plan, spec, pins, paths = parts

    def endless(session, some, *args, **kwargs):
        rows = read_rows(session, some, *args, **kwargs)

        def wait(batches):
            for b in batches:
                time.sleep(60)
                yield b

        return rows.mapInPandas(wait, rows.schema)

    monkeypatch.setattr(service, "read_rows", endless)
    began = time.monotonic()
    found, emitted, _ = service.evaluate(spark, plan, spec, pins, paths, timeout_s=1)
    assert checks_of(found) == [("H1_runtime", "")] and emitted == 0 and time.monotonic() - began < 50
    monkeypatch.setattr(service, "read_rows", read_rows)
    assert checks_of(service.evaluate(spark, plan, spec, pins, paths, latency_budget_ms=600_000)[0]) == []


def write_case(root, name, **changes):
    d = root / "_adversarial" / name
    d.mkdir(parents=True)
    expect = {"against_client": "c", "must_fail": ["H1_runtime"], "notes": "n"} | changes
    (d / "expect.json").write_text(json.dumps({k: v for k, v in expect.items() if v is not None}))
    for f in manifest.CASE_FILES.values():
        (d / f).write_text("import socket\n")


def test_cases_on_disk(spark, corpus, tmp_path):
    import shutil

    assert manifest.adversarial_cases(spark, corpus) == []
    root = tmp_path / "corpus"
    shutil.copytree(corpus, root)
    write_case(root, "calls_home")
    write_case(root, "drops_last_row", must_fail=["H3_completeness"])
    cases = manifest.adversarial_cases(spark, str(root))
    assert [(c["name"], c["must_fail"], c["notes"]) for c in cases] == [("calls_home", ["H1_runtime"], "n"), ("drops_last_row", ["H3_completeness"], "n")]
    run = service.RunService(spark, str(root), str(tmp_path / "l"), str(tmp_path / "d"), latency_budget_ms=600_000)
    assert service.replay(run)["adversarial_rejected"] == "2 / 2"
    for name, change in (("a", {"against_client": "x"}), ("b", {"must_fail": []}), ("d", {"must_fail": ["H9"]}), ("e", {"against_client": None})):
        write_case(root, name, **change)
    (root / "_adversarial" / "calls_home" / "dag.py").unlink()
    with pytest.raises(ContractError) as e:
        manifest.adversarial_cases(spark, str(root))
    assert [p.split(":")[0] for p in str(e.value).split("; ")] == ["a", "b", "calls_home", "d", "e"]


def test_scenarios_fall_back(spark, corpus):
    root = corpus
    assert manifest.build_manifest(spark, root, "c", fallback={"c": {"expected_outcome": "heal"}})["scenario"]["expected_outcome"] == "pass"  # the written one counts
    import shutil
    from pathlib import Path

    fresh = Path(root).with_name("fresh-corpus")
    shutil.copytree(root, fresh)
    (fresh / "c" / "manifest.json").unlink()
    assert manifest.build_manifest(spark, str(fresh), "c", fallback={"c": {"expected_outcome": "heal"}})["scenario"]["expected_outcome"] == "heal"
    assert manifest.build_manifest(spark, str(fresh), "c")["scenario"] == manifest.PLAIN


def test_events_are_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_events(spark, path, [{"ts": "t1", "node": "plan", "run_id": "r", "n": 3}])
    files.append_events(spark, path, [{"ts": "t2", "node": "load", "run_id": "r", "when": None}, {"ts": "t3", "node": "end"}])
    rows = sorted(files.read_events(spark, path).collect())
    assert [(r.ts, r.node, (r.detail or {}).get("n")) for r in rows] == [("t1", "plan", "3"), ("t2", "load", None), ("t3", "end", None)]


def test_fences(spark):
    texts = ["none", SPEC, SPEC + "\n" + SPEC, SPEC.replace("\n", "\r\n"), "```yaml feed-contract\nopen", " ```yaml feed-contract\nx\n```\n", "```yaml  feed-contract\t\nx\n  ```", "```yaml feed-contracts\nx\n```\n", "```yaml feed-contract\n```\n"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", files.contract_block(F.col("t")).alias("b")).orderBy("i").collect()
    for r, text in zip(got, texts):
        blocks = contract_blocks(text)
        assert (r.b.blocks, r.b.block) == (len(blocks), blocks[0] if blocks else None), text
    assert [len(contract_blocks(t)) for t in texts] == [0, 1, 2, 1, 0, 0, 1, 0, 1]


def test_short_large_files_raise_alike(spark, tmp_path, corpus, monkeypatch):
    path = tmp_path / "short.csv"
    path.write_text("k,d,a,y\n")
    spec = files.load_contract(spark, corpus, "c")
    from dataclasses import replace

    plan = compile_plan(replace(spec, trailer_rows=1))
    for limit in (files.LARGE_BYTES, 0):
        monkeypatch.setattr(files, "LARGE_BYTES", limit)
        with pytest.raises(Exception, match="fewer than 2 lines"):
            require(read_rows(spark, [str(path)], plan)).collect()
        assert read_rows(spark, [str(path)], plan, strict=False).collect() == []


def test_totals_and_first_sound(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted(map(tuple, metrics.with_total(rows, "k").collect()), key=repr) == [("a", 2), ("total", 3), (None, 1)]
    dags = spark.createDataFrame([("c", 0, "bad", "x"), ("c", 1, None, "y"), ("c", 2, None, "z"), ("d", 0, "bad", "x")], "client string, idx int, error string, dag_id string")
    assert [(r.client, r.dag_id) for r in tables.first_sound(dags, ["client"], ["idx"], "error").collect()] == [("c", "y")]
    from datetime import datetime

    assert reports.text_table([{"a": datetime(2026, 1, 2, 3, 4, 5, 678)}], ["a"]).split("\n")[1] == "2026-01-02 03:04:05"
