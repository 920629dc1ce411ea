"""Thousands of files in one scan: headers by one job, times by file from the tasks' metrics."""

import pytest

from sluice import service
from sluice.errors import ContractError
from sluice.operators.transform import read_rows
from sluice.plans.contract import ColumnSpec, FeedContract
from sluice.plans.plan import compile_plan
from sluice.sources import files

SPEC = FeedContract(client="c", feed_name="f", format="csv", columns=(ColumnSpec("k", "trade_id"), ColumnSpec("d", "value_date", "date", "%Y-%m-%d")))
FILES, LONG = 2000, "f0777.csv"


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    top = tmp_path_factory.mktemp("many")
    for i in range(FILES):
        name = f"f{i:04d}.csv"
        n = 60_000 if name == LONG else 2
        (top / name).write_text("\nk,d\n" + "".join(f"{name}-{k},2026-01-02\n" for k in range(n)))
    return [f"{top}/f{i:04d}.csv" for i in range(FILES)]


def jobs_of(spark, act):
    tag = "count-jobs"
    spark.sparkContext.addJobTag(tag)
    try:
        out = act()
    finally:
        spark.sparkContext.removeJobTag(tag)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, len(list(spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag)))


def test_headers_by_few_jobs(spark, paths):
    found, jobs = jobs_of(spark, lambda: files.header_names_of(spark, paths, SPEC))
    assert found == [("k", "d")] * FILES and jobs <= 5  # two list the files, one has their sizes, two read


@pytest.mark.parametrize("large", [1, 1 << 40])
@pytest.mark.parametrize("rows", [1, 3])
def test_headers_of_large_and_small_files(spark, paths, monkeypatch, rows, large):
    from dataclasses import replace

    monkeypatch.setattr(files, "LARGE_BYTES", large)
    got = files.header_names_of(spark, paths[776:779], replace(SPEC, header_rows=rows))
    assert got == [("k", "d")] * 3 if rows == 1 else [g[0] for g in got] == ["f0776.csv-1", "f0777.csv-1", "f0778.csv-1"]


def test_headers_that_differ_or_lack(spark, tmp_path):
    texts = {"a b.csv": "k,d\n1,2\n", "b.csv": "\n \n\nd;k , x\n", "c.csv": "k,d\n", "d%20.csv": '"k,1",d\n'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    some = [f"{tmp_path}/{n}" for n in texts]
    assert files.header_names_of(spark, some, SPEC) == [("k", "d"), ("d;k ", " x"), ("k", "d"), ("k,1", "d")]
    assert files.header_names_of(spark, some, SPEC, strict=False)[1] == ("d;k", "x")
    (tmp_path / "e.csv").write_text("\n\n")
    with pytest.raises(ContractError):
        files.header_names_of(spark, [*some, f"{tmp_path}/e.csv"], SPEC)


def test_a_slow_file_among_two_thousand(spark, paths):
    plan = compile_plan(SPEC)
    rows = service.read_rows_a_file(spark, plan, paths, 1)
    assert "Union" not in rows._jdf.queryExecution().analyzed().toString()
    (kept, found), jobs = jobs_of(spark, lambda: service.scan_times(spark, rows))
    try:
        assert jobs <= 8  # whatever the number of files: adaptive execution runs each stage as a job
        assert len(found) == FILES and {n for s, (n, _) in found.items() if s != LONG} == {2} and found[LONG][0] == 60_000
        slow = max(found, key=lambda s: found[s][1])
        rest = sorted(ms for s, (_, ms) in found.items() if s != LONG)
        assert slow == LONG and found[LONG][1] > 3 * rest[len(rest) // 2]
        assert kept.filter("error is not null").count() == 0
    finally:
        kept.unpersist()


def test_times_of_many_files_as_one_scan(spark, paths):
    some = paths[770:790]
    plan = compile_plan(SPEC)
    got = service.timed_rows(spark, plan, some, 3)
    assert [n for _, n, _ in got] == [60_000 if p.endswith(LONG) else 2 for p in some] and all(ms >= 0 for _, _, ms in got)
    assert [r is None for r, _, _ in got] == [False] + [True] * 19
    assert got[0][0].filter("iteration = 3").count() == 60_038
    got[0][0].unpersist()
    assert read_rows(spark, some[:2], plan).count() == 4
