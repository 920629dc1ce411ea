"""Every query that has SQL gives what DuckDB gives on the same tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from sluice.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    return None if v is None or v != v else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    cols = sorted(mine.columns)
    theirs = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    rows = [dict(zip(names, r)) for r in theirs.fetchall()]
    assert sorted(names) == cols
    key = lambda r: tuple(map(repr, r))
    a = sorted((tuple(plain(r[c]) for c in cols) for r in mine.collect()), key=key)
    b = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=key)
    assert a == b


def test_entry_points(spark):
    assert entry.entry(spark).count() == 1
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert QUERIES["guard_scan"](spark, SF).count() == 4
