"""Records over several lines, against the standard library's reader over all lines of a file."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from sluice.plans.contract import ColumnSpec, FeedContract
from sluice.sources import files, quoted


def contract(**changes):
    return FeedContract(**({"client": "c", "feed_name": "f", "format": "csv", "columns": (ColumnSpec("a", "trade_id"),), "header_rows": 0, "skip_blank_lines": False} | changes))


def plain(lines, delimiter, joint):
    """Fields of each record: lines are given to the reader with the joint where the next one goes on."""
    source = "".join(x + "\n" for x in lines)
    rows = list(csv.reader(iter(source.splitlines(keepends=True)), delimiter=delimiter))
    return [[f.replace("\n", joint) for f in r] for r in rows]


ALPHABET = ['"', '"', '""', ",", "a", "b c", "", ";", '"x"', ',"']


@pytest.mark.parametrize("delimiter, split", [(",", "1"), (",", "128m"), (";", "37")])
def test_any_text_at_any_split(spark, tmp_path, delimiter, split):
    r = random.Random(7)
    texts = {}
    for k in range(12):
        lines = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 7))) for _ in range(r.randrange(1, 60))]
        texts[f"f{k}.csv"] = [x for x in lines]
        (tmp_path / f"f{k}.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = quoted.quoted_records(spark, str(tmp_path), contract(delimiter=delimiter), joint="\n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, lines in texts.items():
        rows = sorted((x.idx, x.line) for x in got if x.sample == name)
        assert [i for i, _ in rows] == list(range(len(rows)))
        # Each record by itself reads as it does in its file; a field that never ends has no line feed at the file's end.
        mine = [next(csv.reader(iter(x.splitlines(keepends=True)), delimiter=delimiter), []) for _, x in rows]
        want = plain(lines, delimiter, "\n")
        if want and want[-1] and want[-1][-1].endswith("\n"):
            want[-1][-1] = want[-1][-1].removesuffix("\n")
        assert mine == want, name


def test_header_trailer_blank_lines_and_joint(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,v\n\n1,"a\n\nb"\n2,"c""\nd"\n\n3,e\nEND "of\n')
    got = quoted.quoted_records(spark, str(tmp_path / "x.csv"), contract(header_rows=1, trailer_rows=1, skip_blank_lines=True), joint="").collect()
    assert sorted((r.idx, r.line) for r in got) == [(0, '1,"ab"'), (1, '2,"c""d"'), (2, "3,e")]


def test_parsed_fields_keep_line_ends(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1,"a\nb, ""c"""\n2,plain\n3,"\n"\n')
    lines = quoted.quoted_records(spark, str(tmp_path / "x.csv"), contract())
    rows, raw = files.with_csv(lines, ["k", "v"], ",", strict=True)
    assert sorted((r.k, r.v, r._fault) for r in rows.select(raw["k"].alias("k"), raw["v"].alias("v"), "_fault").collect()) == [("1", 'a\nb, "c"', None), ("2", "plain", None), ("3", "\n", None)]


def test_many_splits_take_the_other_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BROADCAST_SPLITS", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        (tmp_path / "x.csv").write_text("".join(f'{i},"{"line " * 3}\n{i}\nend"\n' for i in range(400)))
        got = quoted.quoted_records(spark, str(tmp_path / "x.csv"), contract()).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.idx, r.line) for r in got) == [(i, f'{i},"{"line " * 3}\n{i}\nend"') for i in range(400)]


def test_same_names_and_no_rows(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.csv").write_text(f'"{d}\n1"\n')
    got = quoted.quoted_records(spark, [str(tmp_path / "a"), str(tmp_path / "b")], contract()).collect()
    assert sorted((r.idx, r.line) for r in got) == [(0, '"a\n1"'), (0, '"b\n1"')]
    (tmp_path / "e.csv").write_text("")
    assert quoted.quoted_records(spark, str(tmp_path / "e.csv"), contract()).count() == 0


def test_long_quoted_lines(spark):
    rows = spark.createDataFrame([('"' + 'x""' * 100_000,), ('a' * 300_000 + '",b',)], "line string")
    got = rows.select(quoted.ends_inside(F.col("line"), ",", False).alias("o"), quoted.ends_inside(F.col("line"), ",", True).alias("i")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False)]
