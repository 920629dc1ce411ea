from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sluice.errors import ContractError
from sluice.operators.profile import as_pins, profile
from sluice.operators.transform import load, quarantine, read_rows, require
from sluice.plans.contract import ColumnSpec, FeedContract
from sluice.plans.plan import compile_plan
from sluice.sources import files

STRICT = FeedContract(
    client="c", feed_name="f", format="csv", trailer_rows=1,
    columns=(
        ColumnSpec("Ref", "trade_id", "int"), ColumnSpec("Day", "value_date", "date", "%d/%m/%Y"), ColumnSpec("Amt", "amount", "decimal", sign_column="DrCr", negative_marker="D"),
        ColumnSpec("DrCr"), ColumnSpec("Ccy", "currency", default="usd"), ColumnSpec("Cpty", "counterparty"),
    ),
)
CSV = 'Ref,Day,Amt,DrCr,Ccy,Cpty\n007,1/9/2026,"1,250.005",D,gbp, Bank \n\n8,02/09/2026,300.5,C,,"say ""x"""\n9,03/09/2026,-0.004,C,eur,\nTRAILER,3\n'


def rows_of(spark, tmp_path, text, spec, strict=True, name="a.csv", encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return [tuple(r)[3:] for r in read_rows(spark, [str(p)], compile_plan(spec), strict).orderBy("idx").collect()]


def test_strict_csv(spark, tmp_path):
    assert rows_of(spark, tmp_path, CSV, STRICT) == [
        ("7", "", "2026-09-01", "-1250.01", "GBP", "Bank", "", None), ("8", "", "2026-09-02", "300.50", "USD", 'say "x"', "", None), ("9", "", "2026-09-03", "0.00", "EUR", "", "", None),
    ]


@pytest.mark.parametrize(
    "old, new, said",
    [("02/09/2026", "31/02/2026", "not a date"), ("300.5", "", "not an amount"), ("300.5", "NaN", "not an amount"), ("8,02", "8.5,02", "not a whole number"), ('"say ""x"""', "x,y", "expected 6 fields"), (',"say ""x"""', "", "expected 6 fields")],
)
def test_strict_errors_name_the_row(spark, tmp_path, old, new, said):
    errors = [r[-1] for r in rows_of(spark, tmp_path, CSV.replace(old, new), STRICT)]
    assert errors[0] is None and errors[2] is None and errors[1].startswith("data row 2: ") and said in errors[1]


def test_require_and_quarantine(spark, tmp_path):
    (tmp_path / "b.csv").write_text(CSV.replace("300.5", "x"))
    rows = read_rows(spark, [str(tmp_path / "b.csv")], compile_plan(STRICT))
    good, bad = quarantine(rows)
    assert (good.count(), bad.count()) == (2, 1)
    with pytest.raises(Exception, match="data row 2"):
        require(rows).collect()
    assert load(good, str(tmp_path / "out")) == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_too_few_lines_and_no_header(spark, tmp_path):
    with pytest.raises(Exception, match="fewer than 2 lines"):
        rows_of(spark, tmp_path, "Ref,Day,Amt,DrCr,Ccy,Cpty\n", STRICT)
    with pytest.raises(ContractError):
        rows_of(spark, tmp_path, CSV, replace(STRICT, header_rows=0))


def test_lenient(spark, tmp_path):
    text = "Ref , Day,Amt,DrCr,Ccy,Cpty\n7.9,1/9/2026,(12.00),c,,A\n8\n9,,-,d,,B,extra\n"
    spec = replace(STRICT, trailer_rows=0)
    assert rows_of(spark, tmp_path, text, spec, strict=False) == [
        ("7", "", "2026-09-01", "12.00", "USD", "A", "", None), ("8", "", "", "0.00", "USD", "", "", None), ("9", "", "", "0.00", "USD", "B", "", None),
    ]
    plain = replace(STRICT, header_rows=0, trailer_rows=0)
    assert rows_of(spark, tmp_path, "1,2/9/2026,5,D,eur,Z\n", plain, strict=False)[0][:5] == ("1", "", "2026-09-02", "-5.00", "EUR")


FIXED = FeedContract(client="c", feed_name="f", format="fixed_width", encoding="latin-1", trailer_rows=1, columns=(ColumnSpec("0:4", "trade_id"), ColumnSpec("4:14", "amount", "decimal"), ColumnSpec("14:17", "currency"), ColumnSpec("17:25", "counterparty")))


def test_fixed_width_in_another_encoding(spark, tmp_path):
    text = "BANNER\nT001    1200.5gbpCafé \n\nT002       -80usd\nEND\n"
    got = rows_of(spark, tmp_path, text, FIXED, name="f.txt", encoding="latin-1")
    assert [r[:6] for r in got] == [("T001", "", "", "1200.50", "GBP", "Café"), ("T002", "", "", "-80.00", "USD", "")]
    with pytest.raises(ContractError):
        files.charset("klingon")


JSONL = FeedContract(client="c", feed_name="f", format="jsonl", header_rows=0, columns=(ColumnSpec("id", "trade_id"), ColumnSpec("amt", "amount", "decimal", sign_column="dir", negative_marker="DEBIT"), ColumnSpec("flag", "description"), ColumnSpec("at", "value_date", "date", "%Y-%m-%dT%H:%M:%SZ")))


def test_jsonl_keeps_digits(spark, tmp_path):
    text = '{"id":"a","amt":12345678901234567890.12,"dir":"DEBIT","flag":true,"at":"2026-09-01T23:59:59Z"}\n{"id":"b","amt":"3","dir":"CREDIT","flag":null,"at":"2026-09-01T00:00:00Z"}\n[1]\n'
    got = rows_of(spark, tmp_path, text, JSONL, strict=False, name="j.jsonl")
    assert got[0] == ("a", "", "2026-09-01", "-12345678901234567890.12", "", "", "true", None)
    assert got[1] == ("b", "", "2026-09-01", "3.00", "", "", "", None)
    assert "not a JSON object" in got[2][-1]


def test_large_files_are_framed_like_small_ones(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.txt").write_text("head\n" + "".join(f"line {k} {i}\n" + "\n" * (i % 5 == 0) for i in range(700 + k)) + "tail")
    spec = FeedContract(client="c", feed_name="f", format="fixed_width", trailer_rows=2, columns=(ColumnSpec("0:4", "trade_id"),))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        large = files.framed_lines_large(spark, str(tmp_path / "p*.txt"), spec).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    small = files.framed_lines(files.read_texts(spark, str(tmp_path / "p*.txt")), spec).collect()
    assert sorted(map(tuple, large)) == sorted(map(tuple, small)) and len(small) == 699 + 700 + 701


def test_large_feeds_give_the_same_rows(spark, tmp_path, monkeypatch):
    usual = rows_of(spark, tmp_path, CSV, STRICT)
    (tmp_path / "b.csv").write_text(CSV)
    monkeypatch.setattr(files, "LARGE_BYTES", len(CSV) + 1)
    both = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    (tmp_path / "b.csv").write_text(CSV.replace("TRAILER", "10,04/09/2026,1,C,eur,\nTRAILER"))
    mixed = read_rows(spark, both, compile_plan(STRICT)).orderBy("sample", "idx").collect()
    assert [tuple(r)[3:] for r in mixed if r.sample == "a.csv"] == usual and [r.idx for r in mixed if r.sample == "b.csv"] == [0, 1, 2, 3]
    shorter = read_rows(spark, both, replace(compile_plan(STRICT), drop_last_row=True)).groupBy("sample").count().orderBy("sample").collect()
    assert [r["count"] for r in shorter] == [2, 3]


def test_catalog_peek_and_names(spark, tmp_path):
    d = tmp_path / "corpus" / "c" / "samples"
    d.mkdir(parents=True)
    (d / "x.csv").write_text("a\nb\nc\n")
    (d.parent / "spec.md").write_text("none")
    root = str(tmp_path / "corpus")
    assert files.list_clients(spark, root) == ["c"]
    row = files.catalog(spark, root).first()
    assert (row.client, row["name"], row.bytes, len(row.sha256)) == ("c", "x.csv", 6, 64)
    assert [r.line for r in files.peek(files.read_texts(spark, str(d / "x.csv")), 2).collect()] == ["a", "b"]
    assert files.peek(files.read_texts(spark, str(d / "x.csv")), 99).count() == 3 and files.peek(files.read_texts(spark, str(d / "x.csv")), 0).count() == 1
    for bad in ("..", "a/b", ""):
        with pytest.raises(ContractError):
            files.safe_name(bad)


def test_profile(spark):
    rows = spark.createDataFrame([("s", "1", "a", "2026-01-01", a, c, p, "") for a, c, p in (("0.10", "GBP", ""), ("0.20", "USD", "x"), ("-0.30", "USD", ""), ("1000000.01", "GBP", "y"))], "sample string, trade_id string, account_id string, value_date string, amount string, currency string, counterparty string, description string")
    got = as_pins(profile(rows)).first()
    assert (got.rows, got.amount_sum, got.null_rate["counterparty"], got.distinct["currency"], got.distinct["counterparty"], got.distinct["amount"]) == (4, "1000000.01", 0.5, 2, 3, 4)
    empty = profile(rows.filter("false"), ()).first()
    assert (empty.rows, empty.null_amount, empty.distinct_amount, empty.amount_sum) == (0, 0.0, 0, 0)


def test_odd_lines(spark):
    texts = spark.createDataFrame([("a", "x\x0by\r\nz w\x85"), ("b", ""), ("c", "\n \n")], "sample string, text string")
    got = {r.sample: r.body for r in files.frame(texts, 0, 0, skip_blank=False).collect()}
    assert got == {"a": ["x", "y", "z", "w"], "b": [], "c": ["", " "]}
    assert files.frame(texts, 0, 0).filter(F.col("sample") == "c").first().body == []


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_a_header_after_many_blank_lines(spark, tmp_path, encoding):
    path = tmp_path / "blank.csv"
    path.write_text("\n \n" * 150 + "a,b\n\n1,2\n")
    spec = replace(STRICT, encoding=encoding)
    assert files.header_names(spark, str(path), spec) == ["a", "b"]
