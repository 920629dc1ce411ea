import pytest
from hypothesis import given
from hypothesis import strategies as st

from sluice.errors import ContractError, PlanError
from sluice.functions.text import java_pattern
from sluice.plans.contract import parse_block, parse_contract
from sluice.plans.plan import DEFECTS, IngestionPlan, compile_plan, dag, inject, mapping_document, plan_diff

SPEC = """# A feed

```yaml feed-contract
client: shop
feed_name: till
format: csv
delimiter: ";"   # not a comma
header_rows: 2
trailer_rows: 1
expected_row_count: 3
columns:
  - {source: "Ref", target: trade_id}
  - {source: "Day", target: value_date, dtype: date, date_format: "%d/%m/%Y"}
  - source: Amt
    target: amount
    dtype: decimal
    sign_column: "DrCr"
    negative_marker: 'D'
  - {source: "DrCr", target: null}
  - {source: "Ccy", target: currency, default: usd}
quirks:
  - "Amounts: with commas, #1 of all."
```
"""


def test_contract_is_parsed():
    spec = parse_contract(SPEC, "shop")
    assert (spec.delimiter, spec.header_rows, spec.trailer_rows, spec.expected_row_count, spec.encoding) == (";", 2, 1, 3, "utf-8")
    assert [c.source for c in spec.columns] == ["Ref", "Day", "Amt", "DrCr", "Ccy"]
    assert spec.columns[2].negative_marker == "D" and spec.columns[3].target is None and spec.columns[4].default == "usd"
    assert spec.quirks == ("Amounts: with commas, #1 of all.",)
    assert parse_contract(SPEC.replace("\n", "\r\n"), "shop") == spec


@pytest.mark.parametrize(
    "old, new",
    [
        ("client: shop", "client: other"), ("target: trade_id", "target: nothing"), (', date_format: "%d/%m/%Y"', ""), ("negative_marker: 'D'", "default: x"),
        ("format: csv", "format: xml"), ("format: csv", "format: fixed_width"), ("feed_name: till", "feed_name: till\nextra: 1"), ("```yaml feed-contract", "```yaml"),
        ("dtype: decimal", "dtype: float"),
    ],
)
def test_bad_contracts(old, new):
    with pytest.raises(ContractError):
        parse_contract(SPEC.replace(old, new), "shop")


def test_two_blocks_are_an_error():
    with pytest.raises(ContractError):
        parse_contract(SPEC + SPEC)


@given(st.dictionaries(st.from_regex(r"\A[a-z]{1,6}\Z"), st.text(st.characters(codec="ascii", exclude_categories=["Cc"])), min_size=1))
def test_quoted_scalars_come_back(values):
    block = "\n".join(f'{k}: "{v.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"' for k, v in values.items())
    assert parse_block(block) == values


def test_date_patterns():
    assert java_pattern("%Y-%m-%d") == "yyyy-M-d"
    assert java_pattern("%Y%m%d") == "yyyyMMdd"
    assert java_pattern("%Y-%m-%dT%H:%M:%SZ") == "yyyy-M-d'T'H:m:s'Z'"
    with pytest.raises(PlanError):
        java_pattern("%j")


def test_plan_survives_json_and_documents_itself():
    plan = compile_plan(parse_contract(SPEC))
    assert IngestionPlan.from_json(plan.to_json()) == plan
    assert parse_block(mapping_document(plan))["client"] == "shop"
    assert dag(plan)["edges"] == [["extract", "transform"], ["transform", "load"]]


def test_every_defect_changes_its_plan():
    plan = compile_plan(parse_contract(SPEC))
    changed = {d: plan_diff(plan, inject(plan, d)) for d in DEFECTS if d != "wrong_slice"}
    assert all(changed.values())
    assert changed["date_format_swapped"] == [("contract.columns[1].date_format", '"%d/%m/%Y"', '"%m/%d/%Y"')]
    for bad in ("wrong_slice", "none"):
        with pytest.raises(PlanError):
            inject(plan, bad)
