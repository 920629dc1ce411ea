"""Views of stored reports, and their rendering."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<!-- headline:begin -->", "<!-- headline:end -->"


def report_summary(findings: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, passed, a map of each check to whether it passed, and the error messages in the checks' order."""
    error = F.when(F.col("severity") == "error", F.struct("ordinal", "message"))
    joined = findings.join(F.broadcast(checks), "check")  # six rows
    failed = F.collect_set(F.when(F.col("severity") == "error", F.col("check")))
    every = F.array(*(F.lit(c) for c in _names(checks)))
    rows = joined.groupBy(*keys).agg(failed.alias("failed"), F.array_sort(F.collect_list(error)).alias("e"))
    return rows.select(
        *keys, (F.size("failed") == 0).alias("passed"),
        F.map_from_arrays(every, F.transform(every, lambda c: ~F.array_contains("failed", c))).alias("checks"),
        F.transform("e", lambda x: x["message"]).alias("errors"),
    )


def _names(checks: DataFrame) -> list[str]:
    return [r["check"] for r in checks.orderBy("ordinal").collect()]


def nested_texts(state: Column, path: str) -> Column:
    """An array of texts out of a JSON text; empty where it is absent or not one."""
    found = F.try_variant_get(F.try_parse_json(state), path, "array<string>")
    return F.coalesce(found, F.array().cast("array<string>"))


def recovered_json(text: Column) -> Column:
    """The JSON object in a text that may have prose or a code fence around it; NULL if there is none that parses."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def stored_errors(report_json: Column) -> Column:
    """The error findings of a stored report, in its order; none where it can't be read."""
    kind = "array<struct<check:string,severity:string,message:string>>"
    return F.coalesce(F.filter(F.from_json(report_json, kind), lambda f: f["severity"] == "error"), F.array().cast(kind))


def line_count(text: Column) -> Column:
    """Lines of a text; a line end at its end begins no further one."""
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)))


def text_table(rows: Sequence[dict], columns: Sequence[str]) -> str:
    """Rows as a table of fitted columns."""
    said = lambda v: f"{v:%Y-%m-%d %H:%M:%S}" if isinstance(v, datetime) else str(v)
    cells = [list(columns), *([said(r.get(c, "")) for c in columns] for r in rows)]
    width = [max(len(line[i]) for line in cells) for i in range(len(columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, width)).rstrip() for line in cells)


def shown(errors: Sequence[str], n: int = 3) -> list[str]:
    """The first n errors, and how many more there are."""
    return [*errors[:n], *([f"+{len(errors) - n} more"] if len(errors) > n else [])]


def headline_text(figures: dict) -> str:
    """Figures as canonical JSON: ASCII, two spaces, sorted keys, one line end; equal figures give equal bytes."""
    return json.dumps(figures, indent=2, sort_keys=True, ensure_ascii=True) + "\n"


def write_headline(figures: dict, path: str) -> None:
    with open(path, "w", encoding="ascii", newline="\n") as f:
        f.write(headline_text(figures))


def headline_table(figures: dict) -> str:
    """The plain figures as a Markdown table."""
    rows = [f"| {k.replace('_', ' ')} | {v} |" for k, v in figures.items() if isinstance(v, (str, int))]
    return "\n".join(["| figure | value |", "| --- | --- |", *rows])


def spliced(document: str, figures: dict) -> str:
    """The document with the table between its marks."""
    head, rest = document.split(BEGIN, 1)
    _, tail = rest.split(END, 1)
    return f"{head}{BEGIN}\n{headline_table(figures)}\n{END}{tail}"


def is_current(document: str, figures: dict) -> bool:
    """Whether the document holds these figures already."""
    return spliced(document, figures) == document
