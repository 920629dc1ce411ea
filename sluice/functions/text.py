"""Column functions of the conversions; NULL stands for a value that doesn't parse."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError

#: Line ends of the reference's text model, as a Java pattern.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

_JAVA = {"d": "d", "m": "M", "H": "H", "M": "m", "S": "s", "Y": "yyyy", "b": "MMM", "B": "MMMM", "f": "SSSSSS"}
_WIDE = {"d": "dd", "m": "MM", "H": "HH", "M": "mm", "S": "ss", "Y": "yyyy"}


def trim(c: Column) -> Column:
    """Without white space at either end, in Unicode's sense."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def split_lines(c: Column) -> Column:
    """Lines of a text; an end of line at its end begins no further one."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def java_pattern(fmt: str) -> str:
    """The date pattern of a strptime format; directives without an equal meaning are refused."""
    pieces = re.findall(r"%(.)|([^%]+)", fmt)
    out = []
    for i, (code, text) in enumerate(pieces):
        if not code:
            out.append("'" + text.replace("'", "''") + "'" if re.search("[A-Za-z']", text) else text)
            continue
        if code not in _JAVA:
            raise PlanError(f"date format {fmt!r}: %{code} isn't supported")
        compact = (i > 0 and pieces[i - 1][0]) or (i + 1 < len(pieces) and pieces[i + 1][0])
        out.append(_WIDE.get(code, _JAVA[code]) if compact else _JAVA[code])
    return "".join(out)


def iso_date(c: Column, fmt: str) -> Column:
    """Date in a strptime format as YYYY-MM-DD."""
    return F.date_format(F.try_to_timestamp(c, F.lit(java_pattern(fmt))), "yyyy-MM-dd")


def decimal_of(c: Column) -> Column:
    """A plain number as decimal(38,10)."""
    plain = c.rlike(r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z")
    return F.when(plain, c.try_cast("decimal(38,10)"))


def money(c: Column) -> Column:
    """A decimal with two places, rounded half up, as text."""
    return c.cast("decimal(38,2)").cast("string")


def signed(amount: Column, marker: Column, negative: str, any_case: bool) -> Column:
    """Minus the size if the marker says so, else the size."""
    m, n = trim(marker), F.lit(negative)
    hit = F.upper(m) == F.upper(n) if any_case else m == n
    return F.when(hit, -F.abs(amount)).otherwise(F.abs(amount))


def first_error(*cases: tuple[Column, Column | str]) -> Column:
    """The message of the first condition that holds, else NULL."""
    return F.coalesce(*(F.when(cond, msg if isinstance(msg, Column) else F.lit(msg)) for cond, msg in cases))


def truncated(c: Column, n: int) -> Column:
    """At most n characters, with a mark where some are left out."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("...[truncated]"))).otherwise(c)


def truncated_tail(c: Column, n: int) -> Column:
    """The last n characters, with a mark where some before them are left out."""
    return F.when(F.length(c) > n, F.concat(F.lit("[truncated]..."), F.right(c, F.lit(n)))).otherwise(c)


def run_id(client: Column, stamp: Column, seed: Column) -> Column:
    """client-YYYYmmddHHMMSS-6 hex; with a seed the time is zeros and the hex a digest's."""
    digest = F.substring(F.sha2(F.concat_ws(":", client, seed.cast("string")), 256), 1, 6)
    free = F.substring(F.sha2(F.concat_ws(":", client, stamp.cast("string")), 256), 1, 6)
    when = F.when(seed.isNotNull(), F.lit("0" * 14)).otherwise(F.date_format(stamp, "yyyyMMddHHmmss"))
    return F.concat_ws("-", client, when, F.when(seed.isNotNull(), digest).otherwise(free))
