"""Feed contracts: one fenced block of a client's spec.md, parsed and validated."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields

from ..errors import ContractError
from ..schemas import CANONICAL

#: The fence of a contract block, and what its first line says.
FENCE, LANGUAGE = "```", ("yaml", "feed-contract")
SLICE = re.compile(r"(\d+):(\d+)")
#: Formats and types that a contract may name.
FORMATS = ("csv", "fixed_width", "jsonl")
DTYPES = ("str", "date", "decimal", "int")


# The fields of both classes and their defaults are the contract's file format.


@dataclass(frozen=True)
class ColumnSpec:
    """How one source column maps to the canonical schema; without a target it is dropped."""

    source: str
    target: str | None = None
    dtype: str = "str"
    date_format: str | None = None
    sign_column: str | None = None
    negative_marker: str | None = None
    default: str | None = None


@dataclass(frozen=True)
class FeedContract:
    """What a client says of a feed."""

    client: str
    feed_name: str
    format: str
    columns: tuple[ColumnSpec, ...]
    delimiter: str = ","
    encoding: str = "utf-8"
    header_rows: int = 1
    trailer_rows: int = 0
    skip_blank_lines: bool = True
    schedule_cron: str = "0 6 * * 1-5"
    expected_row_count: int | None = None
    quirks: tuple[str, ...] = field(default=())


def slice_of(source: str) -> tuple[int, int]:
    """Bounds of a fixed-width source, half-open."""
    m = SLICE.fullmatch(source)
    if not m or int(m[1]) >= int(m[2]):
        raise ContractError(f"{source!r} is not a non-empty start:end slice")
    return int(m[1]), int(m[2])


# --- the part of YAML that contracts use: scalars, lists, flow and block mappings ---

_TOKEN = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[{}\[\],]|:(?=\s|$|[{\["'])|[^\s{}\[\],:"'][^{}\[\],]*?(?=\s*(?:[{}\[\],]|:\s|:$|$)))""")


def _scalar(text: str):
    text = text.strip()
    if text[:1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    return text


def _flow(text: str):
    tokens = [m[1] for m in _TOKEN.finditer(text)]
    at = 0

    def value():
        nonlocal at
        head = tokens[at]
        at += 1
        if head == "{":
            out = {}
            while tokens[at] != "}":
                key = _scalar(tokens[at])
                at += 1
                if tokens[at] != ":":
                    raise ContractError(f"bad mapping {text!r}")
                at += 1
                out[key] = value()
                if tokens[at] == ",":
                    at += 1
            at += 1
            return out
        if head == "[":
            out = []
            while tokens[at] != "]":
                out.append(value())
                if tokens[at] == ",":
                    at += 1
            at += 1
            return out
        return _scalar(head)

    try:
        return value()
    except IndexError:
        raise ContractError(f"unbalanced {text!r}") from None


def _uncomment(line: str) -> str:
    return re.sub(r"""^((?:[^#"']|"(?:[^"\\]|\\.)*"|'[^']*')*?)(?:(?<=\s)|^)#.*$""", r"\1", line).rstrip()


def _value(text: str):
    return _flow(text) if text.lstrip()[:1] in ("{", "[") else _scalar(text)


def parse_block(text: str) -> dict:
    """The mapping of a contract block."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in map(_uncomment, text.replace("\r\n", "\n").split("\n")) if x.strip()]

    def mapping(i: int, indent: int) -> tuple[dict, int]:
        out: dict = {}
        while i < len(lines) and lines[i][0] == indent and not lines[i][1].startswith("- "):
            m = re.fullmatch(r"""("[^"]*"|'[^']*'|[^:\s][^:]*?)\s*:(?:\s+(.*))?""", lines[i][1])
            if not m:
                raise ContractError(f"cannot read {lines[i][1]!r}")
            key, rest = _scalar(m[1]), m[2]
            i += 1
            if rest:
                out[key] = _value(rest)
            elif i < len(lines) and lines[i][1].startswith("- ") and lines[i][0] >= indent:
                out[key], i = items(i, lines[i][0])
            else:
                out[key] = None
        return out, i

    def items(i: int, indent: int) -> tuple[list, int]:
        out = []
        while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
            rest = lines[i][1][2:].strip()
            if rest[:1] not in "{[\"'" and re.match(r"[^:\s]+\s*:(\s|$)", rest):
                lines[i] = (indent + 2, rest)
                one, i = mapping(i, indent + 2)
                out.append(one)
            else:
                out.append(_value(rest))
                i += 1
        return out, i

    out, end = mapping(0, lines[0][0] if lines else 0)
    if end != len(lines):
        raise ContractError(f"cannot read {lines[end][1]!r}")
    return out


def _made(kind, values: dict, where: str):
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ContractError(f"{where}: unknown keys {sorted(unknown)}")
    try:
        return kind(**values)
    except TypeError as e:
        raise ContractError(f"{where}: {e}") from None


def contract_of(values: dict) -> FeedContract:
    """A validated contract from a mapping."""
    values = dict(values)
    cols = values.pop("columns", None) or ()
    if not isinstance(cols, (list, tuple)) or not all(isinstance(c, dict) for c in cols):
        raise ContractError("contract: columns are not a list of mappings")
    columns = tuple(_made(ColumnSpec, {k: (str(v) if k in ("source", "default", "negative_marker") and v is not None else v) for k, v in c.items()}, "column") for c in cols)
    quirks = tuple(values.pop("quirks", None) or ())
    spec = _made(FeedContract, values | {"columns": columns, "quirks": quirks}, "contract")
    if spec.format not in FORMATS:
        raise ContractError(f"{spec.client}: unknown format {spec.format!r}")
    if not columns:
        raise ContractError(f"{spec.client}: no columns")
    for c in columns:
        if c.target is not None and c.target not in CANONICAL:
            raise ContractError(f"{spec.client}: {c.target!r} is not canonical")
        if c.dtype not in DTYPES:
            raise ContractError(f"{spec.client}: unknown dtype {c.dtype!r}")
        if c.dtype == "date" and not c.date_format:
            raise ContractError(f"{spec.client}: {c.source} is a date without date_format")
        if c.sign_column and c.negative_marker is None:
            raise ContractError(f"{spec.client}: {c.source} has a sign_column without negative_marker")
        if spec.format == "fixed_width":
            slice_of(c.source)
    return spec


def contract_blocks(markdown: str) -> list[str]:
    """The texts between a line that opens a contract block and the next line that begins with a fence."""
    out, held = [], None
    for line in markdown.split("\n"):
        line = line.removesuffix("\r")
        if held is not None and line.lstrip(" \t").startswith(FENCE):
            out.append("\n".join(held))
            held = None
        elif held is not None:
            held.append(line)
        elif line.startswith(FENCE + LANGUAGE[0]) and tuple(line.removeprefix(FENCE).split()) == LANGUAGE:
            held = []
    return out


def parse_contract(markdown: str, client: str | None = None) -> FeedContract:
    """The one contract of a spec; none, several, or another client's is an error."""
    found = contract_blocks(markdown)
    if len(found) != 1:
        raise ContractError(f"{client or 'spec'}: expected one feed-contract block, found {len(found)}")
    spec = contract_of(parse_block(found[0]))
    if client is not None and spec.client != client:
        raise ContractError(f"{client}: contract names {spec.client!r}")
    return spec


def to_dict(spec: FeedContract) -> dict:
    return asdict(spec)
