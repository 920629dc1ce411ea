"""Chat formatting by columnar byte assembly.

Each turn is an opening marker, its text and a closing marker. The markers are those
of MARKERS; a role that is not listed is written [ROLE=name] ... [/ROLE], its
name percent-encoded. A text in which a marker would begin gets a backslash
after the marker's first character, one more where backslashes stand there already,
so that no marker occurs inside a text and the text can be had back.

The turns of a batch are put together in numpy: lengths of all segments, their
cumulative offsets, and scatter indices that copy markers and texts into one
preallocated buffer, which becomes the Arrow column.

Turns are dealt out by conversation and block of TURN_BLOCK turn numbers, and sorted by turn,
then role and text (ties). Conversations of several blocks or of over HOT_TURNS turns are dealt
out by ranges of that order instead, so that one with a large share of all rows, or with many
turns that are null or equal, is spread over tasks. A conversation comes out as parts, by
block, task and number, whose texts joined are the whole. Null texts and roles are empty; a text
of any length is one turn. Null turns are a block of their own, the first; null conversation ids
are one conversation; repeated rows are repeated turns; an empty table gives none. Only the four
columns named are read, so that others may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import col, slices
from .staging import settle

MARKERS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
LOSS_ROLE = "assistant"
TURN_BLOCK = 512
HOT_TURNS = 8 * TURN_BLOCK
#: Ranges are told apart by so many characters of a text.
RANGE_CHARS = 32
BROADCAST_ROWS = 200_000

SUSPECT = r"\[\\*/?(?:SYS\]|INST\]|ROLE[=\]])|<\\*/?s>"
_ESCAPE = re.compile(r"\[(\\*)(?=/?(?:SYS\]|INST\]|ROLE[=\]]))|<(\\*)(?=/?s>)")
_UNESCAPE = re.compile(r"([\[])\\(\\*)(?=/?(?:SYS\]|INST\]|ROLE[=\]]))|(<)\\(\\*)(?=/?s>)")
_TURN = re.compile(r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE=(?P<name>[^\]]*)\](?P<other>.*?)\[/ROLE\]", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4] or ""), text)


def markers(role: str) -> tuple[str, str]:
    return MARKERS.get(role) or (f"[ROLE={quote(role, safe='')}]", "[/ROLE]")


def assemble(roles: list[str], contents: pa.Array, turn_of: np.ndarray) -> pa.Array:
    """Texts of consecutive turns, one per run of `turn_of`.

    contents: large_string array of escaped texts; turn_of: for each turn the number of its text, ascending.
    """
    kinds = sorted(set(roles))
    number = {r: i for i, r in enumerate(kinds)}
    kind = np.fromiter((number[r] for r in roles), np.int64, len(roles))
    marks = [m.encode() for r in kinds for m in markers(r)]
    mark_len = np.array([len(m) for m in marks], np.int64)
    mark_at = np.cumsum(mark_len) - mark_len
    mark_bytes = np.frombuffer(b"".join(marks), np.uint8)
    _, offsets, data = contents.buffers()
    at = np.frombuffer(offsets, np.int64)[contents.offset : contents.offset + len(contents) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.column_stack([mark_len[2 * kind], np.diff(at), mark_len[2 * kind + 1]]).ravel()
    ends = np.cumsum(lengths)
    begins = (ends - lengths).reshape(-1, 3)
    out = np.empty(int(ends[-1]), np.uint8)

    def copy(source: np.ndarray, from_: np.ndarray, to: np.ndarray, n: np.ndarray) -> None:
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = source[np.repeat(from_, n) + step]

    copy(mark_bytes, mark_at[2 * kind], begins[:, 0], mark_len[2 * kind])
    copy(body, at[:-1], begins[:, 1], np.diff(at))
    copy(mark_bytes, mark_at[2 * kind + 1], begins[:, 2], mark_len[2 * kind + 1])
    first = np.flatnonzero(np.diff(turn_of, prepend=-1))
    text_at = np.append(begins[first, 0], ends[-1])
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(text_at.astype(np.int64)), pa.py_buffer(out))


def block_of(turn: Column) -> Column:
    """Which block of turn numbers a turn belongs to."""
    return F.coalesce(F.floor(turn / TURN_BLOCK).cast("long"), F.lit(-(2**62)))


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", ranges: bool = False,
) -> DataFrame:
    """conv_id, block, task, part, formatted and loss_mask: [start, end) of the assistant texts in code points of the part.

    A conversation's parts are in the order of block, task and part. ranges: deal out by ranges of turns, roles and
    beginnings of texts, which splits blocks, too.
    """
    empty = F.lit("")
    turns = rows.select(
        col(conv_id).alias("conv_id"), block_of(col(turn)).alias("block"), col(turn).alias("turn"),
        F.coalesce(col(role).cast("string"), empty).alias("role"), F.coalesce(col(text).cast("string"), empty).alias("text"),
    )
    if ranges:
        dealt = turns.repartitionByRange("conv_id", "block", "turn", "role", F.left("text", F.lit(RANGE_CHARS)))
    else:
        dealt = turns.repartition("conv_id", "block")
    dealt = dealt.sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    kind = dict(turns.dtypes)["conv_id"]
    mask_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part, any_before, task = None, 0, False, TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, 4):
                ids = list(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()))
                new = np.fromiter((i > 0 and ids[i] != ids[i - 1] for i in range(len(ids))), np.int64, len(ids))
                turn_of = np.cumsum(new)
                roles = piece.column(3).to_pylist()
                contents = piece.column(4).cast(pa.large_string())
                if pc.any(pc.match_substring_regex(contents, SUSPECT)).as_py():
                    contents = pa.array([escape(x) for x in contents.to_pylist()], pa.large_string())
                formatted = assemble(roles, contents, turn_of)
                first = np.flatnonzero(np.diff(turn_of, prepend=-1))
                masks: list[list[dict]] = [[] for _ in first]
                chars = pc.utf8_length(contents).to_numpy(zero_copy_only=False)
                if any(r == LOSS_ROLE for r in roles):
                    # The same offsets, in code points.
                    marks = np.array([[len(m) for m in markers(r)] for r in roles], np.int64)
                    step = marks.sum(1) + chars
                    at = np.cumsum(step) - step
                    base = np.repeat(at[first], np.diff(np.append(first, len(roles))))
                    for i in np.flatnonzero(np.array(roles, object) == LOSS_ROLE).tolist():
                        start = int(at[i] - base[i] + marks[i, 0])
                        masks[turn_of[i]].append({"start": start, "end": start + int(chars[i])})
                heads = [ids[i] for i in first.tolist()]
                parts = [0] * len(heads)
                parts[0] = part + 1 if any_before and heads[0] == before else 0
                before, part, any_before = heads[-1], parts[-1], True
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(i).take(pa.array(first)) for i in (0, 1)), pa.array([task] * len(parts), pa.int64()), pa.array(parts, pa.int64()), formatted.cast(pa.string()), pa.array(masks, mask_type)],
                    ["conv_id", "block", "task", "part", "formatted", "loss_mask"],
                )

    return dealt.mapInArrow(run, f"conv_id {kind}, block long, task long, part long, formatted string, loss_mask array<struct<start:long,end:long>>")


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back."""
    out = []
    for m in _TURN.finditer(formatted):
        if m["name"] is not None:
            out.append((unquote(m["name"]), unescape(m["other"])))
        else:
            out.append((m.lastgroup, unescape(m[m.lastgroup])))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """What each conversation says, read back from the output of format_conversations.

    The parts of a conversation must lie in order in one partition; they stream through
    running digests. conversation_digests sees to that.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows, arrow_type = None, [], None

        def close():
            rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush():
            cols = list(zip(*rows)) or [[]] * 6
            types = [arrow_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            arrow_type = batch.schema.field(0).type
            for piece in slices(batch, 4):
                for conv, text, mask in zip(*(piece.column(i).to_pylist() for i in (0, 4, 5))):
                    if state is None or conv != state[0]:
                        if state is not None:
                            close()
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, said in turns_of(text):
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode())
                    for span in mask:
                        said = unescape(text[span["start"] : span["end"]])
                        state[3] += len(said)
                        state[4].update(said.encode())
                    state[5] += len(text)
                if rows:
                    yield flush()
        if state is not None:
            close()
            yield flush()

    return formatted.mapInArrow(run, schema)


def conversation_digests(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The digests of all conversations of a table of turns.

    A conversation of one block and at most HOT_TURNS turns is whole in one partition and is read
    back there. The parts of longer ones, formatted in many tasks, are brought together in order: a
    digest runs from end to end. Which are longer is found from ids and turn numbers alone.
    """
    plain = rows.select(col(conv_id).alias("conv_id"), col(turn).alias("turn"), col(role).alias("role"), col(text).alias("text"))
    spans = plain.groupBy("conv_id").agg(F.min(block_of(F.col("turn"))).alias("a"), F.max(block_of(F.col("turn"))).alias("b"), F.count("*").alias("n"))
    longer = settle(spans.filter((F.col("a") != F.col("b")) | (F.col("n") > HOT_TURNS)).select(F.col("conv_id").alias("_long")), "longer")
    n = longer.count()
    if not n:
        return digests(format_conversations(plain))
    if n <= BROADCAST_ROWS:
        longer = F.broadcast(longer)
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = digests(format_conversations(plain.join(longer, same, "left_anti")))
    parts = format_conversations(plain.join(longer, same, "left_semi"), ranges=True)
    return short.union(digests(parts.repartition("conv_id").sortWithinPartitions("conv_id", "block", "task", "part")))
