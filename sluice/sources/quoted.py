"""Delimited records whose quoted fields run over line ends.

Whether a line end lies within quotes depends on all that stands before it, so it is a scan over the file. A line
is a function on two states, outside and inside of a quoted field, and functions compose. So splits are scanned by
themselves first: each gives its function and how many records begin in it, for either state at its start. A pass over
these, a row a split, gives every split its true state and its first record's number; a second pass over the lines then
numbers the records. Only lines of records over several lines are shuffled, to be put together: no task holds a file, and
none more than its split's run of lines at a time.

The machine for quotes is that of delimited files: a quote opens a field only where the field begins, two of them
within are one, and a quote after other text is text. What follows a closing quote up to the delimiter belongs to the field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.contract import FeedContract
from .files import by_split, numbered_lines, sample_of

AT_START, INSIDE, CLOSED, WITHIN = 0, 1, 2, 3


def ends_inside(line: Column, delimiter: str, inside: bool) -> Column:
    """Whether a line ends within a quoted field, given whether it begins in one."""
    pieces = F.split(line, '"', -1)
    before = F.slice(pieces, 1, F.size(pieces) - 1)  # what stands before each quote

    def step(state: Column, text: Column) -> Column:
        opens = text.endswith(delimiter)
        opened = F.when(opens, F.lit(INSIDE)).otherwise(F.lit(WITHIN))
        return (
            F.when(state == INSIDE, F.lit(CLOSED)).when((state == CLOSED) & (text == ""), F.lit(INSIDE))
            .when((state == AT_START) & (text == ""), F.lit(INSIDE)).otherwise(opened)
        )

    return F.aggregate(before, F.lit(INSIDE if inside else AT_START), step) == INSIDE


def _states(out: np.ndarray, stay: np.ndarray, first: bool) -> np.ndarray:
    """The state at each line's start and after the last: out, stay: whether a line ends inside from outside and from inside."""
    fixed, swaps = out == stay, np.cumsum(out & ~stay)
    n = len(out)
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))  # the last line whose end doesn't depend on its start
    value = np.where(last >= 0, out[np.maximum(last, 0)], first)
    since = swaps - np.where(last >= 0, swaps[np.maximum(last, 0)], 0)
    return np.concatenate(([first], value ^ (since % 2 == 1)))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(sample, block, start, end) of the runs of lines of one split."""
    sample, block = batch.column(0), batch.column(1).to_numpy()
    codes = sample.dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(block, prepend=block[0]) != 0))
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
        yield sample[s].as_py(), int(block[s]), s, e


def _summaries(marked: DataFrame) -> DataFrame:
    """A row a split: what it makes of either state (out, stay), and how many records begin in it (n_out, n_stay)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, None]
        split, made = None, []

        def end() -> None:
            if split is not None:
                made.append((*split, *(x for pair in zip(*held) for x in pair)))

        for batch in batches:
            if not batch.num_rows:
                continue
            out, stay = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for sample, block, s, e in _runs(batch):
                if (sample, block) != split:
                    end()
                    split, held = (sample, block), [(False, 0), (True, 0)]
                for k, (state, n) in enumerate(held):
                    got = _states(out[s:e], stay[s:e], state)
                    held[k] = (bool(got[-1]), n + int((~got[:-1]).sum()))
        end()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["sample", "block", "out", "stay", "n_out", "n_stay"])

    return marked.select("sample", "block", "out", "stay").mapInArrow(run, "sample string, block long, out boolean, stay boolean, n_out long, n_stay long")


def _placed(splits: DataFrame) -> DataFrame:
    """(sample, block, inside, before): each split's state at its start and how many records begin before it."""

    def of_file(frame):
        frame = frame.sort_values("block", kind="stable")
        inside, before, rows = False, 0, []
        for r in frame.itertuples():
            rows.append((r.sample, r.block, inside, before))
            before += r.n_stay if inside else r.n_out
            inside = r.stay if inside else r.out
        return type(frame)(rows, columns=["sample", "block", "inside", "before"])

    return splits.groupBy("sample").applyInPandas(of_file, "sample string, block long, inside boolean, before long")


def join_lines(lines: DataFrame, delimiter: str = ",", joint: str = "\n") -> DataFrame:
    """(sample, idx, line): records from lines (sample, block, idx, line) whose blocks are whole and in order in their partitions.

    joint stands between the lines of a record; idx numbers the records of a file from 0. A quoted field that never ends
    takes the rest of its file as one record, which is then held whole by one task. Null lines don't occur.
    """
    line = F.col("line")
    no_quote = ~F.contains(line, F.lit('"'))
    out = F.when(no_quote, False).otherwise(ends_inside(line, delimiter, False))
    stay = F.when(no_quote, True).otherwise(ends_inside(line, delimiter, True))
    numbered = _numbered(lines.withColumns({"out": out, "stay": stay}))
    parts = F.array_sort(F.collect_list(F.struct("idx", "line")))
    longer = numbered.filter("not whole").groupBy("sample", "record").agg(F.array_join(F.transform(parts, lambda p: p["line"]), joint).alias("line"))
    return numbered.filter("whole").select("sample", F.col("record").alias("idx"), "line").unionByName(longer.select("sample", F.col("record").alias("idx"), "line"))


def _shifts(pieces: DataFrame, width: int) -> DataFrame:
    """A row a split: what the lengths of its pieces sum to, and at which sums pieces begin (a bit each), modulo width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, begins, made = None, 0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(2).to_numpy()
            for path, block, s, e in _runs(batch):
                if (path, block) != split:
                    if split is not None:
                        made.append((*split, at, begins))
                    split, at, begins = (path, block), 0, 0
                starts = (at + np.cumsum(size[s:e]) - size[s:e]) % width
                begins |= int(np.bitwise_or.reduce(1 << starts))
                at = int(starts[-1] + size[e - 1]) % width
        if split is not None:
            made.append((*split, at, begins))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["path", "block", "shift", "begins"])

    sizes = pieces.select("path", "block", F.octet_length("raw").cast("long").alias("size"))
    return sizes.mapInArrow(run, "path string, block long, shift long, begins long")


def _cut_across(pieces: DataFrame, width: int) -> DataFrame:
    """(path, block, at, owner) of splits that begin or end within a record: at which byte of a character one begins, and in which split the record does."""

    def of_file(frame):
        frame = frame.sort_values("block", kind="stable")
        at, owner, rows = 0, 0, []
        for r in frame.itertuples():
            end = (at + r.shift) % width
            if at or end:
                rows.append((r.path, r.block, at, owner))
            if r.begins >> (-at % width) & 1:
                owner = r.block
            at = end
        return type(frame)(rows, columns=["path", "block", "at", "owner"])

    return _shifts(pieces, width).groupBy("path").applyInPandas(of_file, "path string, block long, at long, owner long")


def join_pieces(pieces: DataFrame, width: int, separator: bytes) -> tuple[DataFrame, DataFrame | None]:
    """(path, block, raw, first): pieces of bytes put together that were parted at separators across characters of `width` bytes.

    pieces: path, block and raw, as they are scanned. A cut is a true one if it lies at a multiple of width; as a separator is as long
    as a character, that is what the lengths of the pieces before it sum to. The first frame has the records that begin and end in
    one split, where they are and in order. The other, if it takes one, has those that run over a split's end, one a split at most, and only they
    are shuffled; each is a block of its own: 2 * block + 1, where the others of the split in which it begins have 2 * block. first: whether it is
    a file's first.
    """
    names = ["path", "block", "raw", "first", "owner"]
    # A row a split at most, and few by nature: a split begins within a record only where its end is a separator's bytes across characters.
    held = _cut_across(pieces, width).toPandas()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, owner, seen, top, parts = None, 0, None, False, False, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.int64()))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            size, raw = pc.binary_length(batch.column(2)).to_numpy(), batch.column(2)
            for path, block, s, e in _runs(batch):
                if (path, block) != split:
                    if parts:
                        yield made([(*split, separator.join(parts), top, owner)])
                    split, at, owner, seen, parts = (path, block), batch.column(3)[s].as_py(), batch.column(4)[s].as_py(), False, []
                ends = (at + np.cumsum(size[s:e])) % width
                if not at and not ends.any():
                    first = np.zeros(e - s, bool)
                    first[0] = not seen and not block
                    seen = True
                    yield pa.RecordBatch.from_arrays([*batch.slice(s, e - s).columns[:3], pa.array(first), pa.nulls(e - s, pa.int64())], names)
                    continue
                rows = []
                for k, end in zip(range(s, e), ends.tolist()):
                    if not at:
                        owner, top, seen = block, not seen and not block, True
                    elif not parts:
                        top = False
                    parts.append(raw[k].as_py())
                    at = end
                    if not at:
                        rows.append((path, block, separator.join(parts), top, None if owner == block else owner))
                        parts = []
                if rows:
                    yield made(rows)
        if parts:
            yield made([(*split, separator.join(parts), top, owner)])

    def joined(begun: DataFrame, at: Column, owner: Column) -> DataFrame:
        begun = begun.select("path", "block", "raw", at.cast("long").alias("at"), owner.cast("long").alias("owner"))
        return begun.mapInArrow(run, "path string, block long, raw binary, first boolean, owner long")

    own = ["path", (2 * F.col("block")).alias("block"), "raw", "first"]
    if not len(held):
        return joined(pieces, F.lit(0), F.lit(None)).select(*own), None
    cut = F.broadcast(pieces.sparkSession.createDataFrame(held, "path string, block long, at long, owner long"))
    inside = joined(pieces.join(cut, ["path", "block"], "left"), F.coalesce("at", F.lit(0)), F.col("owner")).filter("owner is null")
    over = joined(pieces.join(cut, ["path", "block"]), F.col("at"), F.col("owner")).filter("owner is not null")
    parts = F.array_sort(F.collect_list(F.struct("block", "raw", "first")))
    glued = F.aggregate(F.slice(parts, 2, F.size(parts)), parts[0]["raw"], lambda a, p: F.concat(a, F.lit(separator), p["raw"]))
    over = over.groupBy("path", "owner").agg(glued.alias("raw"), F.bool_or("first").alias("first"))
    return inside.select(*own), over.select("path", (2 * F.col("owner") + 1).alias("block"), "raw", "first")


def _numbered(marked: DataFrame) -> DataFrame:
    """(sample, block, record, whole, idx, line) from lines with out and stay: the record that each is of, and whether it is all of it."""
    rows = by_split(marked, _placed(_summaries(marked)), ["sample", "block"], "idx").select("sample", "block", "out", "stay", "inside", "before", "idx", "line")
    schema = T.StructType([T.StructField("sample", T.StringType()), T.StructField("block", T.LongType()), T.StructField("record", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("idx", T.LongType()), T.StructField("line", marked.schema["line"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, number = None, False, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            out, stay, inside = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            before = batch.column(5).to_numpy()
            record, whole = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, bool)
            for sample, block, s, e in _runs(batch):
                if (sample, block) != split:
                    split, state, number = (sample, block), bool(inside[s]), int(before[s]) - 1
                got = _states(out[s:e], stay[s:e], state)
                record[s:e] = number + np.cumsum(~got[:-1])
                whole[s:e] = ~got[:-1] & ~got[1:]
                state, number = bool(got[-1]), int(record[e - 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(record), pa.array(whole), batch.column(6), batch.column(7)], schema.names)

    return rows.mapInArrow(run, schema)


def quoted_records(spark: SparkSession, paths: str | list[str], spec: FeedContract, strict: bool = True, joint: str = "\n") -> DataFrame:
    """(sample, idx, line): the records of UTF-8 delimited files of any size, lines of one record put together with `joint`.

    Header, trailer and blank lines go by the contract, as lines, before records are put together. An empty joint runs
    the lines of a field together; a line feed keeps line ends, whatever they were in the file.
    """
    lines = numbered_lines(spark, paths, spec, strict, ordered=True).withColumnRenamed("path", "sample")
    return join_lines(lines, spec.delimiter, joint).withColumn("sample", sample_of("sample"))
