"""Arrow plumbing shared by the operators whose kernels are numpy or Python.

A kernel sees whole texts in slices of a bounded number of bytes, so that its
working memory does not follow the size of an Arrow batch. Kept columns travel
under internal names, so that a clash with a result column cannot break a plan:
an input column with the name of a result column is left out of the output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes in one column; no row is cut."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n + 16
    yield batch.slice(start)


def byte_texts(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def texts(array: pa.Array) -> list[str]:
    return [x or "" for x in array.to_pylist()]


def map_texts(
    df: DataFrame,
    text: str,
    outputs: Sequence[tuple[str, str]],
    factory: Callable[[], Callable[..., Sequence[pa.Array]]],
    keep: Sequence[str] = (),
    also: Sequence[str] = (),
) -> DataFrame:
    """Rows of `df` with the columns `keep` and those that a kernel makes of each text.

    `factory` runs once per task and returns the kernel; that takes the text
    array and the arrays of `also` and returns one Arrow array per output.
    """
    made = {n.lower() for n, _ in outputs}
    kept = [n for n in keep if n.lower() not in made]
    fields = {f.name: f for f in df.schema.fields}
    ins = [col(text).cast("string").alias("_t"), *(col(n).alias(f"_a{i}") for i, n in enumerate(also))]
    narrow = df.select(*ins, *(col(n).alias(f"_k{i}") for i, n in enumerate(kept)))
    out = T.StructType([T.StructField(f"_k{i}", fields[n].dataType) for i, n in enumerate(kept)])
    for i, (_, kind) in enumerate(outputs):
        out = out.add(T.StructField(f"_o{i}", T._parse_datatype_string(kind)))
    first = 1 + len(also)
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = factory()
        for batch in batches:
            for part in slices(batch, 0):
                ready = kernel(*(part.column(i) for i in range(first)))
                yield pa.RecordBatch.from_arrays([*(part.column(first + i) for i in range(len(kept))), *ready], names)

    return narrow.mapInArrow(run, out).toDF(*kept, *(n for n, _ in outputs))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], flush_rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of about `flush_rows` rows, from batches that are sorted by `keys`."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < flush_rows:
            continue
        table = pa.Table.from_batches(held)
        last = pa.array([True] * table.num_rows)
        for name in keys:
            c = table.column(name)
            last = pc.and_(last, pc.equal(c, c[-1]))
        cut = table.num_rows - (pc.sum(last).as_py() or 0)
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            size = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)
