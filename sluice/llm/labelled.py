"""Bounded samples of labelled rows for the classifiers.

The sample is chosen among the labels alone, by a hash of the id, so that no text
is moved for it. The ids then go to a scan of the ids of the documents, which tells the
files that hold them, and only those files' texts are read: on a large table a few
thousand ids lie in a few thousand files at most, whatever the number of files.

Bounds: `per_class` rows of each label, and SAMPLE_CHARS characters in all, half for
each label: rows are taken in the order of the hash, whatever their length, and one
that no longer fits is passed over. Texts are never cut.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import settle

SAMPLE_CHARS = 32_000_000


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo `modulus`: which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def _in_their_files(documents: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of `documents` with one of some ids, read from the files that hold them where it is a table of files."""
    chosen = F.col("doc_id").isin(ids)
    path = F.col("_metadata.file_path")
    try:
        found = documents.filter(chosen).select(path.alias("f")).distinct().collect()  # ids only; at most one file an id
        return documents.filter(path.isin([r.f for r in found]) & chosen)
    except AnalysisException:  # no files behind it
        return documents.filter(chosen)


def training_rows(
    documents: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int,
    per_class: int, max_chars: int | None = None, sample_chars: int = SAMPLE_CHARS,
) -> pd.DataFrame:
    """At most `per_class` rows of each label: (doc_id, text, y).

    Rows whose remainder is `held_out`, rows without an id, text or label of 0 or 1, and, if
    `max_chars` is given, longer texts never take part. Where an id is repeated, its least text
    counts, and label 1 rather than 0. Rows are sorted by id: the sample is the same in every
    run and at any partitioning.
    """
    known = (
        labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(remainder(F.col("doc_id"), modulus) != held_out)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    )
    picked: dict[int, int] = {}
    for y in (0, 1):
        one = known.filter(F.col("y") == y).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked |= {r[0]: y for r in one.collect()}
    if not picked:
        return pd.DataFrame({"doc_id": [], "text": [], "y": []}).astype({"doc_id": "int64", "y": "int32"})
    rows = _in_their_files(documents, list(picked)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("text").isNotNull())
    if max_chars is not None:
        rows = rows.filter(F.length("text") <= max_chars)
    sample = settle(rows.groupBy("doc_id").agg(F.min("text").alias("text")), "sample")  # at most 2 * per_class rows
    sizes = {r[0]: r[1] for r in sample.select("doc_id", F.length("text")).collect()}
    left, taken = {0: sample_chars // 2, 1: sample_chars // 2}, []
    for doc_id, y in picked.items():
        if doc_id in sizes and sizes[doc_id] <= left[y]:
            left[y] -= sizes[doc_id]
            taken.append(doc_id)
    out = sample.filter(F.col("doc_id").isin(taken)).toPandas()
    out["y"] = out["doc_id"].map(picked).astype("int32")
    return out.sort_values("doc_id", ignore_index=True)
