"""Text files of any encoding and digests of files of any size, by splits.

Spark's text source cuts a file at line feeds and gives the bytes between them as they are, from any store that it reads.

* Encodings of a byte a character: bytes read as Latin-1 are characters one for one, and a translation of 256
  characters does the rest. The line feed is whatever byte the encoding has for it.
* UTF-16 and UTF-32: cut at the bytes of a line feed in that encoding. Such bytes also occur across characters, at
  places that are no multiple of a character's width. Whether a cut is one of these depends on the lengths of all pieces before it, modulo
  the width, so splits' lengths are summed up first, and then pieces are put together (`quoted`); only lines over a split's end are shuffled.
* East Asian encodings whose characters never hold a line feed's byte: lines are decoded in Python, batch by batch.

Digests: SHA-256 goes through a file from its beginning to its end, so a file is one stream: its pieces are sorted to
one task, which holds a batch of them and the state of the digest.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContractError
from ..plans.contract import FeedContract
from .files import LARGE_BYTES, numbered_lines, sample_of, with_digests
from .quoted import join_pieces

#: Encodings of several bytes a character in which a line feed's byte stands for nothing else.
LINEWISE = frozenset("gbk gb2312 gb18030 big5 big5hkscs cp950 shift_jis cp932 euc_jp euc_kr cp949".split())
WIDE = {"utf-16": 2, "utf-16-le": 2, "utf-16-be": 2, "utf-32": 4, "utf-32-le": 4, "utf-32-be": 4}
NO_CHARACTER = "\ufffd"


def codec_of(encoding: str) -> str:
    """Python's name of an encoding; an unknown one is an error."""
    try:
        return codecs.lookup(encoding).name
    except LookupError:
        raise ContractError(f"encoding {encoding!r} isn't known") from None


def single_byte(codec: str) -> str | None:
    """The character of each byte, where the encoding has one a byte (NO_CHARACTER where it has none for it)."""
    try:
        table = [bytes([b]).decode(codec, "replace") for b in range(256)]
    except (UnicodeError, LookupError):
        return None
    plain = all(len(c) == 1 for c in table) and codec not in LINEWISE and not codec.startswith(("utf", "iso2022", "hz", "johab", "punycode", "idna", "raw", "unicode"))
    return "".join(table) if plain else None


def translated(raw: Column, table: str, codec: str) -> Column:
    """Text of bytes in an encoding of a byte a character; a byte that has no character is an error."""
    latin = F.decode(raw, "ISO-8859-1")
    among = lambda places: latin.rlike("[" + "".join(f"\\x{{{i:x}}}" for i in places) + "]")
    changed = [i for i in range(256) if table[i] not in (chr(i), NO_CHARACTER)]
    holes = [i for i in range(256) if table[i] == NO_CHARACTER]
    if not changed and not holes:
        return latin
    text = F.translate(latin, "".join(map(chr, changed)), "".join(table[i] for i in changed)) if changed else latin
    if holes:
        text = F.when(among(holes), F.raise_error(F.lit(f"bytes that are nothing in {codec}")).cast("string")).otherwise(text)
    # Most texts have none of these, which a look tells sooner than a translation.
    return F.when(among([*changed, *holes]), text).otherwise(latin)


def raw_pieces(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """path, block and the bytes between separators, in order."""
    rows = spark.read.option("lineSep", separator).text(paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))


def _wide_pieces(spark: SparkSession, paths: str | list[str], codec: str, marked: bool = False) -> list[DataFrame]:
    """path, block, alone and value: lines of UTF-16 or UTF-32 files, cut where line feeds really are; marked: without the mark at the top.

    Those within a split, in order, then, if there are any, those over a split's end: alone in their block, and in no order.
    """
    width = WIDE[codec]
    feed = "\n".encode(codec)
    # UTF-32 has one name for both orders, and a mark that says which.
    mark = codecs.BOM_UTF32_LE if codec.endswith("le") else codecs.BOM_UTF32_BE
    value = F.decode("raw", f"UTF-16{codec[-2:].upper()}") if width == 2 else F.decode(F.concat(F.lit(mark), F.col("raw")), "UTF-32")
    if marked:
        value = F.when(F.col("first"), F.regexp_replace(value, "\\A\ufeff", "")).otherwise(value)
    inside, over = join_pieces(raw_pieces(spark, paths, feed.decode("latin-1")), width, feed)
    return [rows.select("path", "block", F.lit(alone).alias("alone"), value.alias("value")) for rows, alone in ((inside, False), (over, True)) if rows is not None]


def _big_endian(spark: SparkSession, paths: str | list[str], codec: str) -> tuple[list[str], list[str]]:
    """Files that begin with no big-endian mark, and those that do."""
    mark = codecs.BOM_UTF16_BE if WIDE[codec] == 2 else codecs.BOM_UTF32_BE
    rows = raw_pieces(spark, paths, "\n").filter("block = 0").withColumn("at", F.monotonically_increasing_id())
    found = rows.groupBy("path").agg(F.min_by(F.substring("raw", 1, len(mark)), "at").alias("top")).collect()  # a row a file
    return [r.path for r in found if bytes(r.top) != mark], [r.path for r in found if bytes(r.top) == mark]


def decoded_lines(spark: SparkSession, paths: str | list[str], encoding: str) -> DataFrame:
    """path, block and value of each line of files in any encoding; a line may still hold other line ends than the line feed.

    Lines are in order as they are scanned, but for those that a column `alone` marks: such a line is all of its block. Bytes that are
    nothing in the encoding are an error. Encodings with states between characters have no lines to cut at; they are refused.
    """
    codec = codec_of(encoding)
    if codec in ("utf-8", "utf-8-sig", "ascii"):
        rows = raw_pieces(spark, paths, "\n")
        text = F.decode("raw", "UTF-8" if codec != "ascii" else "US-ASCII")
        if codec == "utf-8-sig":
            text = F.when((F.col("block") == 0), F.regexp_replace(text, "\\A\ufeff", "")).otherwise(text)
        return rows.select("path", "block", text.alias("value"))
    if codec in ("utf-16", "utf-32"):
        little, big = _big_endian(spark, paths, codec)
        parts = [_wide_pieces(spark, some, f"{codec}-{end}", True) for some, end in ((little, "le"), (big, "be")) if some]
        # What is in order goes first: its partitions' numbers must not follow from how many a shuffle gives.
        parts = [p[0] for p in parts] + [p[1] for p in parts if len(p) > 1]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "path string, block long, value string")
    if codec in WIDE:
        return reduce(DataFrame.unionByName, _wide_pieces(spark, paths, codec))
    if table := single_byte(codec):
        feed = table.find("\n")
        if feed < 0 or feed > 127:
            raise ContractError(f"encoding {encoding!r} has no line feed")
        return raw_pieces(spark, paths, chr(feed)).select("path", "block", translated(F.col("raw"), table, codec).alias("value"))
    if codec not in LINEWISE:
        raise ContractError(f"encoding {encoding!r} can't be cut into lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [x.decode(codec) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["path", "block", "value"])

    return raw_pieces(spark, paths, "\n").mapInArrow(run, "path string, block long, value string")


def encoded_lines(spark: SparkSession, paths: str | list[str], spec: FeedContract, strict: bool = True) -> DataFrame:
    """sample, idx and line of each data line, as `framed_lines`, of files of any encoding and size."""
    lines = numbered_lines(spark, paths, spec, strict, ordered=True, rows=decoded_lines(spark, paths, spec.encoding))
    return lines.select(sample_of("path").alias("sample"), "idx", "line")


def digests(spark: SparkSession, paths: str | list[str], large: int = LARGE_BYTES) -> DataFrame:
    """path, bytes and sha256 of files of any size: those of `large` bytes and more as streams of pieces between line feeds.

    A piece has to fit in a row; files of less are read whole. Spark's listings leave out empty files: they have no row.
    """
    files = spark.read.format("binaryFile").load(paths)
    small = with_digests(files.filter(F.col("length") < large).select("path", "content"))
    names = [r.path for r in files.filter(F.col("length") >= large).select("path").collect()]
    if not names:
        return small
    rows = spark.read.option("lineSep", "\n").text(names)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("raw"))
    ordered = rows.withColumn("at", F.monotonically_increasing_id()).repartition("path").sortWithinPartitions("path", "block", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, seen, size, digest = None, 0, 0, hashlib.sha256()

        def end() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([seen], pa.int64()), pa.array([digest.hexdigest()])], ["path", "bytes", "sha256"])

        for batch in batches:
            for name, total, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if name != path:
                    if path is not None:
                        yield end()
                    path, seen, size, digest = name, 0, total, hashlib.sha256()
                piece = raw.as_py() + (b"\n" if seen + len(raw.as_py()) < size else b"")
                digest.update(piece)
                seen += len(piece)
        if path is not None:
            yield end()

    big = ordered.select("path", "size", "raw").mapInArrow(run, "path string, bytes long, sha256 string")
    return small.unionByName(big.select("path", "bytes", "sha256"))
