"""File sources: framed lines, records of three formats, catalogs and logs.

A feed file is a text with header lines at its top and trailer lines at its end;
blank lines may be dropped before these are counted. Small files are read whole
and framed as arrays. Large ones are read as splittable text: each split's lines are
counted, the counts added up per file, and a line's place follows from its place in
its split, so no task ever holds a file.
"""

from __future__ import annotations

import csv
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ContractError, FeedError
from ..functions.text import is_blank, split_lines
from ..plans.contract import FENCE, LANGUAGE, FeedContract, parse_contract, slice_of
from ..schemas import EVENTS

#: Files from this size on are framed without being read whole.
LARGE_BYTES = 64 << 20
#: Fixed value: the characters of a plain name.
SAFE_NAME = re.compile(r"[A-Za-z0-9._-]+")
SAMPLE = r"([^/]+)$"
#: Fixed value: the characters of LINE_END, each of which ends a line.
END_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def safe_name(name: str) -> str:
    """A plain file or directory name; anything else is an error."""
    if not SAFE_NAME.fullmatch(name) or name in (".", ".."):
        raise ContractError(f"{name!r} is not a plain name")
    return name


def sample_of(path: Column) -> Column:
    return F.regexp_extract(path, SAMPLE, 1)


#: Charsets that Spark decodes, by codec names without punctuation.
CHARSETS = {
    "utf8": "UTF-8", "latin1": "ISO-8859-1", "iso88591": "ISO-8859-1", "ascii": "US-ASCII", "usascii": "US-ASCII",
    "utf16": "UTF-16", "utf16le": "UTF-16LE", "utf16be": "UTF-16BE", "utf32": "UTF-32",
}


def charset(encoding: str) -> str:
    """Spark's name of an encoding; one that it lacks is an error."""
    name = re.sub("[^a-z0-9]", "", encoding.lower())
    if name not in CHARSETS:
        raise ContractError(f"encoding {encoding!r} isn't supported")
    return CHARSETS[name]


def read_texts(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """sample and the whole text of each file, in any encoding that Java knows."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(sample_of("path").alias("sample"), F.decode("content", charset(encoding)).alias("text"))


def lines_of(text: Column, skip_blank: bool) -> Column:
    lines = split_lines(text)
    return F.filter(lines, lambda x: ~is_blank(x)) if skip_blank else lines


def frame(texts: DataFrame, header_rows: int, trailer_rows: int, skip_blank: bool = True) -> DataFrame:
    """sample, n_lines, header and body (arrays) of each text; a text too short for both has an empty body."""
    lines = texts.select("sample", lines_of(F.col("text"), skip_blank).alias("lines"))
    n = F.size("lines")
    return lines.select(
        "sample", n.alias("n_lines"), F.slice("lines", 1, F.least(n, F.lit(header_rows))).alias("header"),
        F.slice("lines", header_rows + 1, F.greatest(n - header_rows - trailer_rows, F.lit(0))).alias("body"),
    )


def framed_lines(texts: DataFrame, spec: FeedContract, strict: bool = True) -> DataFrame:
    """sample, idx (from 0) and line of each data line; strict: a file too short raises."""
    framed = frame(texts, spec.header_rows, spec.trailer_rows, spec.skip_blank_lines)
    body = F.col("body")
    if strict:
        need = spec.header_rows + spec.trailer_rows
        short = F.raise_error(F.concat(F.col("sample"), F.lit(f": fewer than {need} lines")))
        body = F.when(F.col("n_lines") < need, short.cast("array<string>")).otherwise(body)
    return framed.select("sample", F.posexplode(body).alias("idx", "line")).withColumn("idx", F.col("idx").cast("long"))


def framed_lines_large(spark: SparkSession, paths: str | list[str], spec: FeedContract, strict: bool = True) -> DataFrame:
    """As framed_lines, for UTF-8 files of any size."""
    return numbered_lines(spark, paths, spec, strict).select(sample_of("path").alias("sample"), "idx", "line")


#: Facts of splits, a row each, are broadcast up to this many.
BROADCAST_SPLITS = 500_000


def by_split(rows: DataFrame, facts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with the facts of their split; the rows of a split stay together and in order."""
    held = facts.limit(BROADCAST_SPLITS + 1).toPandas()
    if len(held) <= BROADCAST_SPLITS:
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(held, facts.schema)), keys)
    return rows.join(facts, keys).repartition(*keys).sortWithinPartitions(*keys, order)


def numbered_lines(spark: SparkSession, paths: str | list[str], spec: FeedContract, strict: bool = True, ordered: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """path, block (where its split begins), idx and line of each data line; splits are counted first, then placed.

    ordered: the lines of a split come together and in order; that counts the splits then and there, and lines aren't shuffled. rows:
    path, block and value, in order as they are scanned, where lines are read in another way than as UTF-8. Places follow from
    partitions, which come out alike for the counts and the lines only if no shuffle stands before; after one a row has to be
    `alone` in its block.
    """
    if rows is None:
        rows = spark.read.text(paths).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
        )
    at, value = F.monotonically_increasing_id(), F.col("value")
    # Most values are one line, which searches for bytes tell in a fraction of the time that a pattern takes.
    several = reduce(Column.__or__, (F.contains(value, F.lit(c)) for c in END_CHARS))
    lines = F.when(several, split_lines(F.concat(value, F.lit("\n")))).otherwise(F.array(value))
    if "alone" in rows.columns:
        lines = F.filter(lines, lambda x: ~is_blank(x)) if spec.skip_blank_lines else lines
        rows = rows.select("path", "block", "alone", F.posexplode(lines).alias("pos", "line"))
        at = F.when(F.col("alone"), F.col("pos").cast("long")).otherwise(at)
    else:
        rows = rows.select("path", "block", F.explode(lines).alias("line"))
        if spec.skip_blank_lines:
            rows = rows.filter(~is_blank(F.col("line")))
    rows = rows.select("path", "block", "line", at.alias("at"))
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    by_file = Window.partitionBy("path")
    before = F.sum("n").over(by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    total, need = F.sum("n").over(by_file), spec.header_rows + spec.trailer_rows
    if strict:
        short = F.raise_error(F.concat(sample_of("path"), F.lit(f": fewer than {need} lines")))
        total = F.when(total < need, short.cast("long")).otherwise(total)
    placed = counts.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"), total.alias("total"))
    idx = F.col("before") + F.col("at") - F.col("first") - spec.header_rows
    joined = by_split(rows, placed, ["path", "block"], "at") if ordered else rows.join(placed, ["path", "block"])
    numbered = joined.select("path", "block", idx.alias("idx"), "line", "total")
    return numbered.filter((F.col("idx") >= 0) & (F.col("idx") < F.col("total") - spec.header_rows - spec.trailer_rows)).select("path", "block", "idx", "line")


def header_names(spark: SparkSession, path: str, spec: FeedContract, strict: bool = True) -> list[str]:
    """Column names of one delimited file: its last header line, or the contract's sources where there is none."""
    if spec.header_rows == 0:
        if strict:
            raise ContractError(f"{spec.client}: a delimited file needs a header")
        return [c.source for c in spec.columns]
    if charset(spec.encoding) == "UTF-8":
        lines = spark.read.text(path, wholetext=False)
        if spec.skip_blank_lines:
            lines = lines.filter(~is_blank(F.col("value")))
        found = [r.value for r in lines.limit(spec.header_rows).collect()]
    else:
        found = frame(read_texts(spark, path, spec.encoding), spec.header_rows, 0, spec.skip_blank_lines).first()["header"]
    if len(found) < spec.header_rows:
        raise ContractError(f"{PurePosixPath(path).name}: no header")
    return names_of(found[spec.header_rows - 1], spec, strict)


@contextmanager
def partition_a_file(spark: SparkSession) -> Iterator[None]:
    """Within this, scans that begin give each file (and each split of a large one) a partition of its own."""
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key, None)
    # A file counts as a whole partition by the cost of opening it.
    spark.conf.set(key, str(1 << 40))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _line_at(spark: SparkSession, paths: list[str], k: int, skip_blank: bool) -> dict[str, str]:
    """The k-th line of each UTF-8 file that has one, by path, in one scan of them."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    if skip_blank:
        lines = lines.filter(~is_blank(F.col("value")))
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    if k == 1:
        found = lines.groupBy("path").agg(F.min_by("value", F.struct("block", "at")).alias("value"))
    else:  # tasks keep k lines a file
        found = lines.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("block", "at"))).filter(F.col("k") <= k).filter(F.col("k") == k)
    return {r.path: r.value for r in found.select("path", "value").collect()}


def _line_at_top(spark: SparkSession, paths: list[str], k: int, skip_blank: bool) -> dict[str, str]:
    """As _line_at, for large files: a task reads the first split of one file and leaves off where it has the line. A file
    whose first split has too few lines has no entry."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if batch.num_rows and batch.column(1)[0].as_py():
                return
            for path, value in zip(batch.column(0), batch.column(2)):
                line = value.as_py()
                seen += not skip_blank or bool(line.strip())
                if seen == k:
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([line])], ["path", "value"])
                    return

    with partition_a_file(spark):
        return {r.path: r.value for r in lines.mapInArrow(run, "path string, value string").collect()}


def header_names_of(spark: SparkSession, paths: list[str], spec: FeedContract, strict: bool = True) -> list[tuple[str, ...]]:
    """header_names of many files: a job for small ones, a job for large ones; other encodings, and large files with too little in their
    first split, take a job each."""
    if spec.header_rows == 0 or charset(spec.encoding) != "UTF-8" or len(paths) < 2:
        return [tuple(header_names(spark, p, spec, strict)) for p in paths]
    plain = lambda p: unquote(re.sub(r"^file:/+", "/", p))
    sizes = {plain(r.path): r.length for r in spark.read.format("binaryFile").load(paths).select("path", "length").collect()}
    large = [p for p in paths if sizes.get(plain(p), 0) >= LARGE_BYTES]
    small = [p for p in paths if p not in set(large)]
    found = _line_at(spark, small, spec.header_rows, spec.skip_blank_lines) if small else {}
    found |= _line_at_top(spark, large, spec.header_rows, spec.skip_blank_lines) if large else {}
    found = {plain(p): line for p, line in found.items()}
    return [tuple(names_of(found[plain(p)], spec, strict) if plain(p) in found else header_names(spark, p, spec, strict)) for p in paths]


def names_of(header: str, spec: FeedContract, strict: bool) -> list[str]:
    names = next(csv.reader([header], delimiter=spec.delimiter))
    return names if strict else [x.strip() for x in names]


def with_csv(lines: DataFrame, names: list[str], delimiter: str, strict: bool) -> tuple[DataFrame, dict[str, Column]]:
    """Lines parsed as delimited fields, and a column per name; strict sets `_fault` where the field count differs."""
    schema = ", ".join(f"f{i} string" for i in range(len(names))) + ", _corrupt string"
    options = {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "multiLine": "true"}
    parsed = lines.withColumn("_r", F.from_csv("line", schema, options))
    wrong = F.when(F.col("_r._corrupt").isNotNull() | (F.col("line") == ""), F.lit(f"expected {len(names)} fields"))
    parsed = parsed.withColumn("_fault", wrong if strict else F.lit(None).cast("string"))
    return parsed, {n: F.coalesce(F.col(f"_r.f{i}"), F.lit("")) for i, n in enumerate(names)}


def with_fixed(lines: DataFrame, sources: list[str], strict: bool) -> tuple[DataFrame, dict[str, Column]]:
    """Lines as fixed slices; short lines give empty or shorter fields."""
    out = {}
    for s in sources:
        a, b = slice_of(s)
        out[s] = F.substring("line", a + 1, b - a)
    return lines.withColumn("_fault", F.lit(None).cast("string")), out


def with_json(lines: DataFrame, keys: list[str], strict: bool) -> tuple[DataFrame, dict[str, Column]]:
    """Lines as flat JSON objects; numbers keep their exact value (zeros at the end of a fraction go), null is empty."""
    parsed = lines.withColumn("_v", F.try_parse_json("line"))
    bad = F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT")
    parsed = parsed.withColumn("_fault", F.when(bad, F.lit("not a JSON object")))
    path = lambda k: "$[" + "'" + k.replace("'", "\\'") + "']" if not re.fullmatch(r"[A-Za-z_]\w*", k) else f"$.{k}"
    return parsed, {k: F.try_variant_get("_v", path(k), "string") for k in keys}


def records(spark: SparkSession, lines: DataFrame, spec: FeedContract, names: list[str] | None = None, strict: bool = True) -> tuple[DataFrame, dict[str, Column]]:
    """Lines with their raw fields by source name; names: those of a delimited file."""
    wanted = [c.source for c in spec.columns]
    signs = [c.sign_column for c in spec.columns if c.sign_column]
    if spec.format == "csv":
        return with_csv(lines, names if names is not None else wanted, spec.delimiter, strict)
    if spec.format == "fixed_width":
        return with_fixed(lines, wanted if strict else [*wanted, *signs], strict)
    return with_json(lines, list(dict.fromkeys([*wanted, *signs])), strict)


# --- catalogs -------------------------------------------------------------------


def with_digests(files: DataFrame, content: str = "content") -> DataFrame:
    """The same rows with bytes and sha256 of a binary column instead of it."""
    return files.withColumns({"bytes": F.octet_length(content).cast("long"), "sha256": F.sha2(F.col(content), 256)}).drop(content)


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """client, name, bytes and sha256 of every sample under root/<client>/samples."""
    files = spark.read.format("binaryFile").load(f"{root}/*/samples/*")
    named = files.select(F.regexp_extract("path", r"([^/]+)/samples/[^/]+$", 1).alias("client"), sample_of("path").alias("name"), "content")
    return with_digests(named).orderBy("client", "name")


def list_clients(spark: SparkSession, root: str) -> list[str]:
    """Directories with a spec.md, sorted."""
    files = spark.read.format("binaryFile").load(f"{root}/*/spec.md")
    return sorted(r[0] for r in files.select(F.regexp_extract("path", r"([^/]+)/spec\.md$", 1)).distinct().collect())


def load_contract(spark: SparkSession, root: str, client: str) -> FeedContract:
    """A client's contract."""
    text = read_texts(spark, f"{root}/{safe_name(client)}/spec.md").first()
    return parse_contract(text["text"], client)


def contract_block(text: Column) -> Column:
    """blocks, how many contract blocks a text has, and block, the first one: as contract_blocks, in one pass over the lines."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    fence, said = F.lit(FENCE), F.lit(" ".join(LANGUAGE))
    names = ("open", "blocks", "begin", "first", "n")
    made = lambda parts: F.struct(*(p.alias(n) for p, n in zip(parts, names)))
    start = made((F.lit(False), F.lit(0), F.lit(0), F.lit(1), F.lit(0)))

    def step(acc: Column, row: Column) -> Column:
        x, i = row["x"], row["i"]
        closes = acc["open"] & F.regexp_replace(x, r"\A[ \t]+", "").startswith(fence)
        words = F.trim(F.regexp_replace(F.substring(x, len(FENCE) + 1, 1 << 20), r"[ \t]+", " "))
        opens = ~acc["open"] & x.startswith(FENCE + LANGUAGE[0]) & (words == said)
        whole = closes & (acc["blocks"] == 0)  # the first block is kept by the numbers of its lines
        return made((
            opens | (acc["open"] & ~closes), acc["blocks"] + closes.cast("int"), F.when(opens, i + 1).otherwise(acc["begin"]),
            F.when(whole, acc["begin"] + 1).otherwise(acc["first"]), F.when(whole, i - acc["begin"]).otherwise(acc["n"]),
        ))

    def out(acc: Column) -> Column:
        block = F.array_join(F.slice(lines, acc["first"], acc["n"]), "\n")
        return F.struct(acc["blocks"].alias("blocks"), F.when(acc["blocks"] > 0, block).alias("block"))

    return F.aggregate(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), start, step, out)


def contracts(spark: SparkSession, root: str) -> DataFrame:
    """client, blocks (how many contract blocks there are) and the first block of every spec."""
    files = spark.read.format("binaryFile").load(f"{root}/*/spec.md")
    found = files.select(F.regexp_extract("path", r"([^/]+)/spec\.md$", 1).alias("client"), contract_block(F.decode("content", "UTF-8")).alias("b"))
    return found.select("client", "b.blocks", "b.block")


def sample_paths(spark: SparkSession, root: str, client: str) -> list[str]:
    """Paths of a client's samples, sorted by name."""
    files = spark.read.format("binaryFile").load(f"{root}/{safe_name(client)}/samples/*")
    return sorted((r[0] for r in files.select("path").collect()), key=lambda p: PurePosixPath(p).name)


def peek(texts: DataFrame, rows: int = 5) -> DataFrame:
    """The first lines of each text, header included: at least 1, at most 5."""
    lines = split_lines(F.col("text"))
    return texts.select("sample", F.posexplode(F.slice(lines, 1, max(1, min(rows, 5)))).alias("idx", "line"))


def append_events(spark: SparkSession, path: str, events: list[dict]) -> None:
    """Adds events (ts, node, run_id, and anything else as detail) to the log, a line each; values that aren't text are written as text."""
    fixed = ("ts", "node", "run_id")
    as_text = lambda v: None if v is None else v if isinstance(v, str) else str(v)
    rows = [(*(as_text(e.get(k)) for k in fixed), {k: as_text(v) for k, v in e.items() if k not in fixed}) for e in events]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The event log: JSON lines; blank lines are skipped."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENTS).json(path)


def read_output(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of a transform; rows that aren't such get their text in `_corrupt` instead of an error."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


# --- folders ----------------------------------------------------------------------


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share; it goes when the application ends. Only in local mode is it a temporary one of this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise FeedError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="sluice-")
    path = f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a work folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small UTF-8 file to any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
