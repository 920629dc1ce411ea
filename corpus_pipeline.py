"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept. Rejected by the toxicity and the quality
model: gone. Of near duplicates the one with the least id stays; rows without an id
all stay. Documents with a benchmark passage go. What is left comes out as token ids.

Every stage but the last returns the rows it keeps as they are, with all their columns:
columns travel under names of their own, so that one named like a result of an operator
(score, items, fp ...) comes out unchanged. Null and empty texts have no words: they pass the
toxicity stage, the quality model judges their empty measures, in the near-duplicate stage
they are copies of one another, the benchmark doesn't touch them, and they encode to no ids. Texts of
any length are judged whole. Repeated rows get equal verdicts; of rows with one id that
are near copies, the least stays: by text, then by the other columns in their order. An empty
table passes every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import bpe, decontam, gam, simhash, toxicity
from sluice.llm.queries import table, vocabulary
from sluice.llm.staging import settle


def _renamed(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], str, str]:
    """docs under names that no operator uses, these names, and those of doc_id and text."""
    names = tuple(f"c{i}" for i in range(len(docs.columns)))
    doc_id, text = (names[docs.columns.index(n)] for n in ("doc_id", "text"))
    return docs.toDF(*names), names, doc_id, text


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows, names, _, text = _renamed(docs)
    scored = toxicity.score(rows, model, text, names)
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(*names).toDF(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject."""
    model = gam.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows, names, _, text = _renamed(docs)
    scored = gam.score(rows, model, text, names)
    return scored.filter(F.col("score") >= gam.THRESHOLD).select(*names).toDF(*docs.columns)


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Rows without an id stay. Where an id names several rows, the component of each is told
    by its id and fingerprint, and of its rows the least stays: by text, then by the other
    columns in their order (maps, which have no order, aside).
    """
    members = simhash.near_duplicates(docs)
    again = members.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        others = members.filter("doc_id != component_id").select("doc_id")
        return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    plain, names, doc_id, text = _renamed(docs)
    rows = simhash.fingerprints(plain, text, names)
    first = members.filter("doc_id = component_id").select(F.col("doc_id").alias(doc_id), "fp", "root").distinct()
    order = [F.coalesce(text, F.lit("")), *(f.name for f in plain.schema.fields if _sortable(f.dataType))]
    least = rows.join(first, [doc_id, "fp"]).groupBy("root").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r"))
    return least.select("r.*").union(rows.filter(F.col(doc_id).isNull()).select(*names)).toDF(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    rows, names, _, text = _renamed(docs)
    found = decontam.find_leaks(rows, table(spark, sf_dir, "benchmark"), text, names)
    return found.filter("n_hit = 0").select(*names).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe.encode_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Trained models and XXH64 are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
