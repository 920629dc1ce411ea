"""The pipeline's stages on columns named like results, ties, empty tables, and against the models themselves."""

import hashlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from sluice.llm import gam, toxicity
from sluice.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")
NAMES = ("score", "items", "spans", "n_words", "n_hit", "fp", "root", "component_id", "word_spans", "_row", "_text", "n_tokens", "first", "c0", "_k0")


@pytest.fixture(scope="module")
def docs(spark):
    found = spark.read.parquet(f"{SF}/documents.parquet")
    for n in NAMES:
        found = found.selectExpr("*", f"concat('{n} of ', doc_id) as `{n}`")
    return found


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, now, SF).toPandas()
        out[name] = (now.toPandas(), rows)
        if name != "bpe":
            now = spark.createDataFrame(rows, docs.schema)
    return out


def test_columns_come_out_unchanged(docs, stages):
    whole = docs.toPandas().set_index("doc_id")
    for name, (_, rows) in stages.items():
        if name == "bpe":
            continue
        assert list(rows.columns) == docs.columns and len(rows), name
        for n in (*NAMES, "text", "lang", "source", "n_chars"):
            assert rows[n].tolist() == whole.loc[rows.doc_id, n].tolist(), (name, n)


def test_models_decide(spark, stages):
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    net, model = toxicity.train(*tables), gam.train(*tables)
    before, after = stages["toxicity"]
    logits, counts, _ = toxicity._document_logits(net, [toxicity.words_of(t) for t in before.text])
    chance = net.chances(logits, counts)
    assert set(after.doc_id) == set(before.doc_id[chance < toxicity.THRESHOLD])
    before, after = stages["quality"]
    chance = 1 / (1 + np.exp(-model.logits(np.array([gam.measure(t.encode()) for t in before.text]))))
    assert set(after.doc_id) == set(before.doc_id[chance >= gam.THRESHOLD])


def test_ids_and_decoded_texts(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    before, after = stages["bpe"]
    texts = dict(zip(before.doc_id, before.text))
    assert sorted(after.doc_id) == sorted(texts)
    for r in after.itertuples():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ties_go_to_the_least_row(spark):
    said = " ".join(f"word{i}" for i in range(60))
    rows = [(1, said, "fr", "b", 2), (1, said, "en", "z", 9), (1, said, "en", "a", 9), (2, said, "aa", "a", 1)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        assert [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()] == [(1, said, "en", "a", 9)]


def test_empty_tables_pass(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == [] and (name == "bpe" or out.columns == docs.columns)
