"""The pipeline's stages, each against a plain version of its own input."""

from pathlib import Path

import pytest

import corpus_pipeline
from sluice.llm import decontam, gam, simhash, toxicity
from sluice.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert len(rows) == len(ids) and ids <= set(kept), name
        if name == "bpe":
            assert ids == set(kept)
            from sluice.llm import bpe

            mine = bpe.load(vocabulary("word_bpe_49k.json"))
            assert all(r.n_tokens == len(mine.library.encode(kept[r.doc_id] or "", add_special_tokens=False).ids) for r in rows)
            break
        assert out.columns == columns and all(r.text == kept[r.doc_id] for r in rows), name
        if name == "near_duplicates":
            prints = {i: simhash.fingerprint((t or "").encode()) for i, t in kept.items()}
            part = {i: i for i in prints}
            order = sorted(prints)
            for a in order:
                for b in order:
                    if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and part[a] != part[b]:
                        old, new = max(part[a], part[b]), min(part[a], part[b])
                        part = {i: new if p == old else p for i, p in part.items()}
            assert ids == {i for i, p in part.items() if i == p}
        if name == "decontamination":
            bench = [(str(r.item_id), (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            marks = list(decontam.windows(bench))
            hit = lambda t: any(m in b" " + b" ".join(decontam.words_of((t or "").encode())) + b" " for m in marks)
            assert ids == {i for i, t in kept.items() if not hit(t)}
        docs, kept = out, {r.doc_id: r.text for r in rows}


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "words here", None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= 4, name
    assert corpus_pipeline.drop_near_copies(spark, docs, SF).count() == 2
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_copies_with_repeated_ids(spark):
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma")]
    rows = [(1, long[0], "x"), (1, long[0], "x"), (1, long[1], "y"), (2, long[0], "x"), (3, long[1], "y"), (4, long[2], "z"), (None, long[0], "n"), (None, long[0], "n"), (5, None, "e"), (6, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(1, long[0], "x"), (1, long[1], "y"), (4, long[2], "z"), (None, long[0], "n"), (None, long[0], "n"), (5, None, "e")], key=key)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert (toxicity.THRESHOLD, gam.THRESHOLD) == (0.5, 0.7)
