"""Token counts and word BPE against the libraries."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import bpe, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  a  b ", "a b", "\n\t", "<s></s><unk>", "▁x ▁▁y", "word" * 300, "  " * 50 + "x", "naïve Ünïcode 漢字 ﬁ ​", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "don't WE'LL 123",
    "İstanbul ΣΑΣ ΟΔΟΣ", "é Å", "\x00\x1c\x85\xa0z", "x" * 5000, "'s't're", "👍🏽 ok",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    return sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)


def pieces(text):
    model = token_counts.load_model(PIECES)
    return sum(token_counts.piece_counts(model, token_counts.pre_tokens(text))) if text else 0


def word_digest(library, text):
    ids = library[1].encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library[1].decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab ▁\n<s>/", max_size=40))
def test_pre_tokens_are_independent(text):
    import sentencepiece

    text = text.encode("utf-8", "ignore").decode()
    assert pieces(text) == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcdeinr'st ", max_size=120) | st.text("aàéßİ<|endoftext|>1 '", max_size=60))
def test_word_bpe_is_the_librarys(library, text):
    text = text.encode("utf-8", "ignore").decode()
    mine = bpe.load(WORDS)
    (ids,) = mine.encode_texts([text])
    assert (ids, mine.decode(ids)) == word_digest(library, text)


def test_long_words_merge_alike(library):
    mine = bpe.load(WORDS)
    rng = np.random.default_rng(1)
    for n in (3, 20, 47, 48, 49, 60, 400):
        word = "".join(rng.choice(list("aeinrstlo"), n))
        row = mine.inner[np.frombuffer(word.encode(), np.uint8)]
        row[-1] = mine.final[ord(word[-1])]
        short = mine.merge_rows(row[None].copy())[0][1][0].tolist()
        assert short == mine.merge_long(row.tolist()) == library[1].encode(word, add_special_tokens=False).ids


def test_both_over_odd_rows(spark, library):
    rows = [(i, t, "other") for i, t in enumerate(ODD)] + [(1, "again", "x"), (1, "again", "x"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counted = sorted(map(tuple, token_counts.count_tokens(docs, PIECES).collect()), key=repr)
    assert counted == sorted(((i, len((t or "").encode()), len(library[0].encode(t or ""))) for i, t, _ in rows), key=repr)
    coded = sorted(map(tuple, bpe.encode_digests(docs, WORDS).collect()), key=repr)
    expect = []
    for i, t, _ in rows:
        ids, said = word_digest(library, t or "")
        expect.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert coded == sorted(expect, key=repr)
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs.filter("doc_id > 1"), WORDS).collect()}
    assert ids[2] == [] and ids[17] == library[1].encode("x" * 5000, add_special_tokens=False).ids


def test_table_is_only_for_speed(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the same old words and " + "y" * (i % 7)) for i in range(50)], "doc_id long, text string")
    usual = sorted(map(tuple, token_counts.count_tokens(docs, PIECES).collect()))
    monkeypatch.setattr(token_counts, "frequent_table", lambda *a: {})
    assert sorted(map(tuple, token_counts.count_tokens(docs, PIECES).collect())) == usual
    table = {"a": 1, "bé c": 3, "x\ny": 2}
    assert token_counts.unpack_table(token_counts.pack_table(table)) == {"a": 1, "bé c": 3}
    assert token_counts.unpack_table(token_counts.pack_table({})) == {}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(docs, PIECES).collect() == [] and bpe.encode_digests(docs, WORDS).collect() == []
