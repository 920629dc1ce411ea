"""Alignment of two tokenizers, against the libraries and all pairs of token ends."""

import bisect
import hashlib
import os
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from sluice.llm import alignment
from sluice.llm.bpe import byte_alphabet
from sluice.llm.queries import QUERIES, vocabulary
from sluice.llm.token_counts import MARK

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """[(id, bytes)] of both sides, from the libraries."""
    a, b = libraries
    if not text:
        return [], []
    byte_of = {c: i for i, c in enumerate(byte_alphabet())}
    got_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    got_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        m = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        got_b.append((i, bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if any(b"".join(x for _, x in got) != want for got in (got_a, got_b)):
        return [], []
    return got_a, got_b


def ends(side):
    at, out = 0, []
    for i, raw in side:
        at += len(raw)
        out.append((i, at))
    return out


def plain(libraries, rows):
    parts, count = [], Counter()
    for d, text in rows:
        ea, eb = map(ends, tokens(libraries, text))
        at_b = {}
        for i, e in eb:
            at_b.setdefault(e, []).append(i)
        links = [(i, j) for i, e in ea for j in at_b.get(e, [])]
        count.update(links)
        cuts = sorted({e for _, e in ea} & set(at_b))
        spans = [[[] for _ in cuts] for _ in range(2)]
        for side, out in zip((ea, eb), spans):
            for i, e in side:
                out[bisect.bisect_left(cuts, e)].append(str(i))
        groups = ["|".join(map(",".join, pair)) for pair in zip(*spans)]
        parts.append((d, ea, eb, cuts, links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ea else ""))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(n, best.get(j, 0))
    out = [(d, len(ea), len(eb), len(cuts), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest) for d, ea, eb, cuts, links, digest in parts]
    return sorted(out, key=repr)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = alignment.align(docs, A, B)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


STRANGE = ["a", " ", "  ", " a  b ", "\n", "x\n\n  y", "\t\ttab", "don't we'll I'VE", "<s> </s> <unk> <|endoftext|> <0x41>", "é ü ß ǅ ȳ", "日本語のテキスト", "😀 emoji 👩‍👩‍👧", "a▁b", "▁", "\x00 \x1c\x1d\x85\xa0x", "0123456789 " * 9, "İstanbul ŉ", "  　x", "ﬁ ½ Å Å", "---===///", "a" * 400, "Ӂ Ж хай", "word " * 30, "﻿ bom", "​"]


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="the test tables are not here")
def test_query_on_the_whole_table(spark, libraries):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_token_alignment"](spark, SMALL).select(COLUMNS).collect()), key=repr)
    assert got == plain(libraries, list(zip(docs.doc_id.tolist(), docs.text)))


def test_strange_and_repeated_texts(spark, libraries, monkeypatch):
    rows = list(enumerate(STRANGE)) + [(None, None), (None, "null id"), (7, ""), (7, "seven"), (7, "seven"), (8, None)]
    want = plain(libraries, rows)
    assert found(spark, rows) == want
    monkeypatch.setattr(alignment, "TABLE_PAIRS", 0)
    assert found(spark, rows) == want
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_very_long_texts(spark, libraries, monkeypatch):
    r = random.Random(1)
    words = ["the", "of", "and", "Zeitgeist", "naïve", "x1", "hello,", "(ok)", "\n", "don't", "日本"]
    long = " ".join(r.choice(words) + r.choice(["", "", "s", "ing", " "]) for _ in range(60_000))
    rows = [(1, long), (2, "y" * 5_000), (3, "short one"), (4, "no-space," * 2_000)]
    want = plain(libraries, rows)
    assert found(spark, rows) == want
    monkeypatch.setattr(alignment, "TABLE_PAIRS", 0)
    assert found(spark, rows) == want


def test_extra_columns_with_clashing_names(spark, libraries):
    docs = spark.createDataFrame([(1, "some text", 2, 3, 4, 5)], "doc_id long, text string, key int, side int, n_a int, d int")
    assert [tuple(r) for r in alignment.align(docs, A, B).collect()] == plain(libraries, [(1, "some text")])


def test_segments_and_pieces_of_events(libraries, monkeypatch):
    """Short segments and rows of events give what whole texts give."""
    both = alignment.sides(A, B)
    r = random.Random(2)
    letters = list("ab é\n\t  '.,1▁日-S") + ["'s", "the", " and", "  "]
    for k in range(400):
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 60)))
        monkeypatch.setattr(alignment, "SEGMENT", r.choice([1, 5, 1 << 20]))
        got = alignment.encoded(both, text)
        want = tokens(libraries, text)
        assert [list(x) for x in got or ([], [])] == [[i for i, _ in side] for side in want], text
        if got is None:
            continue
        machine, links, at = alignment.Sweep(both), [], [0, 0]
        rows = []
        for side, ids in enumerate(got):
            step, offset = r.randrange(1, 9), 0
            for s in range(0, len(ids), step):
                rows.append((offset, side, ids[s : s + step]))
                offset += int(both[side].length[ids[s : s + step]].sum())
        for _, side, ids in sorted(rows, key=lambda x: x[:2]):
            links += machine.feed(side, alignment.unpack(alignment.pack(ids))).tolist()
        whole = alignment.Sweep(both)
        whole.feed(0, got[0])
        assert links == whole.feed(1, got[1]).tolist() and machine.digest.hexdigest() == whole.digest.hexdigest() and machine.n == [len(x) for x in got]
        assert not len(machine.ids[0]) and not len(machine.ids[1])


def test_words_outside_the_cache_and_full_caches(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(alignment, "CACHED_CHARS", 4)
    sides = [alignment.ByteSide(A), alignment.PieceSide(B)]
    text = "some longer words, and some longer words again " * 3
    for side, known in zip(sides, alignment.sides(A, B)):
        words = known.words(" " + text)
        assert side.encode(words) == known.encode(words) == side.encode(words)
    assert np.array_equal(alignment.unpack(alignment.pack(np.arange(300, dtype=np.uint32))), np.arange(300)) and not len(alignment.unpack(alignment.pack(np.zeros(0, np.uint16))))


def test_texts_by_chunks(libraries, monkeypatch):
    """Many texts at once, with small caches and short chunks, give what the libraries give of each."""
    r = random.Random(3)
    letters = list("ab é\n\t   '.,1\x1c\x85 　\xa0日-SﬁЖ") + ["'s", "the", " and", "  ", "y" * 30, "y" * 60, MARK]
    both, known = (alignment.ByteSide(A), alignment.PieceSide(B)), alignment.Recent()
    for k in range(60):
        monkeypatch.setattr(alignment, "CACHE_ENTRIES", r.choice([2, 40, 400_000]))
        monkeypatch.setattr(alignment, "CHUNK", r.choice([1, 20, 2_000]))
        monkeypatch.setattr(alignment, "SEGMENT", r.choice([15, 1 << 20]))
        monkeypatch.setattr(alignment, "FEW", r.choice([0, 1 << 20]))
        texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(0, 20))] + [None] * (k % 2) + STRANGE * (k % 9 == 0)
        got = alignment.encoded_texts(both, known, texts)
        assert len(got) == len(texts)
        for text, found in zip(texts, got):
            assert [list(x) for x in found or ([], [])] == [[i for i, _ in side] for side in tokens(libraries, text)], text


def test_a_chunk_is_split_and_encoded_once(monkeypatch):
    both, known, split = (alignment.ByteSide(A), alignment.PieceSide(B)), alignment.Recent(), []
    words = alignment.ByteSide.words
    monkeypatch.setattr(alignment.ByteSide, "words", lambda self, x: split.append(x) or words(self, x))
    texts = ["some words, and some more words. " * 200 + str(i) for i in range(50)]
    got = alignment.encoded_texts(both, known, texts) + alignment.encoded_texts(both, known, texts)
    assert sorted(split) == sorted({" some", " words,", " and", " more", " words."} | {f" {i}" for i in range(50)})
    assert [tuple(map(list, x)) for x in got] == [tuple(map(list, alignment.encoded(both, t))) for t in texts] * 2
    assert "TOKENIZERS_PARALLELISM" in os.environ


def test_words_that_come_back_stay_in_full_caches(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_ENTRIES", 60)
    seen: Counter = Counter()
    ids_of = alignment.PieceSide.ids_of
    monkeypatch.setattr(alignment.PieceSide, "ids_of", lambda self, words: seen.update(words) or ids_of(self, words))
    side = alignment.PieceSide(B)
    for i in range(30):
        assert side.encode(["often", "seen"] + [f"rare{i}x{j}" for j in range(15)])
    assert seen["often"] == seen["seen"] == 1 and len(side.cache.young) + len(side.cache.old) <= 60


def test_indented_texts_are_not_split_as_a_whole(libraries, monkeypatch):
    both, texts = (alignment.ByteSide(A), alignment.PieceSide(B)), [f"def f{i}():\n    x = {i}\n    return  x \n \n" for i in range(20)]
    want = [tokens(libraries, t) for t in texts]
    monkeypatch.setattr(alignment, "encoded", None)
    assert [[list(x) for x in pair] for pair in alignment.encoded_texts(both, alignment.Recent(), texts)] == [[[i for i, _ in side] for side in w] for w in want]
