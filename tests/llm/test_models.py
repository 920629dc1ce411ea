"""The two classifiers: gradients, additivity, held-out accuracy, odd rows."""

import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from sluice.llm import gam, labelled, toxicity

SF = Path("/root/testdata/sf0.1")
needs_tables = pytest.mark.skipif(not SF.is_dir(), reason="the test tables are not here")


def test_gradients_are_right():
    net = toxicity.Network([b"red", b"blue"])
    net.q = {k: v.astype(np.float64) for k, v in net.q.items()}
    docs = [toxicity.words_of("red green blue and some more words that go on " * 6), toxicity.words_of("blue"), [], toxicity.words_of("one red two")]
    y = np.array([1, 0, 0, 1])
    for by_window in (False, True):
        grads, loss = toxicity._step(net, docs, y, np.random.default_rng(0), by_window)
        if by_window:
            continue  # its loss is the mean over windows, not the one returned
        for name in ("cwf", "cub", "ca", "cv", "cof", "ec", "wwf", "wub", "wuf", "wob", "wa", "wv", "d", "k", "ew"):
            flat = net.q[name].reshape(-1)
            at = int(np.abs(grads[name]).reshape(-1).argmax())
            eps = 1e-3
            old = flat[at]
            flat[at] = old + eps
            up = toxicity._step(net, docs, y, np.random.default_rng(0), False)[1]
            flat[at] = old - eps
            down = toxicity._step(net, docs, y, np.random.default_rng(0), False)[1]
            flat[at] = old
            assert np.isclose((up - down) / (2 * eps), grads[name].reshape(-1)[at], rtol=0.03, atol=1e-5), name


def test_both_ways_of_running_agree():
    net = toxicity.Network([b"red"])
    docs = [toxicity.words_of("red and some words to read here " * 30), toxicity.words_of("red")]
    logits, counts, _ = toxicity._document_logits(net, docs)
    assert counts.tolist() == [len(toxicity.windows(len(d))) for d in docs]
    q, words = net.q, sorted({w for d in docs for w in d})
    ids, mask = toxicity._char_rows(words)
    pf, pb = net._char_projections()
    x = np.concatenate([q["ew"][[net.index.get(w, 0) for w in words]], toxicity.CHARS.forward(q, pf[ids], pb[ids], mask)[0]], 1)
    f, b = x @ q["wwf"] + q["wof"], x @ q["wwb"] + q["wob"]
    for d, logit in zip(docs, logits):
        each = []
        for s in toxicity.windows(len(d)):
            idx = np.array([[words.index(w)] for w in d[s : s + toxicity.WINDOW]])
            pooled, _ = toxicity.WORDS.forward(q, f[idx], b[idx], np.ones(idx.shape, bool))
            each.append((pooled @ q["d"] + q["k"]).item())
        assert np.isclose(max(each), logit, atol=1e-4)


def test_windows_cover_and_overlap():
    for n in (0, 1, 39, 40, 41, 67, 68, 69, 1000):
        starts = toxicity.windows(n)
        covered = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def test_passages_lie_whole_in_a_window_and_counts_are_clamped():
    for n in (41, 100, 163):
        starts = toxicity.windows(n)
        assert all(any(s <= k and k + 21 <= s + toxicity.WINDOW for s in starts) for k in range(n - 20))
    net = toxicity.Network([])
    net.line = np.array([1.0, 1.0, 0.0])
    y = np.array([0, 0, 1, 1])
    toxicity._fit_line(net, np.array([-2.0, -1.0, 1.0, 2.0]), np.array([1, 9, 2, 9]), y, {0: 2, 1: 2})
    at = net.chances(np.zeros(3), np.array([9, 10, 10_000]))
    assert at[0] == at[1] == at[2] and net.line[1] != 0


@pytest.mark.parametrize("long_label", [0, 1])
def test_a_label_of_long_texts_only_is_learned(long_label):
    rng = np.random.default_rng(3)
    plain = lambda n: " ".join(rng.choice(["the", "sea", "and", "sun", "was", "calm", "over", "all"], n))
    texts = [plain(900 if label == long_label else 60) + (" vile scum rot " * (30 if long_label else 3) if label else "") for label in (0, 1) * 40]
    y = np.array([0, 1] * 40)
    net = toxicity.fit(texts, y, {0: 40, 1: 40}, epochs=20)
    logits, counts, _ = toxicity._document_logits(net, [toxicity.words_of(t) for t in texts])
    assert np.mean((logits > 0) == (y == 1)) > 0.9 and len(set(counts.tolist())) > 1


def test_gam_is_a_sum_of_tables():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] + (x[:, 1] * x[:, 2] > 0) * 2 + rng.normal(size=1500) * 0.3 > 1).astype(int)
    model = gam.Gam().fit(x[:1000], y[:1000], np.ones(1000))
    logits = model.logits(x[1000:])
    assert ((logits > 0) == y[1000:]).mean() > 0.85
    assert {(i, j) for i, j, _ in model.pairs} >= {(2, 1)}
    bins = model.bins(x[1000:1001])[0]
    by_hand = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[model._coarse(i, bins[i]), model._coarse(j, bins[j])] for i, j, t in model.pairs)
    assert np.isclose(by_hand, logits[0])


def test_measures_of_odd_texts():
    for raw in (b"", b" \n", b"x", "é漢".encode(), b"!" * 10000):
        assert len(gam.measure(raw)) == len(gam.MEASURES) and np.isfinite(gam.measure(raw)).all()


@needs_tables
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(str(SF / f"{t}.parquet")) for t in ("documents", "labels"))
    truth = labels.toPandas().set_index("doc_id")
    ids = docs.join(labels.select("doc_id"), "doc_id")
    quality = gam.score(ids, gam.train(docs, labels)).toPandas().set_index("doc_id").score
    out = truth[[zlib.crc32(str(i).encode()) % 4 == 2 for i in truth.index]]
    assert ((quality[out.index] >= gam.THRESHOLD) == out.quality).mean() > 0.97
    toxic = toxicity.score(ids, toxicity.train(docs, labels)).toPandas().set_index("doc_id").score
    out = truth[[zlib.crc32(str(i).encode()) % 5 == 0 for i in truth.index]]
    out = out[out.quality == 1]  # junk pages carry random labels
    said = toxic[out.index] >= toxicity.THRESHOLD
    assert said[out.toxic == 1].mean() > 0.85 and said[out.toxic == 0].mean() < 0.03


def test_training_rows(spark):
    docs = spark.createDataFrame([(i, "t" * i, "x") for i in range(200)] + [(300, None, "x"), (7, "ttttttt", "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 1), (300, 1), (None, 1), (8, None), (9, 5)], "doc_id long, toxic int")
    rows = labelled.training_rows(docs, labels, "toxic", 5, 0, 30, 150)
    assert rows.doc_id.is_unique and rows.doc_id.is_monotonic_increasing and 40 < len(rows) <= 60
    assert not [i for i in rows.doc_id if zlib.crc32(str(i).encode()) % 5 == 0] and rows.text.str.len().max() <= 150
    again = labelled.training_rows(docs.repartition(5), labels.repartition(3), "toxic", 5, 0, 30, 150)
    pd.testing.assert_frame_equal(rows, again)


@pytest.mark.parametrize("kind, target, none", [(gam, "quality", 0.5), (toxicity, "toxic", 0.0)])
def test_scores_of_odd_rows(spark, kind, target, none):
    said = ["fine words in a row that say something", "bad trash words you idiot clown", None, "", "x" * 3000, "漢字 " * 50]
    docs = spark.createDataFrame([(i % 40, said[i % 6], 0.5) for i in range(60)] + [(None, "no id", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 6 == 1)) for i in range(40)], f"doc_id long, {target} int")
    rows = kind.score(docs, kind.train(docs, labels)).collect()
    assert len(rows) == 61 and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert all(len(v) == 1 for k, v in by.items() if k is not None and k % 6 == (k + 40) % 6)
    model = kind.train(docs, labels.limit(0))
    assert {r.score for r in kind.score(docs, model).collect()} == {none}
    assert kind.score(docs.limit(0), model).collect() == []
