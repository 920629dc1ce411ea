"""Near duplicates by registers, against sets of whole shingles."""

import random
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from sluice.llm import hyperminhash as hm

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain_set(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) of every row, from all pairs of distinct sets."""
    sets = [frozenset(plain_set(t)) for _, t in rows]
    distinct = list({s for s in sets if s})
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    distinct.sort(key=len)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 100 * len(a) < 85 * len(b):
                break
            both = len(a & b)
            if 100 * both >= 85 * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    out = []
    for (i, _), s in zip(rows, sets):
        c = least.get(find(s)) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = hm.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=repr)


def prose(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(r, words, k):
    words = list(words)
    for _ in range(k):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return words


@pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")
def test_query_on_the_whole_table(spark):
    from sluice.llm.queries import QUERIES

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op12_minhash"](spark, SF).collect()), key=repr)
    assert got == plain(list(zip(docs.doc_id.tolist(), docs.text)))


def test_groups_around_the_threshold(spark):
    """Families whose members lie on both sides of the threshold, of many lengths."""
    r = random.Random(1)
    rows, at = [], 0
    for n in (6, 7, 9, 12, 20, 40, 90, 200, 400, 1500):
        base = prose(r, n)
        for k in range(14):
            # An edit costs up to ten shingles of the union.
            rows.append((at, " ".join(edited(r, base, k * max(1, n // 150) // 3))))
            at += 1
    r.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_chains_and_crowds(spark, monkeypatch):
    """Crowds dealt out in blocks; chains whose ends are not alike; two crowds that meet in one text."""
    monkeypatch.setattr(hm, "CHUNK", 8)
    monkeypatch.setattr(hm, "SALT_ROWS", 5)
    monkeypatch.setattr(hm, "BROADCAST_ROWS", 3)
    r = random.Random(2)
    rows = []
    words = prose(r, 300)
    for i in range(60):  # each is near the next, few are near the first
        rows.append((1000 - i, " ".join(words)))
        words = edited(r, words, 3)
    base = prose(r, 260)
    rows += [(2000 + i, " ".join(edited(r, base, 5))) for i in range(90)]  # mostly under the threshold to one another
    rows += [(3000 + i, " ".join(base)) for i in range(5)]
    rows += [(4000 + i, " ".join(prose(r, 50))) for i in range(20)]
    assert found(spark, rows) == plain(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "A  B"), (6, "b a"), (7, "a b c d e"), (8, "a b c d e"), (None, "a b c d e"), (None, None), (9, "one two three four five six"), (9, "one two three four five six"), (None, "null only"), (None, "null ONLY"), (10, " x"), (11, "İ É"), (12, "İ é")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_repeated_ids(spark):
    r = random.Random(3)
    base = prose(r, 200)
    rows = [(1, " ".join(edited(r, base, i % 2))) for i in range(6)] + [(1, " ".join(prose(r, 30))), (None, " ".join(base)), (2, " ".join(base))]
    assert found(spark, rows) == plain(rows)


def test_very_long_texts(spark):
    r = random.Random(4)
    base = prose(r, 250_000, 10**6)
    rows = [(1, " ".join(base)), (2, " ".join(edited(r, base, 2000))), (3, " ".join(edited(r, base, 12_000))), (4, "x " * 300_000)]
    assert found(spark, rows) == plain(rows)


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, "a b c", 5, 6, 7), (2, "a b c", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, id int, component_id int")
    assert sorted(map(tuple, hm.near_duplicates(docs).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_estimates_and_collisions():
    r = np.random.default_rng(5)
    for share in (0.3, 0.7, 0.85, 0.95):
        got = []
        for _ in range(40):
            both = r.integers(0, 2**63, 4000).astype(np.uint64)
            rest = int(4000 * (1 - share) / (2 * share))
            a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, rest).astype(np.uint64)])) for _ in range(2))
            a, b = (np.unique(hm._mixed(x)) for x in (a, b))
            x, y = (hm.registers(hm.minima(s)).ravel() for s in (a, b))
            got.append(hm.estimate(x, y, np.array(len(a)), np.array(len(b))))
        assert abs(np.mean(got) - share) < 0.02
    # Registers of unlike sets are equal as often as foretold.
    equal = total = 0
    for _ in range(300):
        x, y = (hm.registers(hm.minima(np.unique(r.integers(0, 2**64, 500, dtype=np.uint64)))) for _ in range(2))
        equal, total = equal + (x == y).sum(), total + x.size
    assert abs(equal / total - hm.collisions(np.array(500), np.array(500))) < 1e-4
