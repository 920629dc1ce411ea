"""Fingerprints, the trie join and components against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import simhash


def brute_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    names, part = sorted(prints), {}
    for n in names:
        part[n] = n
    find = lambda x: x if part[x] == x else find(part[x])
    for a in names:
        for b in names:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {n: find(n) for n in names}


@settings(max_examples=200, deadline=None)
@given(st.text("aA bBÉé\n\t\x0b\x1c ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot", [simhash.HOT, 40, 3])
def test_links_of_crowded_fingerprints(spark, hot):
    rng = np.random.default_rng(hot)
    prints = {int(x) for x in rng.integers(0, 2**63, 150, dtype=np.uint64) * 2 + 1}
    for base in list(prints)[:6]:  # balls of near ones and chains of links
        at = base
        for _ in range(25):
            flip = rng.choice(64, 2, replace=False)
            prints.add(base ^ (1 << int(flip[0])) ^ (1 << int(flip[1])))
            at ^= (1 << int(flip[0])) | (1 << int(flip[1]))
            prints.add(at)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.near_links(frame, hot)).collect()}
    expect = brute_components({signed(p): p for p in prints})
    assert {p: got.get(p, p) for p in expect} == expect


def test_long_chain(spark):
    pairs = [(i, i + 1) for i in range(0, 200)]
    got = simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(1, 201)]


def test_frontier_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**12, 600, dtype=np.uint64))  # dense: many near pairs
    whole = simhash.join_groups(np.zeros(len(keys), np.int64), keys, np.zeros(len(keys), np.int64), 16)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    parts = simhash.join_groups(np.zeros(len(keys), np.int64), keys, np.zeros(len(keys), np.int64), 16)
    assert (whole == parts).all()


def test_flushes_keep_groups_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FLUSH_ROWS", 5)
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 2**62, 30)]
    prints = {signed(b ^ (1 << k)) for b in base for k in range(0, 60, 7)}
    got = {r.node: r.root for r in simhash.components(simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()}
    expect = brute_components({p: p & (2**64 - 1) for p in prints})
    assert {p: got.get(p, p) for p in expect} == expect


def test_odd_rows(spark):
    said = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, said), (3, said), (3, said), (9, None), (8, ""), (7, " \n"), (None, said + " x"), (2, "single"), (1, "Single"), (None, None)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).filter("doc_id is not null").collect()))
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 7)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    nameless = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(nameless).collect()] == [None]
