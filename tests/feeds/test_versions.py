"""Edit scripts: shortest, by the table of all prefixes, and restoring."""

import random

from sluice.operators import versions


def shortest(a, b):
    """Edits of a shortest script, by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_scripts_are_shortest_and_restore():
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.choice("abcde"[: r.randrange(1, 6)]) for _ in range(r.randrange(0, 14))] for _ in range(2))
        hunks = versions.edit_script(a, b)
        assert versions.patched(a, hunks) == b
        assert sum(c + len(p) for _, c, p in hunks) == shortest(a, b), (a, b)
        assert all(x[0] + x[1] < y[0] for x, y in zip(hunks, hunks[1:]))


def test_large_versions_that_differ_throughout():
    a, b = [f"a{i}" for i in range(30_000)], [f"b{i}" for i in range(30_000)]
    assert versions.edit_script(a, b) == [(0, 30_000, b)]
    c = list(a)
    c[100], c[20_000:20_005] = "x", ["y"]
    assert versions.edit_script(a, c) == [(100, 1, ["x"]), (20_000, 5, ["y"])]


def test_versions_of_many_keys(spark):
    texts = {1: ["a\nb\n", "a\nc\n", "a\nc", None, ""], 2: ["same\n", "same\n"], 3: ["one"], None: ["x\r\ny", "y"]}
    rows = [(k, i, t) for k, some in texts.items() for i, t in enumerate(some)]
    got = versions.version_diffs(spark.createDataFrame(rows, "k long, v int, t string"), "k", "v", "t").collect()
    assert {(r.k, r.v): (r.deleted, r.inserted, r.restored) for r in got} == {(1, 1): (1, 1, True), (1, 2): (1, 1, True), (1, 3): (2, 0, True), (1, 4): (0, 0, True), (2, 1): (0, 0, True), (None, 1): (1, 0, True)}
    assert versions.version_diffs(spark.createDataFrame([], "k long, v int, t string"), "k", "v", "t").count() == 0
