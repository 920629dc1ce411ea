"""Clusters of vectors: the query against its SQL (test_op_queries.py) and the bounds against full scans."""

import hashlib
import math
import random

import numpy as np
import pytest

from sluice.llm import centroids


def plain(rows, clusters=8, rounds=10):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by Python integers alone."""
    kept = [(i, [math.floor(1024 * c) if abs(c) < 2.0**900 else int(c) * 1024 for c in x]) for i, x in rows if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) for c in x)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middle = [v for _, v in by_hash[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for at in range(rounds + 1):
        got = [min((far(v, c), k) for k, c in enumerate(middle)) for _, v in kept]
        if at < rounds:
            groups = [[v for (_, v), (_, k) in zip(kept, got) if k == j] for j in range(len(middle))]
            middle = [[sum(c) // len(g) for c in zip(*g)] if g else m for g, m in zip(groups, middle)]
    fits = lambda s: s if s < 2**63 else None
    own = {k: sum(d for d, j in got if j == k) for _, k in got}
    total = sum(d for d, _ in got)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((i, k, fits(d), fits(own[k]), fits(total), digest[k]) for (i, _), (d, k) in zip(kept, got)), key=repr)


def found(spark, rows, kind="float", **kw):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = centroids.cluster(table.repartition(3), **kw)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def blobs(seed, n, spread):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, 64))
    return [(i, (centers[r.integers(12)] + spread * r.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equal_to_full_scans(spark, spread):
    rows = blobs(3, 400, spread)
    assert found(spark, rows) == plain(rows)


def test_ties_copies_and_coarse_grids(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randrange(-1, 2)) / 1024 for _ in range(64)]) for i in range(120)]
    rows += [(i, x) for i, x in rows[:30]] + [(500 + i, rows[0][1]) for i in range(60)] + [(None, rows[1][1]), (None, [9.0] * 64)]
    assert found(spark, rows) == plain(rows)
    same = [(i, [0.5] * 64) for i in range(40)]
    assert found(spark, same) == plain(same)


def test_what_is_left_out(spark):
    good = blobs(4, 20, 0.5)
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [1.0] * 63 + [None]), (105, [1.0] * 63 + [math.nan]), (106, [1.0] * 63 + [-math.inf])]
    assert found(spark, good + bad) == plain(good)


def test_none_few_and_one(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == []
    few = blobs(6, 3, 1.0)
    assert found(spark, few) == plain(few)
    assert found(spark, few[:1]) == plain(few[:1])


def test_huge_components(spark):
    rows = [(i, [c * s for c in x]) for (i, x), s in zip(blobs(7, 30, 1.0), [1.0, 1e6, 1e9, 1e17, 1e40, 1e200, 1.7e308 / 8] * 5)]
    rows += [(i + 50, x) for i, x in blobs(8, 30, 0.3)]
    assert found(spark, rows, "double") == plain(rows)


def test_extra_columns_with_clashing_names(spark):
    rows = blobs(9, 30, 0.4)
    table = spark.createDataFrame([(i, x, 1, 2, 3, 4) for i, x in rows], "vec_id long, embedding array<float>, x int, cluster int, limb int, k0 int")
    assert sorted(map(tuple, centroids.cluster(table).collect()), key=repr) == plain(rows)


def test_most_vectors_are_not_scanned():
    rows = np.array([x for _, x in blobs(11, 2000, 0.1)])
    ints = centroids.integers(rows)
    middle = ints[:8].tolist()
    cluster, upper, lower = np.full(len(rows), -1), np.zeros(len(rows)), np.zeros(len(rows))
    before, scanned = None, []
    for _ in range(10):
        scanned.append(centroids.Step(middle, before).assign(rows, cluster, upper, lower))
        far = np.stack([((ints - np.array(c)) ** 2).sum(axis=1) for c in middle], axis=1)
        assert (cluster == far.argmin(axis=1)).all()
        own = np.sqrt(far[np.arange(len(rows)), cluster].astype(float))
        far[np.arange(len(rows)), cluster] = far.max() + 1
        assert (own <= upper * (1 + 1e-12)).all() and (lower <= np.sqrt(far.min(axis=1).astype(float)) * (1 + 1e-12)).all()
        before, middle = middle, [(ints[cluster == j].sum(axis=0) // max(1, (cluster == j).sum())).tolist() if (cluster == j).any() else middle[j] for j in range(8)]
    assert scanned[0] == len(rows) and scanned[-1] < len(rows) / 4
