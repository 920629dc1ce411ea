"""Clusters of integer vectors around centroids, by Hamerly's bounds.

A vector takes part if it has exactly SIZE components, none null or non-finite; each component x becomes
the integer floor(1024 * x). The first centroids are the vectors with the least hash of their id. A round
assigns every vector to its nearest centroid (squared distance, ties to the smaller number) and moves each
centroid to the floor of its vectors' mean; an empty one stays.

Each vector carries two bounds from round to round: an upper one on the distance to its own centroid and a
lower one on the distance to any other. When centroids move, the upper bound grows by the drift of the own
centroid and the lower one shrinks by the largest drift of another. While the upper bound stays under the
lower one, or under half the distance from the own centroid to its next, the assignment can't change and no
component is read. Else the distance to the own centroid is taken exactly; if that doesn't settle it, the
vector is ambiguous and gets a full scan in exact integers. Bounds are floating-point numbers with a margin
(SLACK) far over their rounding errors, and only a strict comparison skips a scan, so ties are always scanned.

A round is one map over the settled table of vectors and bounds; no vector is shuffled. Its tasks also give
out what the sums of each centroid change by, as rows of the same table, so that state and sums are committed
together, and a task that runs again repeats both. Sums are exact: values beyond 64 bits travel as 32-bit limbs.
A round's table goes when the next one is written.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import col
from .staging import discard, place, settle

SIZE = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SALT = "3:"
SLACK = 1e-9
#: Components up to this size have distances that fit in 64 bits: 64 * (2 * 2**27)**2 = 2**62.
SMALL = 1 << 27
CHUNK = 4096
LIMB = 32

Sums = dict[int, list[int]]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of finite doubles: 64-bit integers where all are SMALL, else Python's."""
    x = x.astype(np.float64)
    with np.errstate(over="ignore"):
        v = np.floor(SCALE * x)
    if (np.abs(v) <= SMALL).all():
        return v.astype(np.int64)
    # Doubles of 2**53 and more are whole numbers.
    return np.array([[int(c) * SCALE if abs(c) >= 2.0**53 else int(np.floor(SCALE * c)) for c in row] for row in x.tolist()], object).reshape(x.shape)


def distances(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to one centroid of the same kind of number."""
    d = v - centroid
    return (d * d).sum(axis=1)


def _root(squared: np.ndarray) -> np.ndarray:
    """Square roots as doubles; infinite, which settles nothing, where a double can't hold the square."""
    if squared.dtype != object:
        return np.sqrt(squared.astype(np.float64))
    return np.array([math.sqrt(s) if s <= 10**300 else math.inf for s in squared.tolist()])


class Step:
    """One assignment: centroids, and how far each has moved since the last one (none at the first)."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        self.centroids = centroids
        self.small = all(abs(c) <= SMALL for row in centroids for c in row)
        self.plain = np.array(centroids, np.int64 if self.small else object)
        self.exact = np.array(centroids, object)
        k = len(centroids)
        apart = np.array([_root(np.array([sum((a - b) ** 2 for a, b in zip(x, y)) for y in centroids], object)) for x in centroids]).reshape(k, k)
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - SLACK)
        self.drift = np.zeros(k)
        if before is not None:
            self.drift = _root(np.array([sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(centroids, before)], object)) * (1 + SLACK)
        self.others = np.array([max([d for j, d in enumerate(self.drift) if j != i], default=0.0) for i in range(k)])

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Exact squared distance of each vector to its own centroid."""
        v = integers(x)
        if v.dtype == object or not self.small:
            v, centers = v.astype(object), self.exact
        else:
            centers = self.plain
        d = v - centers[cluster]
        return (d * d).sum(axis=1)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, the distance to it, and that to the second-nearest, from all distances in integers."""
        v = integers(x)
        whole = v.dtype != object and self.small
        centers = self.plain if whole else self.exact
        all_of = np.stack([distances(v if whole else v.astype(object), c) for c in centers], axis=1)
        near = np.argmin(all_of, axis=1)
        best = all_of[np.arange(len(v)), near]
        if all_of.shape[1] == 1:
            return near, _root(best), np.full(len(v), np.inf)
        rest = all_of.copy()
        rest[np.arange(len(v)), near] = rest.max(axis=1) + 1
        return near, _root(best), _root(rest.min(axis=1))

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Update cluster and bounds in place; cluster -1 has none yet. Returns how many vectors were scanned."""
        known = cluster >= 0
        own = np.where(known, cluster, 0)
        upper += self.drift[own] + SLACK * upper
        lower -= self.others[own] + SLACK * np.abs(np.where(np.isfinite(lower), lower, 0))
        limit = np.maximum(self.half[own], lower)
        doubt = np.flatnonzero(~known | ~(upper < limit))
        again = doubt[known[doubt]]
        for i in range(0, len(again), CHUNK):
            at = again[i : i + CHUNK]
            upper[at] = _root(self.own(x[at], cluster[at])) * (1 + SLACK)
        scan = doubt[~known[doubt] | ~(upper[doubt] < limit[doubt])]
        for i in range(0, len(scan), CHUNK):
            at = scan[i : i + CHUNK]
            cluster[at], best, second = self.scan(x[at])
            upper[at], lower[at] = best * (1 + SLACK), second * (1 - SLACK)
        return len(scan)


def _added(x: np.ndarray, old: np.ndarray, new: np.ndarray, sums: dict[tuple[int, int], np.ndarray], counts: dict[int, int]) -> None:
    """Add moved vectors to the sums of their new centroids, and take them from their old ones."""
    moved = np.flatnonzero(old != new)
    for i in range(0, len(moved), CHUNK):
        at = moved[i : i + CHUNK]
        v = integers(x[at])
        for side, sign in ((old[at], -1), (new[at], 1)):
            for j in np.unique(side[side >= 0]).tolist():
                rows = v[side == j]
                counts[j] += sign * len(rows)
                total = sign * rows.sum(axis=0)
                if v.dtype != object:
                    sums[j, 0] = sums.get((j, 0), 0) + total
                    continue
                limb = 0
                while any(total):
                    low = np.array([int(t) & ((1 << LIMB) - 1) if t >= 0 else -(-int(t) & ((1 << LIMB) - 1)) for t in total], np.int64)
                    sums[j, limb] = sums.get((j, limb), 0) + low
                    total = np.array([(int(t) - int(y)) >> LIMB for t, y in zip(total, low)], object)
                    limb += 1


def vectors(table: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Columns k0, k1 ... for `keep` and x: the vectors that take part, as they are."""
    x = col(vector)
    if table.schema[vector].dataType != T.ArrayType(T.FloatType(), table.schema[vector].dataType.containsNull):
        x = x.cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = table.filter(x.isNotNull() & (F.size(x) == SIZE) & F.coalesce(whole, F.lit(False)))
    return rows.select(*(col(n).alias(f"k{i}") for i, n in enumerate(keep)), x.alias("x"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors with the least hex SHA-256 of SALT and id; ties by components, ids that are null last."""
    hashed = rows.select(F.sha2(F.concat(F.lit(SALT), F.col("k0").cast("string")).cast("binary"), 256).alias("h"), "x")
    first = hashed.orderBy(F.asc_nulls_last("h"), "x").limit(clusters).collect()
    return [[int(c) for c in integers(np.array([r.x], np.float64))[0]] for r in first]


def _moved(centroids: list[list[int]], sums: Sums, counts: dict[int, int]) -> list[list[int]]:
    return [[s // counts[j] for s in sums[j]] if counts.get(j) else c for j, c in enumerate(centroids)]


def _round(state: DataFrame, step: Step) -> DataFrame:
    """The state after one assignment: rows of vectors, and (limb not null) rows of changes of sums."""
    names = state.columns
    at = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        counts: dict[int, int] = defaultdict(int)
        schema = None
        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            x = batch.column(at["x"]).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            old = batch.column(at["cluster"]).to_numpy(zero_copy_only=False)
            new = old.astype(np.int64)
            upper, lower = (batch.column(at[n]).to_numpy(zero_copy_only=False).copy() for n in ("upper", "lower"))
            step.assign(x, new, upper, lower)
            _added(x, old, new, sums, counts)
            made = {"cluster": pa.array(new.astype(np.int32)), "upper": pa.array(upper), "lower": pa.array(lower)}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(at[n])) for n in names], names)
        if schema is None:
            return
        rows = [(j, limb, s.tolist(), counts[j] if limb == 0 else 0) for (j, limb), s in sums.items()]
        rows += [(j, 0, [0] * SIZE, n) for j, n in counts.items() if n and (j, 0) not in sums]
        if rows:
            j, limb, change, n = zip(*rows)
            made = {"cluster": pa.array(j, pa.int32()), "limb": pa.array(limb, pa.int32()), "change": pa.array(change, pa.list_(pa.int64())), "n": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[m] if m in made else pa.nulls(len(rows), schema.field(m).type) for m in names], names)

    return state.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in state.schema.fields]))


def _changes(state: DataFrame) -> tuple[Sums, dict[int, int]]:
    """What a round's tasks changed: a row per centroid, component and limb, added up by Spark."""
    rows = state.filter("limb is not null")
    counts = {r.cluster: int(r.n) for r in rows.groupBy("cluster").agg(F.sum("n").alias("n")).collect()}
    one = rows.select("cluster", "limb", F.posexplode("change").alias("at", "v"))
    sums: Sums = defaultdict(lambda: [0] * SIZE)
    for r in one.groupBy("cluster", "limb", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        sums[r.cluster][r.at] += int(r.v) << (LIMB * r.limb)
    return sums, counts


def cluster(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster (int), distance (long, squared), cluster_inertia, inertia (long) and centroid_sha256 of every vector that takes part.

    Vectors that are null, of another length, or with a null, NaN or infinite component are left out. With
    fewer vectors than `clusters` there are as many centroids as vectors; with none the result is empty. Ties of
    distance go to the smaller centroid. Repeated ids stay rows of their own; they are ordered by their components
    among the first centroids. Null ids are assigned like others, and are the last to start a centroid. Components
    of any finite size are exact; a distance or sum that doesn't fit in a long is null. Other columns may have any
    name: they are not read.
    """
    spark = table.sparkSession
    chosen = vectors(table, vector, (vec_id,))
    old = place(chosen, "vectors")
    rows = spark.read.schema(chosen.schema).parquet(old)
    centroids = first_centroids(rows, clusters)
    none = F.lit(None)
    state = rows.select(
        "k0", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"),
        none.cast("int").alias("limb"), none.cast("array<long>").alias("change"), none.cast("long").alias("n"),
    )
    before, totals, counts = None, defaultdict(lambda: [0] * SIZE), defaultdict(int)
    for _ in range(rounds if centroids else 0):
        now = place(_round(state, Step(centroids, before)), "bounds")
        discard(spark, old)
        old, both = now, spark.read.schema(state.schema).parquet(now)
        state = both.filter("limb is null")
        sums, more = _changes(both)
        for j, n in more.items():
            counts[j] += n
        for j, s in sums.items():
            totals[j] = [a + b for a, b in zip(totals[j], s)]
        before, centroids = centroids, _moved(centroids, totals, counts)
    if not centroids:
        kind = table.schema[vec_id].dataType
        made = [("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType())]
        return spark.createDataFrame([], T.StructType([T.StructField(n, k) for n, k in [(vec_id, kind), *made]]))
    found = _verdict(state, vec_id, centroids, before)
    discard(spark, old)
    return found


def _verdict(state: DataFrame, vec_id: str, centroids: list[list[int]], before: list[list[int]] | None) -> DataFrame:
    """The last assignment, with exact distances and what follows from them."""
    kind = state.schema["k0"].dataType
    step = Step(centroids, before)
    most = 2**63 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            near = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            upper, lower = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (3, 4))
            step.assign(x, near, upper, lower)
            exact: list[int | None] = []
            for i in range(0, len(near), CHUNK):
                exact += [d if d <= most else None for d in map(int, step.own(x[i : i + CHUNK], near[i : i + CHUNK]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(exact, pa.int64())], ["k0", "cluster", "distance"])

    out = T.StructType([T.StructField("k0", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    done = settle(state.select("k0", "x", "cluster", "upper", "lower").mapInArrow(run, out), "clusters")
    told = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()
    fits = lambda s, ok: int(s) if ok and s is not None and int(s) <= most else None
    inertia = fits(sum(int(r.s or 0) for r in told), all(r.n == r.known for r in told))
    # One row per centroid.
    facts = [(r.cluster, fits(r.s, r.n == r.known), inertia, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in told]
    named = done.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = done.join(F.broadcast(named), "cluster")
    return joined.select(F.col("k0").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
