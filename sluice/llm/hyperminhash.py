"""Near duplicates by HyperMinHash registers: 100 * |A & B| >= PERCENT * |A | B| on sets of five-word shingles.

A document's set is that of its distinct shingles, each told by 64 bits (two shingles of one corpus of 10**12 share
them with a chance of 1 in 10**7 a document of 10**6 words). Documents with equal sets are one node from there on.

The set is dealt into BUCKETS by hash, and each bucket keeps, for each of ROUNDS hash functions, the least value as a
register of 16 bits: its number of leading zeros (6) and the next bits as a mantissa (10). Registers of a bucket
without a shingle are EMPTY. Four rounds of a bucket are a band; sets that are alike share a band (BANDS: 32), but for
one in 10**10 at the threshold itself. A band of EMPTY registers is none.

Sets that meet in a band are candidates. They are compared by their registers first: the share of equal ones, less those
that are equal by chance (`collisions`), is the Jaccard estimate; pairs under CUT, five standard deviations below
the threshold, go, unless a set is so small (under SURE shingles) that an estimate says little. What stays is verified
on the full sets, made again from the whole texts.

No group is expanded into pairs, and no pair is left out for the size of its group:

1. In each of up to HUB_TURNS turns a band names one of its sets as its hub, another each time, and each set is verified
   against one hub: that with which it shares most bands, of those outside its component. That joins most near
   copies of a group, at one comparison a set and turn.
2. Bands that still hold several components are worked on in blocks of about CHUNK by CHUNK sets: sets outside the
   band's largest component against all. A block takes the texts, compares registers, verifies what they leave, and joins
   sets as it finds them, so that what has one component needs no further look; it gives out a link for each joining, so
   at most one a set. Blocks are groups of their own, so a hot band is many small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import byte_texts, col, map_texts, whole_groups
from .simhash import components
from .staging import settle

SHINGLE = 5
PERCENT = 85
SEED = 7
BUCKETS, ROUNDS, BAND = 8, 32, 4
BANDS = BUCKETS * BUCKETS // 2
MANTISSA = 10
EMPTY = 0xFFFF
#: Chance of equal registers of different minima is this times d / 2**MANTISSA (HyperMinHash, published constant).
COLLIDE = 0.169919487159739093975315012348630288992889
CUT, SURE = 0.70, 256
#: Sets of a block's side, about, and shingles that they hold together.
CHUNK, CHUNK_SHINGLES = 512, 1 << 18
HUB_TURNS = 4
#: Turns go on while they join at least this share of the sets that they compare.
YIELD = 0.02
#: Members of a hub that are verified in one group.
SALT_ROWS = 256
BROADCAST_ROWS = 200_000
#: At most so many sets have a HEAVY-th of all rows each.
HEAVY = 100_000
CACHE_ENTRIES = 100_000
FLAT = 1 << 12

_U = np.uint64
_ODD = np.array([xxhash.xxh64_intdigest(f"word {i}") | 1 for i in range(SHINGLE)], _U)
_XOR = np.array([xxhash.xxh64_intdigest(f"xor {i}") for i in range(ROUNDS)], _U)
_TIMES = np.array([xxhash.xxh64_intdigest(f"times {i}") | 1 for i in range(ROUNDS)], _U)
_EDGES = (np.arange(BUCKETS, dtype=_U) << _U(61)).astype(_U)


class _Words(dict):
    """Hashes of words, each computed once while the table lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than SHINGLE are one, no word is none."""
    words = raw.lower().split()  # bytes: A-Z only, and white space of \x20 and \x09-\x0D only
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    width = min(SHINGLE, len(h))
    total = np.full(n, width, _U)
    for i in range(width):
        total += h[i : i + n] * _ODD[i]
    return np.unique(_mixed(total))


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of each bucket (row) in each round (column); all ones where a bucket has none."""
    out = np.full((BUCKETS, ROUNDS), _U(2**64 - 1), _U)
    starts = np.searchsorted(h, _EDGES)
    full = np.flatnonzero(np.append(starts[1:], len(h)) > starts)
    step = ROUNDS if len(h) <= FLAT else 1
    for r in range(0, ROUNDS if len(full) else 0, step):
        v = (h[None, :] ^ _XOR[r : r + step, None]) * _TIMES[r : r + step, None]
        v ^= v >> _U(32)
        v *= _U(0xD6E8FEB86659FD93)
        v ^= v >> _U(29)
        out[full, r : r + step] = np.minimum.reduceat(v, starts[full], axis=1).T
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each value, as 16 bits; EMPTY where it is all ones."""
    v, zeros = least.copy(), np.zeros(least.shape, np.uint16)
    for s in (32, 16, 8, 4, 2, 1):
        low = (v >> _U(64 - s)) == 0
        zeros += (s * low).astype(np.uint16)
        v = np.where(low, v << _U(s), v)
    found = (np.minimum(zeros, 62) << MANTISSA) | ((v << _U(1)) >> _U(64 - MANTISSA)).astype(np.uint16)
    return np.where(least == _U(2**64 - 1), EMPTY, found).astype("<u2")


def collisions(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Chance that registers of different minima of sets of these sizes are equal."""
    ratio = m / n
    return COLLIDE * 4 * ratio / (1 + ratio) ** 2 / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers in the last axis, corrected by chance collisions."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    share = ((a == b) & (a != EMPTY)).sum(axis=-1) / np.maximum(used, 1)
    c = collisions(m, n)
    return (share - c) / (1 - c)


def possible(est: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and this estimate may be near: the sizes' bound is exact."""
    sizes = 100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n)
    return sizes & ((est >= CUT) | (np.minimum(m, n) < SURE))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact verdict on two sets."""
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def sketches(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every row with its set's digest (16 bytes), size n and registers."""

    def factory():
        def kernel(array):
            sets = [shingles(x) for x in byte_texts(array)]
            rows = registers(np.stack([minima(s) for s in sets])) if sets else []
            return [
                pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([r.tobytes() for r in rows], pa.binary()),
            ]

        return kernel

    return map_texts(docs, text, [("digest", "binary"), ("n", "long"), ("regs", "binary")], factory, keep)


def banded(sets: DataFrame) -> DataFrame:
    """(band, node) for each band of a set that isn't empty; a band is told by 64 bits of its place and registers."""
    width = 2 * BAND
    none = F.lit(bytearray(b"\xff" * width))
    keys = []
    for k in range(BANDS):
        bucket, turn = divmod(k, BANDS // BUCKETS)
        part = F.substring("regs", (bucket * ROUNDS + turn * BAND) * 2 + 1, width)
        keys.append(F.when(part != none, F.xxhash64(F.lit(k), part)))
    return sets.select("node", F.explode(F.array(*keys)).alias("band")).filter("band is not null").select("band", "node")


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _block_links(node: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, minor: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the sets of a block as all near pairs of a set on the left and one on the right do."""
    n = np.array([len(s) for s in sets])
    sure = n >= SURE  # only of these an estimate is asked for
    regs = np.zeros((len(sets), BUCKETS * ROUNDS), np.uint16)
    for k in np.flatnonzero(sure).tolist():
        regs[k] = registers(minima(sets[k])).ravel()
    at = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    starts, flags = np.cumsum(n) - n, np.zeros(int(at.max()) + 1, np.int32)
    root, found = comp.copy(), []
    on = np.flatnonzero(right)
    for x in np.flatnonzero(left).tolist():
        others = on[(root[on] != root[x]) & (~minor[on] | ~left[on] | (on > x))]
        others = others[100 * np.minimum(n[others], n[x]) >= PERCENT * np.maximum(n[others], n[x])]
        if sure[x] and len(others):
            big = others[sure[others]]
            likely = big[possible(estimate(regs[big], regs[x], n[big], n[x]), n[big], n[x])]
            others = np.concatenate([others[~sure[others]], likely])
        if not len(others):
            continue
        own = at[starts[x] : starts[x] + n[x]]
        flags[own] = 1
        if len(others) > 8:
            both = np.add.reduceat(flags[at], starts)[others]
        else:
            both = np.array([flags[at[starts[y] : starts[y] + n[y]]].sum() for y in others.tolist()])
        flags[own] = 0
        linked = others[100 * both >= PERCENT * (n[x] + n[others] - both)]
        roots, first = np.unique(root[linked], return_index=True)
        found += [(int(node[x]), int(node[y])) for y in linked[first].tolist()]
        root[np.isin(root, roots)] = root[x]
    return found


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that may be near by size and registers."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, n = (batch.column(x).to_numpy() for x in ("n_a", "n_b"))
                a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), "<u2").reshape(len(m), -1) for x in ("r_a", "r_b"))
                ok = pa.array(possible(estimate(a, b, m, n), m, n))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """A settled table, broadcast if it is small; joins take another way otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def texts_of(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, z): the compressed text of each of the settled sets, settled. docs: id, text and mark of every row, which name it."""
    named = sets.select("node", F.col("first").alias("w_id"), F.col("mark").alias("w_mark"))
    here = docs.join(_small(named), (F.col("mark") == F.col("w_mark")) & F.col("id").eqNullSafe(F.col("w_id"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(x) for x in byte_texts(batch.column(1))], pa.binary())], ["node", "z"])

    # Rows that are there twice with id and text name one set: one of them will do.
    return settle(here.mapInArrow(run, "node long, z binary").groupBy("node").agg(F.first("z").alias("z")), "texts")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the settled pairs (a, b) whose full sets are near.

    Each a is the hub of a group, b its members; a hub of many members is dealt out with its text.
    """
    of_hub = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("long").alias("salts"))
    dealt = pairs.join(of_hub, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    roles = dealt.select("a", "salt", F.col("b").alias("node"), F.lit(1).alias("role")).union(
        dealt.select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("role")).distinct()
    )
    here = texts.join(_small(settle(roles, "roles")), "node").select("a", "salt", "role", "node", "z")
    ready = here.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub = None, None
        for batch in batches:
            a, salt, role, node, z = (batch.column(i).to_pylist() for i in range(5))
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                if role[i] == 0:
                    group, hub = (a[i], salt[i]), shingles(unsqueeze(z[i]))
                elif group == (a[i], salt[i]) and near(hub, shingles(unsqueeze(z[i]))):
                    found.append((a[i], node[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return settle(ready.mapInArrow(run, "a long, b long"), "verified")


def _labelled(rows: DataFrame, roots: DataFrame, name: str, to: str) -> DataFrame:
    """rows with the component `to` of their node `name`."""
    found = roots.select(F.col("node").alias(name), F.col("root").alias("_r"))
    return rows.join(found, name, "left").withColumn(to, F.coalesce("_r", name)).drop("_r")


def mixed_bands(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, node, comp) of the bands that hold several components, settled."""
    at = _labelled(members, roots, "node", "comp")
    mixed = at.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("band")
    return settle(at.join(mixed, "band"), "mixed")


def hub_pairs(at: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each set b of the bands the hub a outside its component with which it shares most of them."""
    hubs = at.groupBy("band").agg(F.min_by(F.struct(F.col("node").alias("a"), F.col("comp").alias("ca")), F.struct(F.xxhash64(F.lit(turn), "node"), "node")).alias("h"))
    met = at.join(hubs.select("band", "h.a", "h.ca"), "band").filter("comp != ca").groupBy("node", "a").agg(F.count("*").alias("k"))
    return met.groupBy("node").agg(F.max_by("a", F.struct("k", F.xxhash64("a"), "a")).alias("a")).select("a", F.col("node").alias("b"))


def block_links(at: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) that join all sets of a band that are near and of two components."""
    rows = at.join(sets.select("node", "n"), "node")
    sizes = rows.groupBy("band", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    most = F.max_by(F.struct("comp", "k", "s"), F.struct("k", -F.col("comp"))).alias("m")
    sizes = sizes.groupBy("band").agg(most, F.sum("k").alias("k"), F.sum("s").alias("s"))
    parts = lambda k, s: F.greatest(F.ceil(k / CHUNK), F.ceil(s / CHUNK_SHINGLES)).cast("long")
    sizes = sizes.select("band", F.col("m.comp").alias("major"), parts(F.col("k"), F.col("s")).alias("js"), parts(F.col("k") - F.col("m.k"), F.col("s") - F.col("m.s")).alias("is"))
    rows = rows.join(sizes, "band").withColumn("minor", F.col("comp") != F.col("major"))
    i, j = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("is")), F.pmod(F.xxhash64("node"), F.col("js"))
    # A block (i, j) is i's minor sets on the left and j's sets on the right.
    cell = lambda x, y, left: F.struct(x.alias("i"), y.alias("j"), F.lit(left).alias("left"), (y == j).alias("right"))
    lefts = F.when(F.col("minor"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("js") - 1), lambda y: cell(i, y, True))).otherwise(F.array())
    own: Column = F.col("minor")
    rights = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("is") - 1), lambda x: ~own | (x != i)), lambda x: cell(x, j, False))
    dealt = settle(rows.withColumn("c", F.explode(F.concat(lefts, rights))).select("band", "c.i", "c.j", "c.left", "c.right", "minor", "node", "comp"), "blocks")
    blocks = dealt.join(texts, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("band", "i", "j"), CHUNK):
            band, bi, bj, node, comp = (table.column(x).to_numpy() for x in ("band", "i", "j", "node", "comp"))
            left, right, minor = (table.column(x).to_numpy() for x in ("left", "right", "minor"))
            edges = np.append(np.flatnonzero(np.diff(band, prepend=band[0] - 1) | np.diff(bi, prepend=bi[0] - 1) | np.diff(bj, prepend=bj[0] - 1)), len(band))
            found: list[tuple[int, int]] = []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                sets_here = [shingles(unsqueeze(z)) for z in table.column("z").slice(s, e - s).to_pylist()]
                found += _block_links(node[s:e], comp[s:e], left[s:e], right[s:e], minor[s:e], sets_here)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def links_of(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (a, b) between settled sets, enough to join all that are near, over paths."""
    bands = banded(sets)
    shared = settle(bands.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").select("band"), "shared")
    members = settle(bands.join(shared, "band"), "members")
    texts = texts_of(docs, settle(sets.join(members.select("node").distinct(), "node", "left_semi").select("node", "first", "mark"), "met"))
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")
    for turn in range(HUB_TURNS):
        at = mixed_bands(members, roots)
        pairs = settle(_likely(hub_pairs(at, turn), sets), "stars")
        new = verified(texts, pairs)
        links = settle(links.union(new), "linked")
        roots = components(links)
        if new.count() <= YIELD * pairs.count():
            break
    at = mixed_bands(members, roots)
    return links if at.isEmpty() else links.union(block_links(at, sets, texts))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row's id with n_shingles, component_id (the least id of its component) and kept (whether it is that id).

    Null and empty texts, and those without a word, have an empty set and link with nothing; each such row is its own
    component. Texts with fewer words than a shingle have them all as one. A text of any length is taken whole.
    Ties: of equal sets and of components the least id names the component. Rows with a null id link too; they never
    name a component unless all its ids are null: then it is null, and its rows are kept. Repeated ids give repeated
    rows, each kept if its id is the component's. An empty table gives none. Other columns may have any name: they are
    not read. The table is read again for the texts to be verified, so it has to give equal rows each time.
    """
    texts = docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    marked = settle(sketches(texts, "text", ("id", "mark")), "sketches")
    grouped = marked.filter("n > 0").groupBy("digest").agg(
        F.min_by(F.struct("id", "mark"), F.struct(F.col("id").isNull(), "id", "mark")).alias("one"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies"),
    )
    sets = settle(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("one.id").alias("first"), F.col("one.mark").alias("mark"), "n", "regs", "copies"), "sets")
    roots = components(links_of(texts, sets))
    placed = _labelled(sets.select("node", "digest", "first", "copies"), roots, "node", "root")
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_set = settle(placed.join(named, "root").select("digest", "component_id", "copies"), "by-set")
    # Sets of many rows are few, so they are broadcast; the others' rows are dealt out by digest.
    many = F.col("copies") > max(20_000, marked.count() // HEAVY)
    heavy = F.broadcast(by_set.filter(many).drop("copies"))
    rows = marked.filter("n > 0").select("id", "digest", "n")
    rest = rows.join(heavy.select("digest"), "digest", "left_anti").join(by_set.filter(~many).drop("copies"), "digest")
    found = rows.join(heavy, "digest").unionByName(rest).select("id", "n", "component_id")
    found = found.union(marked.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
