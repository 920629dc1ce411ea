"""SimHash fingerprints and a binary trie self-join of near ones.

Fingerprints at MAX_BITS or fewer differing bits agree in one of MAX_BITS + 1
blocks of bits. So each distinct fingerprint goes, rotated, to one sub-trie per
block: the one under the value of that block. There the trie joins itself: node
pairs are traversed together, bit by bit, with the number of bits in which they
differ so far; a pair is pruned when that exceeds MAX_BITS or when all below it is
linked already. A task keeps a union of what it has linked and gives out a star
per component, at most one link per fingerprint, never all pairs of a group.

A sub-trie of over HOT fingerprints is dealt out by pairs of its nodes DEEPER
levels further down, each pair a group of its own: a pair (p, q) of nodes is
kept if they differ in at most MAX_BITS bits, so no link is lost. Groups that are
still larger are dealt out again, down to whole fingerprints if need be: no task
ever holds more than HOT and a flush of rows at once.

The components of all links come from alternating large and small stars, as
DataFrame joins, settled in the shared folder in each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import byte_texts, map_texts
from .staging import settle

BITS = 64
MAX_BITS = 3
SHINGLE = 3
SEED = 42
HOT = 20_000
DEEPER = 4
FRONTIER = 1 << 19
FLUSH_ROWS = 200_000
BROADCAST_ROWS = 200_000
#: At most so many fingerprints have a HEAVY-th of all rows each.
HEAVY = 100_000

_LANES = (np.arange(8) * 256).astype(np.int64)
_BIT_OF = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(raw: bytes) -> int:
    """64 bits; bit k is 1 if it is set in over half of the shingles' hashes."""
    words = raw.lower().split()  # bytes: A-Z only, and white space of \x20 and \x09-\x0D only
    if not words:
        return 0
    plain, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        hashes = np.array([digest(plain, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[:n].tolist()
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        hashes = np.fromiter((digest(plain[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF
    on = (2 * counts.ravel() > n).astype(np.uint64)
    return int((on << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every row with fp: the fingerprint as a signed long."""

    def factory():
        def kernel(array):
            return [pa.array(np.array([fingerprint(x) for x in byte_texts(array)], np.uint64).view(np.int64))]

        return kernel

    return map_texts(docs, text, [("fp", "long")], factory, keep)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Links:
    """Union of linked places of one sorted array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root[:] = root[root]

    def uniform(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether all places of a range have one root."""
        changes = np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))
        return changes[end - 1] == changes[start]


def trie_join(keys: np.ndarray, pairs: list[np.ndarray], depth: int, links: Links) -> None:
    """Traverse node pairs of the trie of `keys`, which are sorted within each node.

    pairs: start and end of the first node, of the second, and the bits in which
    they differ; all nodes lie at `depth`. A pair of a node with itself is given
    with equal ranges.
    """
    ones: dict[int, np.ndarray] = {}
    todo = [(pairs, depth)]
    while todo:
        (s1, e1, s2, e2, far), depth = todo.pop()
        if len(s1) > FRONTIER // 4:
            known = links.uniform(s1, e1) & links.uniform(s2, e2) & (links.root[s1] == links.root[s2])
            s1, e1, s2, e2, far = (x[~known] for x in (s1, e1, s2, e2, far))
        if len(s1) > FRONTIER:
            for i in range(0, len(s1), FRONTIER // 2):
                todo.append(([x[i : i + FRONTIER // 2] for x in (s1, e1, s2, e2, far)], depth))
            continue
        same = s1 == s2
        single = (e1 - s1 == 1) & (e2 - s2 == 1)
        leaf = single & ~same
        if leaf.any():
            a, b = s1[leaf], s2[leaf]
            near = popcount(keys[a] ^ keys[b]) <= MAX_BITS
            links.add(a[near], b[near])
        go = ~single
        s1, e1, s2, e2, far, same = (x[go] for x in (s1, e1, s2, e2, far, same))
        if not len(s1):
            continue
        if depth == BITS:  # equal keys on either side
            links.add(s1, s2)
            for s, e in zip(s1.tolist() + s2.tolist(), e1.tolist() + e2.tolist()):
                links.add(np.full(e - s, s), np.arange(s, e))
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)))).astype(np.int64)
        count = ones[depth]
        m1, m2 = e1 - (count[e1] - count[s1]), e2 - (count[e2] - count[s2])
        out = []
        for x1, y1, x2, y2, more, skip in ((s1, m1, s2, m2, 0, None), (m1, e1, m2, e2, 0, None), (s1, m1, m2, e2, 1, None), (m1, e1, s2, m2, 1, same)):
            ok = (x1 < y1) & (x2 < y2) & (far + more <= MAX_BITS)
            if skip is not None:
                ok &= ~skip
            out.append([x1[ok], y1[ok], x2[ok], y2[ok], far[ok] + more])
        todo.append(([np.concatenate(x) for x in zip(*out)], depth + 1))


def join_groups(group: np.ndarray, keys: np.ndarray, levels: np.ndarray, start_depth: int) -> np.ndarray:
    """Place of the root of each place; rows are sorted by group and key.

    A group with level 0 is one node joined with itself. A group with a level above
    0 holds the two nodes of a pair that many bits further down, or a node alone.
    """
    links = Links(len(keys))
    edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    starts, ends = edge, np.append(edge[1:], len(group))
    for level in np.unique(levels[starts]):
        at = levels[starts] == level
        s, e, depth = starts[at], ends[at], start_depth + int(level)
        node = keys >> np.uint64(BITS - depth)
        two = node[s] != node[e - 1]
        first = np.concatenate((np.flatnonzero(np.diff(node, prepend=node[0]) != 0), [len(node)]))
        cut = np.where(two, first[np.minimum(np.searchsorted(first, s + 1), len(first) - 1)], e)
        far = popcount(node[s] ^ node[e - 1]).astype(np.int64)
        ok = np.where(two, far <= MAX_BITS, e - s > 1)
        trie_join(
            keys,
            [s[ok], cut[ok], np.where(two, cut, s)[ok], e[ok], np.where(two, far, 0)[ok]],
            depth, links,
        )
    return links.root


def _deeper(members: DataFrame, depth: int) -> DataFrame:
    """Members of node pairs (lo, hi) at `depth`, as members of the near pairs of their children DEEPER levels down."""
    child = F.shiftrightunsigned("key", BITS - depth - DEEPER)
    node = F.shiftrightunsigned("key", BITS - depth)
    partner = F.when(node == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    far = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi")))
    masks = F.filter(F.array(*(F.lit(m).cast("long") for m in range(1 << DEEPER))), lambda m: far + F.bit_count(m) <= MAX_BITS)
    other = F.shiftleft(partner, DEEPER).bitwiseOR(child.bitwiseAND(F.lit((1 << DEEPER) - 1)).bitwiseXOR(F.col("mask")))
    dealt = members.select("block", "lo", "hi", "key", "fp", F.explode(masks).alias("mask"))
    return dealt.select("block", F.lit(depth + DEEPER).alias("depth"), F.least(child, other).alias("lo"), F.greatest(child, other).alias("hi"), "key", "fp")


def node_groups(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(block, depth, lo, hi, key, fp): each fingerprint in the groups of node pairs that it is to be compared in,
    none of over `hot` fingerprints but where two whole fingerprints are more than that."""
    blocks, width = MAX_BITS + 1, BITS // (MAX_BITS + 1)
    turned = [F.struct(F.lit(j).alias("block"), (F.shiftleft("fp", width * j).bitwiseOR(F.shiftrightunsigned("fp", BITS - width * j) if j else F.lit(0).cast("long"))).alias("key")) for j in range(blocks)]
    rows = distinct.select("fp", F.explode(F.array(*turned)).alias("x")).select("fp", "x.block", "x.key", F.shiftrightunsigned("x.key", BITS - width).alias("node"))
    todo = rows.select("block", F.lit(width).alias("depth"), F.col("node").alias("lo"), F.col("node").alias("hi"), "key", "fp")
    done, depth, pair = [], width, ["block", "lo", "hi"]
    while depth < BITS:
        large = settle(todo.groupBy(*pair).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select(*pair), "large")
        n = large.count()
        if not n:
            break
        if n <= BROADCAST_ROWS:
            large = F.broadcast(large)
        done.append(todo.join(large, pair, "left_anti").select(*todo.columns))
        todo = settle(_deeper(todo.join(large, pair, "left_semi"), depth), "deeper")
        depth += DEEPER
    return reduce(DataFrame.unionByName, done, todo)


def near_links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all near ones, over paths."""
    width, group = BITS // (MAX_BITS + 1), ["block", "depth", "lo", "hi"]
    # Unsigned order of the keys: the top bit is flipped.
    dealt = node_groups(distinct, hot).repartition(*group).sortWithinPartitions(*group, F.col("key").bitwiseXOR(F.lit(-(2**63))))

    def links_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(parts)
        cols = [table.column(n).to_numpy() for n in group]
        if table.num_rows < 2:
            return None
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        root = join_groups(np.cumsum(new), table.column("key").to_numpy().view(np.uint64), table.column("depth").to_numpy() - width, width)
        fp, here = table.column("fp").to_numpy(), np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[here]), pa.array(fp[root[here]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < FLUSH_ROWS:
                continue
            # All but the last group, which may go on.
            last = held[-1]
            same = np.ones(last.num_rows, bool)
            for n in group:
                c = last.column(n).to_numpy(zero_copy_only=False)
                same &= c == c[-1]
            cut = last.num_rows - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                if (out := links_of([*held[:-1], last.slice(0, cut)])) is not None:
                    yield out
                held = [last.slice(cut)]
                size = last.num_rows - cut
        if held and (out := links_of(held)) is not None:
            yield out

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (a, b): root is the least node of its component."""
    edges = settle(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        if mark.n == 0 or mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = settle(small.filter("a != b").distinct(), "links")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """Every row's id with fp (signed long), component_id: the least id of its component, and root: its
    least fingerprint, which tells components apart where an id is repeated.

    Documents with equal fingerprints are one node, and link like any others; those
    without words share fingerprint zero. Null texts are empty; a text of any length is
    taken whole. Ties go to the least id and the least fingerprint. Rows with a null id
    link too; they never name a component unless all its ids are null (then it is
    null). Repeated ids give repeated rows. An empty table gives none. Other columns may have
    any name: they are not read.
    """
    marked = settle(fingerprints(docs, text, (doc_id,)).toDF("doc_id", "fp"), "fingerprints")
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(distinct.select("fp"), hot))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = settle(placed.join(named, "root").select("fp", "component_id", "root", "n"), "by-fp")
    # Fingerprints with many copies are few, so they are broadcast; the others' rows are dealt out by fingerprint.
    many = F.col("n") > max(hot, marked.count() // HEAVY)
    heavy = F.broadcast(by_fp.filter(many).drop("n"))
    rest = marked.join(heavy.select("fp"), "fp", "left_anti").join(by_fp.filter(~many), "fp")
    return marked.join(heavy, "fp").unionByName(rest, allowMissingColumns=True).select("doc_id", "fp", "component_id", "root")
