"""Benchmark decontamination with one Aho-Corasick automaton.

Items and documents are lower-cased (A-Z) and cut into words; every window of
WINDOW item words (a shorter item: all of it) is a pattern: a string of two characters per
word, or as many as it takes to number the words of a block in DIGITS signs. Such a trie takes
a half to a third of the memory of one over letters, and its nodes have few children, so that a
step is as fast. A document's words, written alike (a word of no item: zeros), are scanned
once; ends of matches are word positions, which are mapped to offsets of the original text.

Items of up to BLOCK_BYTES make one automaton, which each Python worker builds from a
broadcast list. The windows of a larger benchmark are dealt out to blocks by the least hash of
their word pairs, which windows that follow each other mostly share; crowded blocks are parted
by the windows' hashes. Documents are scanned once: windows that a bit table of the benchmark's
hashes (FILTER_BITS at most) may know leave as runs of words for their block. There one task a block
(more, with the rows dealt out, if its runs are large) builds the block's automaton and
streams the runs through it, all blocks in one job. Hits are brought together per row and joined back.
The table only saves shuffling; no item is left out, and only the automata decide.

Null and empty texts have no words and no hits; a text of any length is scanned whole. Items
without words have no window; items with equal texts (ties) are all reported; items without
an id hit like any other and come out as one null at the end of `items`; repeated rows are
judged one by one; an empty benchmark leaves every document clean, and an empty table gives
none. An input column named like a result column is left out of the output.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import byte_texts, col, map_texts, slices
from .staging import settle

WINDOW = 10
#: An automaton takes some 200 bytes of memory a byte of items.
BLOCK_BYTES = 1 << 20
#: Runs of one block that one task takes.
RUN_BYTES = 64 << 20
#: Size of the bit table as a power of two: 128 MiB at most, 16 bits a window below that.
FILTER_BITS = 30
DIGITS = 128

#: A-Z to a-z; 0-9, a-z and every byte of a multi-byte character stay; the rest is a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_built: dict[str, tuple] = {}


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_TABLE).split()


def windows(items: list[tuple[str | None, bytes]]) -> dict[bytes, tuple[int, list[str | None]]]:
    """Pattern to its number of words and the ids of its items."""
    out: dict[bytes, tuple[int, list[str | None]]] = {}
    for item, raw in items:
        words = words_of(raw)
        n = min(WINDOW, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            known = out.setdefault(b" " + b" ".join(words[i : i + n]) + b" ", (n, []))[1]
            if item not in known:
                known.append(item)
    return out


def word_codes(patterns: Iterable[bytes]) -> tuple[dict[bytes, str], int]:
    """The string that stands for each word of the patterns, and the length of these strings."""
    words = dict.fromkeys(w for p in patterns for w in p.split())
    width = 2
    while DIGITS**width < len(words):
        width += 1
    # The first sign is of a range of its own, so that no match begins inside a word.
    codes = {w: "".join(chr(i // DIGITS**k % DIGITS) for k in range(width)) for i, w in enumerate(words)}
    return {w: chr(DIGITS + ord(c[0])) + c[1:] for w, c in codes.items()}, width


def automaton(key: str, items: list[tuple[str | None, bytes]]):
    """The automaton, its patterns, and the codes of its words and their length, once per process."""
    if key not in _built:
        _built.clear()
        _built[key] = _build(items)
    return _built[key]


def _build(items: list[tuple[str | None, bytes]]) -> tuple:
    import ahocorasick

    found, values, patterns = ahocorasick.Automaton(), [], windows(items)
    codes, width = word_codes(patterns)
    for pattern, value in patterns.items():
        found.add_word("".join(codes[w] for w in pattern.split()), len(values))
        values.append(value)
    if values:
        found.make_automaton()
    return found, values, codes, width


def word_starts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words of a text begin and end."""
    inside = np.frombuffer(raw.translate(WORD_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _block_count(items: DataFrame) -> int:
    """How many blocks of about BLOCK_BYTES the items (i, t) make."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    return max(1, -(-int(size) // BLOCK_BYTES))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS = "array<struct<start:long,end:long>>"
OUT = [("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"), ("spans", _SPANS)]


def _pairs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def _char_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets of spans of words."""
    starts, stops = word_starts(raw)
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(lead[starts[a]]), int(lead[stops[b - 1]])) for a, b in spans]


def _hits(automaton: tuple, words: list[bytes]) -> tuple[set[str | None], list[tuple[int, int]]]:
    """Ids of the items that occur in some words, and where, not merged."""
    found, values, codes, width = automaton
    names: set[str | None] = set()
    spans = []
    if values and words:
        for end, v in found.iter("".join(map(codes.get, words, repeat("\0" * width)))):
            end = (end + 1) // width
            spans.append((end - values[v][0], end))
            names.update(values[v][1])
    return names, spans


def _ordered(names: Iterable[str | None]) -> list[str | None]:
    return sorted(names, key=lambda x: (x is None, x or ""))


def _kernel(*automaton):
    """Arrays of OUT for texts."""

    def kernel(array: pa.Array):
        n_words, n_hit, ids, chars = [], [], [], []
        for raw in byte_texts(array):
            words = words_of(raw)
            names, spans = _hits(automaton, words)
            spans = merged(spans)
            n_words.append(len(words))
            n_hit.append(sum(b - a for a, b in spans))
            ids.append(_ordered(names))
            chars.append(_pairs(_char_spans(raw, spans) if spans else []))
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(chars, SPANS)]

    return kernel


def _put_to(docs: DataFrame, text: str, items: list[tuple[str | None, bytes]], keep: list[str]) -> DataFrame:
    """OUT of every row for a benchmark of one block."""
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex  # about BLOCK_BYTES

    def factory():
        return _kernel(*automaton(key, shared.value))

    return map_texts(docs, text, OUT, factory, keep)


_ODD = np.random.default_rng(11).integers(0, 1 << 63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return (x ^ (x >> np.uint64(29))) * _ODD[1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of n words, and the least hash of a pair of its words (n = 1: of the word)."""
    m = len(w) - n + 1
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h += w[k : k + m] * _ODD[k]
    pairs = _mixed(w[:-1] * _ODD[2] + w[1:] * _ODD[3] if n > 1 else w * _ODD[2])
    least = pairs[:m].copy()
    for k in range(1, n - 1):
        np.minimum(least, pairs[k : k + m], out=least)
    return _mixed(h), least


class Blocks:
    """How windows are dealt out: `parts` of each home, by the windows' hashes; keys number all parts."""

    def __init__(self, parts: np.ndarray):
        self.parts = parts.astype(np.uint64)
        self.first = np.concatenate(([0], np.cumsum(parts)[:-1])).astype(np.uint64)

    def keys(self, h: np.ndarray, least: np.ndarray) -> np.ndarray:
        home = (least % np.uint64(len(self.parts))).astype(np.int64)
        return (self.first[home] + h % self.parts[home]).astype(np.int64)


def _runs(keys: np.ndarray, chosen: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, first window, one after the last) of runs of chosen windows with one key, for ascending numbers of windows."""
    if not len(chosen):
        return []
    own = keys[chosen]
    cut = np.flatnonzero((np.diff(chosen) != 1) | (np.diff(own) != 0)) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(chosen)]))
    return [(int(own[i]), int(chosen[i]), int(chosen[j - 1]) + 1) for i, j in zip(starts.tolist(), ends.tolist())]


def _known(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Numbers of the windows that the bit table may hold: both their bits, of a hash's first and last part, are set."""
    chosen = np.arange(len(h))
    for at in (h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)):
        at = at[chosen]
        chosen = chosen[(table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1) == 1]
    return chosen


_WINDOW = "array<struct<n:int,h:long,least:long,bytes:double>>"
_RUN = pa.list_(pa.struct([("key", pa.int64()), ("a", pa.int64()), ("words", pa.string())]))
LONGS = pa.list_(pa.int64())


def _item_windows():
    kind = pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64()), ("least", pa.int64()), ("bytes", pa.float64())]))

    def kernel(array: pa.Array):
        out = []
        for raw in byte_texts(array):
            words = words_of(raw)
            n = min(WINDOW, len(words))
            h, least = window_hashes(word_hashes(words), n) if n else (np.zeros(0, np.uint64),) * 2
            per = sum(map(len, words)) / max(1, len(words)) + 1
            out.append([{"n": n, "h": x, "least": y, "bytes": per} for x, y in zip(h.view(np.int64).tolist(), least.view(np.int64).tolist())])
        return [pa.array(out, kind)]

    return kernel


def _pieces(blocks: Blocks):
    """Runs of an item's windows with one key."""

    def kernel(array: pa.Array):
        out = []
        for raw in byte_texts(array):
            words, runs = words_of(raw), []
            n = min(WINDOW, len(words))
            if n:
                keys = blocks.keys(*window_hashes(word_hashes(words), n))
                runs = [{"key": k, "a": a, "words": b" ".join(words[a : b + n - 1]).decode()} for k, a, b in _runs(keys, np.arange(len(keys)))]
            out.append(runs)
        return [pa.array(out, _RUN)]

    return kernel


_SCAN = [("n_words", "long"), ("at", "array<long>"), ("from", "array<long>"), ("to", "array<long>"), ("runs", "array<struct<key:long,a:long,words:string>>")]


def _scan(table: np.ndarray, bits: int, lengths: list[int], blocks: Blocks):
    """Arrays of _SCAN: number of words; numbers and offsets of the words in runs; runs of windows the table may know."""

    def kernel(array: pa.Array):
        n_words, at, start, stop, runs = [], [], [], [], []
        for raw in byte_texts(array):
            words, found = words_of(raw), []
            w = word_hashes(words)
            for n in lengths:
                if n <= len(words):
                    h, least = window_hashes(w, n)
                    known = _known(table, bits, h)
                    found += [(k, a, b + n - 1) for k, a, b in _runs(blocks.keys(h, least), known)]
            inside = [j for a, b in merged([(a, b) for _, a, b in found]) for j in range(a, b)]
            chars = _char_spans(raw, [(j, j + 1) for j in inside]) if inside else []
            n_words.append(len(words))
            at.append(inside)
            start.append([a for a, _ in chars])
            stop.append([b for _, b in chars])
            runs.append([{"key": k, "a": a, "words": b" ".join(words[a:b]).decode()} for k, a, b in found])
        return [pa.array(n_words, pa.int64()), pa.array(at, LONGS), pa.array(start, LONGS), pa.array(stop, LONGS), pa.array(runs, _RUN)]

    return kernel


def _through_automata(batches):
    """Hits of runs, streamed behind the pieces of their block: rows are sorted by key and deal, pieces first."""
    held, items, ready = None, [], None
    for batch in batches:
        for part in slices(batch, 5):
            rows, ids, spans = [], [], []
            for key, deal, piece, row, a, words, item in zip(*(c.to_pylist() for c in part.columns)):
                if (key, deal) != held:
                    held, items, ready = (key, deal), [], None
                if piece:
                    items.append((item, words.encode()))
                    continue
                if ready is None:
                    ready = _build(items)
                names, found = _hits(ready, words.encode().split())
                if found:
                    rows.append(row)
                    ids.append(_ordered(names))
                    spans.append(_pairs([(a + x, a + y) for x, y in merged(found)]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, SPANS)], ["_row", "_items", "_words"])


def _brought_together():
    """Arrays of OUT from a row's number of words, the places of its runs' words, and its hits."""

    def kernel(_, n_words: pa.Array, at: pa.Array, start: pa.Array, stop: pa.Array, items: pa.Array, words: pa.Array):
        n_hit, ids, chars = [], [], []
        for i in range(len(n_words)):
            spans = merged([(x["start"], x["end"]) for x in words[i].as_py() or ()])
            n_hit.append(sum(b - a for a, b in spans))
            ids.append(_ordered(set(items[i].as_py() or ())))
            out = []
            if spans:
                place = {k: j for j, k in enumerate(at[i].as_py())}
                a, b = start[i].as_py(), stop[i].as_py()
                out = [(a[place[x]], b[place[y - 1]]) for x, y in spans]
            chars.append(_pairs(out))
        return [n_words, pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(chars, SPANS)]

    return kernel


def _in_blocks(docs: DataFrame, text: str, items: DataFrame, n: int, names: list[str]) -> DataFrame:
    """OUT of every row for a benchmark of about n blocks: one scan of the documents, one job for all automata."""
    spark = docs.sparkSession
    windows_ = settle(map_texts(items, "t", [("w", _WINDOW)], _item_windows).select(F.inline("w")), "windows")
    counts = windows_.groupBy("n").count().collect()  # at most WINDOW rows
    lengths = sorted(r.n for r in counts)
    bits = min(FILTER_BITS, max(15, (16 * sum(r["count"] for r in counts)).bit_length()))
    # Unsigned remainder of the least hash, as Blocks.keys takes it.
    home = F.pmod(F.pmod(F.shiftrightunsigned("least", 1), F.lit(n)) * 2 + F.col("least").bitwiseAND(F.lit(1)), F.lit(n))
    parts = np.ones(n, np.int64)
    for r in windows_.groupBy(home.alias("home")).agg(F.sum("bytes").alias("b")).collect():  # a row a MiB of the benchmark
        parts[r.home] = max(1, -(-int(r.b) // (2 * BLOCK_BYTES)))
    blocks = Blocks(parts)
    places = F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1)))
    place = F.col("p") + 1
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in windows_.select(F.explode(places).alias("p")).groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).toLocalIterator():
        table[(r.k - 1) << 12 : r.k << 12] = np.frombuffer(r.m, np.uint8)
    shared = spark.sparkContext.broadcast(table)  # FILTER_BITS bounds it

    kept = [f"_k{i}" for i in range(len(names))]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), col(text).cast("string").alias("_text"), *(col(x).alias(k) for x, k in zip(names, kept)))
    scanned = settle(map_texts(rows, "_text", _SCAN, lambda: _scan(shared.value, bits, lengths, blocks), ["_row", *kept]), "scanned")
    runs = scanned.select("_row", F.inline("runs"))
    deals = runs.groupBy("key").agg(F.ceil(F.sum(F.octet_length("words")) / F.lit(RUN_BYTES)).alias("n"))  # a row a key
    deals = settle(deals, "deals")
    dealt = runs.join(F.broadcast(deals), "key").select(
        "key", F.pmod(F.xxhash64("_row", "a"), F.col("n")).alias("deal"), F.lit(False).alias("piece"), "_row", "a", "words", F.lit(None).cast("string").alias("item"),
    )
    pieces = map_texts(items, "t", [("p", "array<struct<key:long,a:long,words:string>>")], lambda: _pieces(blocks), ["i"]).select("i", F.inline("p"))
    pieces = pieces.join(F.broadcast(deals), "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("deal"), F.lit(True).alias("piece"), F.lit(None).cast("long").alias("_row"), "a", "words", F.col("i").alias("item"),
    )
    tasks = deals.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]  # named, so that blocks aren't put together for being small
    by_block = dealt.unionByName(pieces).repartition(int(tasks), "key", "deal").sortWithinPartitions("key", "deal", F.desc("piece"))
    hits = by_block.mapInArrow(_through_automata, f"_row long, _items array<string>, _words {_SPANS}")
    hits = hits.groupBy("_row").agg(F.flatten(F.collect_set("_items")).alias("_items"), F.flatten(F.collect_list("_words")).alias("_words"))
    joined = scanned.drop("runs").withColumnsRenamed({x: f"_{x}" for x, _ in _SCAN[:4]}).join(hits, "_row", "left").withColumn("_none", F.lit(""))
    whole = map_texts(joined, "_none", OUT, _brought_together, kept, ("_n_words", "_at", "_from", "_to", "_items", "_words"))
    return whole.select(*(col(k).alias(x) for x, k in zip(names, kept)), "n_words", "n_hit", "items", "spans")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Columns `keep` with n_words, n_hit, items (sorted ids with occurring windows, null last) and
    spans (hit stretches as code point offsets of the original text, half-open)."""
    names = [n for n in keep if n.lower() not in {x for x, _ in OUT}]
    items = benchmark.select(col(item).cast("string").alias("i"), F.coalesce(col(item_text).cast("string"), F.lit("")).alias("t"))
    n = _block_count(items)
    if n > 1:
        return _in_blocks(docs, text, items, n, names)
    found = _put_to(docs, text, [(r.i, r.t.encode()) for r in items.collect()], names)
    return found.select(*map(col, names), "n_words", "n_hit", "items", "spans")
