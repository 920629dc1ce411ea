"""Tokens of two tokenizers aligned by a sweep over their end events.

Each text is encoded by a byte-level vocabulary (A: of a space and the text) and by a piece model (B, which adds that
space itself). The end of each token is an event; a place where tokens of both end cuts them into groups, and
links the two tokens that end there.

Events of both sides are united as rows (document, offset, side, ids), repartitioned by document and sorted within
partitions by offset. A row holds the events of up to BLOCK tokens; ends follow from the ids, as an id has its
length. A state machine streams through them: it keeps the tokens since the last common end and no more, and
gives out a document's links in parts of LINKS and its digest as it goes.

A second pass counts the pairs of ids over all links. The counts come back to the links by a broadcast table if
that has TABLE_PAIRS rows at most, else by a join on the pair.

Both tokenizers work word by word, and mostly part at single spaces. A slice's texts are therefore cut at spaces; the ids
of each distinct chunk are taken from the worker's cache or encoded once, and gathered for all its places at once. Where a
token of A may go on over such a cut (white space on both sides of it), chunks are put together; texts with chunks of over
CHUNK characters are split as a whole. Caches have two generations, so words that come back stay. Chunks and texts of code points under 0x250 are split by a pattern of the
standard library, others by the library's own splitter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import col, slices
from .bpe import LONG as LONG_WORD
from .bpe import WordBpe, byte_alphabet
from .staging import settle
from .token_counts import MARK, load_model, pre_tokens

#: Tokens of a row of events, characters that are encoded at a time, links of a part.
BLOCK = 1 << 14
SEGMENT = 1 << 20
LINKS = 1 << 16
#: 13 bytes each when broadcast.
TABLE_PAIRS = 4_000_000
COUNT_LINKS = 1 << 22
CACHE_ENTRIES = 400_000
CACHED_CHARS = 48
#: Bytes of texts that are encoded at a time, characters of a chunk that may have a head, and words of a call of a library.
SLICE = 2 << 20
CHUNK = 2_000
WORDS = 2_048
#: Below so many words the library is faster than arrays.
FEW = 4_096
#: A chunk's head: how many ids of A follow, and whether it begins or ends with white space. Two heads stand alone: for chunks
#: whose ids spell something else, and for those of over CHUNK characters.
LEAD, TRAIL, WRONG, LONG = 1 << 14, 1 << 15, 0xFFFE, 0xFFFF
CODEC = "zstd"
DIRECT = re.compile("[^\x00-ɏ]")
CUT = re.compile(r"(?<=\S) (?=\S)")
BYTE = re.compile("<0x([0-9A-F]{2})>")


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed bytes, each of their bytes in a plane of its own."""
    raw = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return values.dtype.itemsize.to_bytes(1, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec=CODEC, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    width, size = blob[0], int.from_bytes(blob[1:9], "little")
    raw = np.frombuffer(pa.decompress(blob[9:], decompressed_size=size, codec=CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, size // width).T).view(f"<u{width}").ravel()


def splitter() -> re.Pattern:
    """The byte-level splitting pattern for code points under 0x250, in the standard library's syntax."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(0x250)):
        if (k := unicodedata.category(c)[0]) in kinds:
            kinds[k] += re.escape(c)
    white = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{kinds['L']}]+| ?[{kinds['N']}]+| ?[^{white}{kinds['L']}{kinds['N']}]+|[{white}]+(?![^{white}])|[{white}]+")


class Recent:
    """A cache of two generations: when the young one is full it becomes the old one, from which what is used comes back."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        """Values of distinct keys; None where there is none."""
        got = list(map(self.young.get, keys))
        if self.old:
            back = {k: x for k, v in zip(keys, got) if v is None and (x := self.old.get(k)) is not None}
            if back:
                got = [back.get(k) if v is None else v for k, v in zip(keys, got)]
                self.put(back)
        return got

    def put(self, found: dict[str, bytes]) -> None:
        if self.young and len(self.young) + len(found) > CACHE_ENTRIES // 2:
            self.young, self.old = {}, self.young
        self.young.update(found)


class Side:
    """One tokenizer: the ids of words, and the bytes of ids. A word whose ids spell something else has none: b""."""

    def __init__(self, spelled: list[bytes]):
        if len(spelled) > 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.spelled = spelled
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.names = np.array([str(i) for i in range(len(spelled))], object)
        self.cache = Recent()

    def ids_of(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def raw(self, word: str) -> bytes:
        return word.encode()

    def fresh(self, words: list[str]) -> list[bytes]:
        """Ids of words as 16-bit integers in the machine's order, from the library. WORDS at a time, so that the lists it returns stay few."""
        return list(chain.from_iterable(self._fresh(words[i : i + WORDS]) for i in range(0, len(words), WORDS)))

    def _fresh(self, words: list[str]) -> list[bytes]:
        ids = self.ids_of(words)
        flat, raws = array("H", chain.from_iterable(ids)), list(map(self.raw, words))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        spelled = np.concatenate(([0], np.cumsum(self.length[np.frombuffer(flat, np.uint16)])))[ends]
        blob, cuts = flat.tobytes(), [0, *(2 * ends).tolist()]
        found = [blob[s:e] for s, e in zip(cuts, cuts[1:])]
        if np.array_equal(spelled, np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))) and b"".join(map(self.spelled.__getitem__, flat)) == b"".join(raws):
            return found
        return [x if b"".join(map(self.spelled.__getitem__, i)) == r else b"" for x, i, r in zip(found, ids, raws)]

    def values(self, words: list[str]) -> list[bytes]:
        """The same for distinct words, by the cache."""
        got = self.cache.find(words)
        new = [w for w, v in zip(words, got) if v is None]
        if not new:
            return got
        made = dict(zip(new, self.fresh(new)))
        self.cache.put({w: v for w, v in made.items() if len(w) <= CACHED_CHARS})
        return [made[w] if v is None else v for w, v in zip(words, got)]

    def encode(self, words: list[str]) -> bytes | None:
        """Ids of words one after another."""
        distinct = list(dict.fromkeys(words))
        found = dict(zip(distinct, self.values(distinct)))
        return b"".join(map(found.__getitem__, words)) if all(found.values()) else None


class Merges(WordBpe):
    """The merges of a byte-level vocabulary, by the rank arrays of bpe.py."""

    def __init__(self, model: dict):
        if model.get("unk_token") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE of the kind known here")
        vocab = model["vocab"]
        self.inner = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self._build_table(keys[order], order.astype(np.int32))

    def ids_by_place(self, raws: list[bytes]) -> list[bytes]:
        """Ids of words in bytes, as 16-bit integers; b"" for words over LONG_WORD."""
        out, by_length = [b""] * len(raws), defaultdict(list)
        for i, n in enumerate(map(len, raws)):
            by_length[n].append(i)
        for n, same in by_length.items():
            if n > LONG_WORD:
                continue
            data = np.frombuffer(b"".join(map(raws.__getitem__, same)), np.uint8).reshape(-1, n)
            for rows, merged in self.merge_rows(self.inner[data]):
                width, flat = 2 * merged.shape[1], merged.astype(np.uint16).tobytes()
                for k, row in enumerate(rows.tolist()):
                    out[same[row]] = flat[k * width : (k + 1) * width]
        return out


class ByteSide(Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core: the library's threads, one per core of the machine in each worker, add to its CPU time.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = json.load(open(path, encoding="utf-8"))
        first, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or first.get("type") != "ByteLevel" or first["add_prefix_space"] or not first["use_regex"] or model["type"] != "BPE":
            raise ValueError(f"{path}: not a byte-level BPE of the kind known here")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        entries = {t["id"]: b"" for t in spec["added_tokens"]} | {i: b"".join(byte_of.get(c, b"") for c in w) for w, i in model["vocab"].items()}
        super().__init__([entries.get(i, b"") for i in range(max(entries) + 1)])
        self.merges = Merges(model)
        self.direct = splitter()

    def fresh(self, words: list[str]) -> list[bytes]:
        """By merges, which spell their word; long words, and few, by the library."""
        if len(words) < FEW:
            return super().fresh(words)
        found = self.merges.ids_by_place(list(map(str.encode, words)))
        if not all(found):
            long = [w for w, ids in zip(words, found) if not ids]
            rest = iter(super().fresh(long))
            found = [ids or next(rest) for ids in found]
        return found

    def ids_of(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def words(self, segment: str) -> list[str]:
        if segment.isascii() or not DIRECT.search(segment):
            return self.direct.findall(segment)
        return [segment[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(segment)]


class PieceSide(Side):
    def __init__(self, path: str):
        self.library = load_model(path)
        super().__init__([self._bytes(self.library.id_to_piece(i)) for i in range(self.library.get_piece_size())])

    @staticmethod
    def _bytes(piece: str) -> bytes:
        found = BYTE.fullmatch(piece)
        return bytes([int(found[1], 16)]) if found else piece.replace(MARK, " ").encode()

    def raw(self, word: str) -> bytes:
        return b" " + word.encode()

    def ids_of(self, words: list[str]) -> list[list[int]]:
        lone = [self.library.piece_to_id(MARK)]
        return [ids or lone for ids in self.library.encode(words, num_threads=1)]

    def words(self, segment: str) -> list[str]:
        return pre_tokens(segment[1:]) if len(segment) > 1 else [""]


_loaded: dict[tuple[str, str], tuple[Side, Side]] = {}
_chunks: dict[tuple[str, str], Recent] = {}


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = ByteSide(path_a), PieceSide(path_b)
    return _loaded[path_a, path_b]


def segments(text: str) -> Iterator[str]:
    """A space and the text, cut before single spaces between words, where no token of either side goes on."""
    text, start = " " + text, 0
    while len(text) - start > SEGMENT and (found := CUT.search(text, start + SEGMENT)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encoded(both: tuple[Side, Side], text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of A and of B; None where they don't spell a space and the text."""
    if not text or MARK in text:
        return None
    parts: tuple[list[bytes], list[bytes]] = ([], [])
    for segment in segments(text):
        for side, out in zip(both, parts):
            ids = side.encode(side.words(segment))
            if ids is None:
                return None
            out.append(ids)
    return tuple(np.frombuffer(b"".join(p), np.uint16) for p in parts)


def chunk_values(both: tuple[Side, Side], known: Recent, chunks: list[str]) -> list[bytes]:
    """Of distinct chunks, each without the space before it: the head, ids of A, ids of B."""
    got = known.find(chunks)
    new = [c for c, v in zip(chunks, got) if v is None and len(c) <= CHUNK]
    a, b = both
    words = [a.words(" " + c) for c in new]
    distinct = list(dict.fromkeys(chain.from_iterable(words)))
    ids = dict(zip(distinct, a.values(distinct)))
    made: dict[str, bytes] = {}
    for c, split, of_b in zip(new, words, b.fresh(new)):
        parts = [ids[w] for w in split]
        if of_b and all(parts):
            of_a = b"".join(parts)
            head = len(of_a) // 2 | LEAD * (not c or c[0].isspace()) | TRAIL * (not c or c[-1].isspace())
            made[c] = head.to_bytes(2, sys.byteorder) + of_a + of_b
        else:
            made[c] = WRONG.to_bytes(2, sys.byteorder)
    known.put({c: v for c, v in made.items() if len(c) <= CACHED_CHARS})
    long = LONG.to_bytes(2, sys.byteorder)
    return [made.get(c, long) if v is None else v for c, v in zip(chunks, got)]


def joined(chunks: list[str]) -> list[str]:
    """Chunks put together where white space stands on both sides of the cut."""
    out: list[str] = []
    parts = chunks[:1]
    for before, c in zip(chunks, chunks[1:]):
        if (not before or before[-1].isspace()) and (not c or c[0].isspace()):
            parts.append(c)
        else:
            out.append(" ".join(parts))
            parts = [c]
    return [*out, " ".join(parts)]


def gathered(both: tuple[Side, Side], known: Recent, cut: Iterator[tuple[int, list[str]]]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], list[int], list[int]]:
    """Ids of texts by their numbers and chunks. Numbers of texts where white space meets over a cut, and of those with long chunks, stand apart."""
    rows, counts = [], []
    place: defaultdict[str, int] = defaultdict(count().__next__)
    index = array("i")
    for i, chunks in cut:
        index.extend(map(place.__getitem__, chunks))
        rows.append(i)
        counts.append(len(chunks))
    if not rows:
        return {}, [], []
    values = chunk_values(both, known, list(place))
    size = np.fromiter(map(len, values), np.int64, len(values)) // 2
    blob, start = np.frombuffer(b"".join(values), np.uint16), np.cumsum(size) - size
    head, at, ends = blob[start], np.frombuffer(index, np.int32), np.cumsum(counts)
    many = np.where(size > 1, head & (LEAD - 1), 0).astype(np.int64)
    meet = np.zeros(len(at), bool)
    meet[1:] = (head[at[:-1]] & TRAIL != 0) & (head[at[1:]] & LEAD != 0)
    meet[ends[:-1]] = False
    meets, longs, wrongs = (np.logical_or.reduceat(x, ends - counts).tolist() for x in (meet, (head == LONG)[at], (head == WRONG)[at]))
    sides: list[list[np.ndarray]] = []
    for first, n in ((start + 1, many), (start + 1 + many, size - 1 - many)):
        each = n[at]
        upto = np.cumsum(each)
        ids = blob[np.repeat(first[at] - upto + each, each) + np.arange(upto[-1])]
        sides.append(np.split(ids, upto[ends[:-1] - 1]))
    kept = {i: (x, y) for i, x, y, *no in zip(rows, *sides, meets, longs, wrongs) if not any(no)}
    return kept, [i for i, m, x in zip(rows, meets, longs) if m and not x], [i for i, x in zip(rows, longs) if x]


def encoded_texts(both: tuple[Side, Side], known: Recent, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """What `encoded` gives of each text, for all of them at once."""
    some = [i for i, t in enumerate(texts) if t and MARK not in t and len(t) <= SEGMENT]
    found, meet, whole = gathered(both, known, ((i, pre_tokens(texts[i])) for i in some))
    more, _, long = gathered(both, known, ((i, joined(pre_tokens(texts[i]))) for i in meet))
    found |= more
    whole += long + [i for i, t in enumerate(texts) if t and len(t) > SEGMENT]
    for i in whole:
        if (got := encoded(both, texts[i])) is not None:
            found[i] = got
    return [found.get(i) for i in range(len(texts))]


def events(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(key, at, side, d, ids): up to BLOCK events of one side of a document from byte `at` on. Side 0 has a row for each
    document, even without tokens; its first one carries the id."""
    kind = docs.schema[doc_id].dataType
    narrow = docs.select(F.monotonically_increasing_id().alias("key"), col(doc_id).alias("d"), col(text).cast("string").alias("t"))
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("at", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("d", kind), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, known = sides(path_a, path_b), _chunks.setdefault((path_a, path_b), Recent())
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                rows: list[tuple] = []
                ready = encoded_texts(both, known, part.column(2).to_pylist())
                for key, d, got in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ready):
                    if got is None:
                        rows.append((key, 0, 0, d, None))
                        continue
                    for i, ids in enumerate(got):
                        at = 0
                        for s in range(0, len(ids), BLOCK):
                            some = ids[s : s + BLOCK]
                            rows.append((key, at, i, None if s or i else d, pack(some)))
                            at += int(both[i].length[some].sum())
                keys, ats, side, ds, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ats, pa.int64()), pa.array(side, pa.int32()), pa.array(ds, part.schema.field(1).type), pa.array(ids, pa.binary())], [f.name for f in out.fields])

    return narrow.mapInArrow(run, out)


class Sweep:
    """The machine of one document: tokens of both sides since the last common end."""

    def __init__(self, both: tuple[Side, Side]):
        self.both = both
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.at = [0, 0]
        self.n = [0, 0]
        self.groups = 0
        self.digest = hashlib.sha256()

    def feed(self, side: int, ids: np.ndarray) -> np.ndarray:
        """Take events of a side; returns the links (a << 16 | b) that are settled by them."""
        ids = ids.astype(np.int64)
        ends = self.at[side] + np.cumsum(self.both[side].length[ids])
        self.n[side] += len(ids)
        self.at[side] = int(ends[-1]) if len(ends) else self.at[side]
        self.ids[side], self.ends[side] = (np.concatenate(x) if len(x[0]) else x[1] for x in ((self.ids[side], ids), (self.ends[side], ends)))
        (a, b), (ea, eb) = self.ids, self.ends
        if not len(ea) or not len(eb):
            return np.zeros(0, np.uint32)
        place = np.minimum(np.searchsorted(ea, eb), len(ea) - 1)
        last_b = np.flatnonzero(ea[place] == eb)
        if not len(last_b):
            return np.zeros(0, np.uint32)
        last_a = place[last_b]
        na, nb = int(last_a[-1]) + 1, int(last_b[-1]) + 1
        self._write(a[:na], b[:nb], last_a, last_b)
        self.groups += len(last_a)
        for x in (self.ids, self.ends):
            x[0], x[1] = x[0][na:], x[1][nb:]
        return (a[last_a] << 16 | b[last_b]).astype(np.uint32)

    def _write(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> None:
        """Add whole groups to the digest: ids of A, |, ids of B; groups are parted by ;."""
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        before_a, before_b = np.repeat(last_b - size_b + 1, size_a), np.repeat(last_a + 1, size_b)
        at_a, at_b = np.arange(len(a)) + before_a, np.arange(len(b)) + before_b
        words = np.empty(2 * (len(a) + len(b)), object)
        marks = words[1::2]
        ids = words[::2]
        ids[at_a], ids[at_b] = self.both[0].names[a], self.both[1].names[b]
        marks[:] = ","
        marks[at_a[last_a]], marks[at_b[last_b]] = "|", ";"
        text = "".join(words.tolist())[:-1]
        self.digest.update((";" + text if self.groups else text).encode())


def sweep(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(key, whole, doc, links) from events that are sorted by key, offset and side.

    doc is a document's figures, in its last row; links (packed) come in parts; whole says that a row has both.
    """
    kind = rows.schema["d"].dataType
    fields = [("d", kind), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("doc", T.StructType([T.StructField(n, k) for n, k in fields])), T.StructField("links", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        made: list[tuple] = []
        kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        state: dict = {"key": None}

        def end() -> None:
            m, links = state["machine"], np.concatenate(state["links"] or [np.zeros(0, np.uint32)])
            figures = (state["d"], m.n[0], m.n[1], m.groups, m.groups, m.digest.hexdigest() if m.n[0] else "")
            made.append((state["key"], not state["parts"], figures, pack(links)))

        def ready() -> pa.RecordBatch:
            keys, whole, docs, links = zip(*made)
            made.clear()
            cols = list(zip(*(d if d is not None else (None,) * len(fields) for d in docs)))
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            doc = pa.StructArray.from_arrays(arrays, [n for n, _ in fields], mask=pa.array([d is None for d in docs]))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(whole), doc, pa.array(links, pa.binary())], ["key", "whole", "doc", "links"])

        for batch in batches:
            kinds[0] = batch.schema.field(3).type
            for key, _, side, d, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if key != state["key"]:
                    if state["key"] is not None:
                        end()
                    state = {"key": key, "d": d, "machine": Sweep(both), "links": [], "held": 0, "parts": 0}
                if ids is None:
                    continue
                found = state["machine"].feed(side, unpack(ids))
                if len(found):
                    state["links"].append(found)
                    state["held"] += len(found)
                if state["held"] >= LINKS:
                    made.append((key, False, None, pack(np.concatenate(state["links"]))))
                    state["links"], state["held"], state["parts"] = [], 0, state["parts"] + 1
            if made:
                yield ready()
        if state["key"] is not None:
            end()
            yield ready()

    return rows.mapInArrow(run, out)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each pair of ids, and whether that is the most of its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(unpack(blob))
                size += len(held[-1])
                if size >= COUNT_LINKS:
                    yield counted()
                    size = 0
        if size:
            yield counted()

    counts = settle(swept.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFF))
    # A row per B id: at most 65,536.
    most = F.broadcast(counts.groupBy(b.alias("b")).agg(F.max("n").alias("most")))
    return settle(counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _by_table(swept: DataFrame, counts: DataFrame) -> DataFrame:
    """swept with n_best and count_sum of each row's links, from a broadcast table."""
    got = counts.toPandas().sort_values("pair")
    shared = counts.sparkSession.sparkContext.broadcast((got["pair"].to_numpy(np.uint32), got["n"].to_numpy(np.int64), got["best"].to_numpy(bool)))
    out = T.StructType([f for f in swept.schema.fields if f.name != "links"]).add("n_best", "long").add("count_sum", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            links = [unpack(x) for x in batch.column(3).to_pylist()]
            at = np.searchsorted(pairs, np.concatenate(links))
            ends = np.cumsum([len(x) for x in links])
            sums = [np.concatenate(([0], np.cumsum(x[at]))) for x in (n, best.astype(np.int64))]
            total, most = (np.diff(s[ends], prepend=0) for s in sums)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(most.astype(np.int64)), pa.array(total.astype(np.int64))], [f.name for f in out.fields])

    return swept.mapInArrow(run, out)


def _by_join(swept: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join on the pair: a row per pair that a row of links holds."""
    kept = [f for f in swept.schema.fields if f.name != "links"]
    rows = settle(swept.select(F.monotonically_increasing_id().alias("r"), "*"), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs, n = np.unique(unpack(blob), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), r)), pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], ["r", "pair", "k"])

    held = rows.select("r", "links").mapInArrow(run, "r long, pair long, k long").join(counts, "pair")
    sums = held.groupBy("r").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "r", "left").select(*(f.name for f in kept), zero("n_best"), zero("count_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256 of every row.

    Null and empty texts, and those whose tokens spell something else on either side (a text with the word mark U+2581
    among them), have no tokens: zeros and ''. Texts of any length are encoded whole. Each row is a document of its own:
    repeated rows and ids count again in the corpus-wide counts; null ids come back as null. Ties of the highest count all
    count as best. An empty table gives none. Other columns may have any name: they are not read. Rows are told apart by
    their place in the table, so that has to give the same rows when a lost task reads it again.
    """
    rows = events(docs, path_a, path_b, text, doc_id).repartition("key").sortWithinPartitions("key", "at", "side")
    swept = settle(sweep(rows, path_a, path_b), "swept")
    counts = pair_counts(swept)
    small = counts.limit(TABLE_PAIRS + 1).count() <= TABLE_PAIRS
    scored = _by_table(swept, counts) if small else _by_join(swept, counts)
    sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
    parts = scored.filter("not whole").groupBy("key").agg(F.first("doc", ignorenulls=True).alias("doc"), *sums)
    found = scored.filter("whole").select("doc", "n_best", "count_sum").union(parts.select("doc", "n_best", "count_sum"))
    return found.select(F.col("doc.d").alias(doc_id), "doc.n_a", "doc.n_b", "doc.n_groups", "doc.n_links", "n_best", "count_sum", "doc.groups_sha256")
