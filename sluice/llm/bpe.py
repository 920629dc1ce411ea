"""Word-level BPE encoding and decoding with contiguous rank arrays.

A short word is a row of symbol ids beside a row of ranks of its adjacent pairs.
The least rank is looked for, that boundary is deleted, the arrays close up, and
the two neighbouring ranks are looked up anew, until no pair has a rank. Words of
one length are worked on together: each round deletes one boundary of each word
that is still open, so open rows stay of one length. Words of over LONG bytes
use a linked list with a heap instead, which gives the same merges in n log n.

The text is prepared as the vocabulary file says: special strings are cut out
first, then NFC, white space, lower case, the splitting pattern and the byte
alphabet. Texts that are of code points under 0x250 before and after lower-casing, where
NFC changes nothing, take a direct route; others have the library's own normaliser and
splitter do that. A file that asks for anything else raises.

Null and empty texts have no ids; their decoded text is empty. Each row is encoded
by itself: repeated rows and ids get equal results, so there are no ties. A text of any
length is encoded whole; words over LONG bytes are not cached. An empty table gives none.
An input column named like a result column is left out of the output.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import map_texts, texts

LONG = 48
CACHE_ENTRIES = 250_000
NONE = np.int32(2**31 - 1)
DIRECT = re.compile("[^\x00-ɏ]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {b: chr(b) for b in shown}
    names |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in names)}
    return [names[b] for b in range(256)]


def direct_pattern() -> re.Pattern:
    """The splitting pattern for code points under 0x250, in the standard library's syntax."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(0x250)):
        if (k := unicodedata.category(c)[0]) in kinds:
            kinds[k] += re.escape(c)
    white = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{white}{kinds['L']}{kinds['N']}]+")


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, steps = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if (
            model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model.get("ignore_merges")
            or model.get("byte_fallback") or model["continuing_subword_prefix"]
            or steps != ["NFC", "Replace", "Lowercase"] or split != PATTERN
            or spec["decoder"] or spec["post_processor"]
        ):
            raise ValueError(f"{path}: not a word-end BPE of the kind known here")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*vocab.values(), *self.special.values())
        self.tokens = [""] * size
        for word, i in (vocab | self.special).items():
            self.tokens[i] = word
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.final = np.array([vocab[c + "</w>"] for c in alphabet], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self._build_table(keys[order], order.astype(np.int32))
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(pairs)}
        self.splitter = direct_pattern()
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def _build_table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing, so that a look-up is a few gathers; probes go on until an empty slot."""
        self.bits = 18
        slots = 1 << self.bits
        self.keys = np.full(slots, -1, np.int64)
        self.ranks = np.full(slots, NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 1
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            placed = first[free[first]]
            self.keys[at[placed]], self.ranks[at[placed]] = keys[todo[placed]], ranks[todo[placed]]
            left = np.ones(len(todo), bool)
            left[placed] = False
            todo, at = todo[left], (at[left] + 1) & (slots - 1)
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where there is no merge."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        out = np.full(len(keys), NONE, np.int32)
        at, open_ = self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes + 1):
            here = self.keys[at]
            hit = here == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (here != -1)
            open_, at = open_[go], (at[go] + 1) & (len(self.keys) - 1)
            if not len(open_):
                break
        return out.reshape(left.shape)

    def merge_rows(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge words of one length, a row each: groups of (row numbers, their final ids)."""
        done, rows = [], np.arange(len(ids))
        ranks = self.look_up(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ids.shape[1] == 1:
                done.append((rows, ids))
                break
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            ended = best == NONE
            if ended.any():
                done.append((rows[ended], ids[ended]))
                go = ~ended
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not len(rows):
                    break
            n, line = ids.shape[1], np.arange(len(rows))
            ids[line, at] = self.made[best]
            place = np.arange(n - 1)[None, :]
            ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)  # the right part goes
            place = place[:, : n - 2]
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), 1)  # and the boundary with it
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.look_up(ids[some, at[some] - 1], ids[some, at[some]])
            some = np.flatnonzero(at < n - 2)
            ranks[some, at[some]] = self.look_up(ids[some, at[some]], ids[some, at[some] + 1])
        return done

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for a long word."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.made[r]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := self.rank.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[after[i]]))
            if (k := before[i]) >= 0 and (s := self.rank.get((ids[k], ids[i]))) is not None:
                heapq.heappush(heap, (s, k, ids[k], ids[i]))
        return [x for x, ok in zip(ids, alive) if ok]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian bytes."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        raw = {w: w.encode() for w in words}
        for w, b in raw.items():
            by_length.setdefault(len(b), []).append(w)
        for n, same in by_length.items():
            data = np.frombuffer(b"".join(raw[w] for w in same), np.uint8).reshape(-1, n)
            ids = self.inner[data]
            ids[:, -1] = self.final[data[:, -1]]
            if n > LONG:
                for w, row in zip(same, ids):
                    out[w] = np.array(self.merge_long(row.tolist()), "<u4").tobytes()
                continue
            for rows, merged in self.merge_rows(ids):
                width, flat = 4 * merged.shape[1], merged.astype("<u4").tobytes()
                for k, row in enumerate(rows.tolist()):
                    out[same[row]] = flat[k * width : (k + 1) * width]
        return out

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings."""
        low = text.lower()
        # Some letters under 0x250, such as U+0186, have lower-case forms beyond it.
        if text.isascii() or not (DIRECT.search(text) or DIRECT.search(low)):
            return self.splitter.findall(low)
        ready = self.library.normalizer.normalize_str(text)
        parts = self.library.pre_tokenizer.pre_tokenize_str(ready)
        return [bytes(self.byte_of[c] for c in p).decode() for p, _ in parts]

    def encode_texts(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        pieces: list[list] = []
        for text in batch:
            if self.cut and "<|" in text and self.cut.search(text):
                pieces.append([self.special[x] if x in self.special else self.words(x) for x in self.cut.split(text) if x])
            else:
                pieces.append([self.words(text)])
        cache = self.cache
        new = {w for parts in pieces for p in parts if not isinstance(p, int) for w in p if w not in cache}
        extra: dict[str, bytes] = {}
        if new:
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
                new = {w for parts in pieces for p in parts if not isinstance(p, int) for w in p}
            for w, ids in self.encode_words(list(new)).items():
                (cache if len(w) <= LONG else extra)[w] = ids
        get = cache.__getitem__ if not extra else lambda w: cache[w] if w in cache else extra[w]
        return [b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in parts) for parts in pieces]

    def decode(self, ids: bytes) -> str:
        """As the library decodes a file without a decoder: the tokens, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every row with its ids: array<int>."""

    def factory():
        bpe = load(vocabulary)

        def kernel(array):
            ids = bpe.encode_texts(texts(array))
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))]

        return kernel

    return map_texts(docs, text, [("ids", "array<int>")], factory, keep)


def encode_digests(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with n_tokens, the digest of the ids and that of the text decoded from them."""

    def factory():
        bpe = load(vocabulary)

        def kernel(array):
            ids = bpe.encode_texts(texts(array))
            return [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]

        return kernel

    out = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return map_texts(docs, text, out, factory, keep)
