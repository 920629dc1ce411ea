"""Token counts by a two-tier lookup on the map side.

The piece model starts every text with a word mark, turns spaces into word marks
and has no piece with a mark after another character. Merges therefore never
cross the place before a run of marks, and a text's pieces are those of its
pre-tokens: a run of spaces and what follows it up to the next space. That is
checked when the model is loaded; another model raises.

Tier one is a table of frequent pre-tokens and their lengths, broadcast as one
packed blob; it is built from the first rows of the table and only decides speed.
Tier two encodes what the table misses and keeps it in a cache of the Python
worker. No pre-token is ever shuffled.

Null and empty texts have no tokens. A text of any length is counted whole. Each row counts
by itself: repeated rows and repeated ids get equal counts, so there are no ties. An empty
table gives none. An input column named like a result column is left out of the output.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import byte_texts, col, map_texts

SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
TABLE_ENTRIES = 32_768
CACHE_ENTRIES = 400_000
CACHED_CHARS = 48

MARK = "▁"
RUNS = re.compile(" *[^ ]+| +")

_models: dict[str, object] = {}
_tables: dict[int, dict[str, int]] = {}
_cache: dict[str, dict[str, int]] = {}


def load_model(path: str):
    """The processor, once per process; raises if pre-tokens would not be independent."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK)]
        if crossing or model.encode("a", out_type=str)[0][:1] != MARK or model.encode("  a  b ") == model.encode("a b") or model.is_unknown(model.piece_to_id(MARK)):
            raise ValueError(f"{path}: pieces span word marks, or spaces are normalised away")
        _models[path] = model
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, each without its first space."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    return [x[1:] for x in RUNS.findall(" " + text)]


def piece_counts(model, words: list[str]) -> list[int]:
    """Pieces of each pre-token; the empty one, a single space at a text's end, is a lone word mark."""
    return [len(ids) or 1 for ids in model.encode(words, num_threads=1)]


def pack_table(lengths: dict[str, int]) -> bytes:
    """Lengths (a byte each) of pre-tokens without line ends, and those pre-tokens."""
    keys = [k for k, n in lengths.items() if n < 256 and "\n" not in k]
    head = np.array([len(keys)], "<u4").tobytes() + bytes(lengths[k] for k in keys)
    return zlib.compress(head + "\n".join(keys).encode())


def unpack_table(blob: bytes) -> dict[str, int]:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    return dict(zip(raw[4 + n :].decode().split("\n"), raw[4 : 4 + n], strict=True)) if n else {}


def frequent_table(docs: DataFrame, text: str, path: str) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of the first SAMPLE_ROWS rows of at most SAMPLE_CHARS characters.

    Spark takes these from the first files and stops there: the table is not scanned for them.
    """
    said = col(text).cast("string").alias("t")
    rows = docs.select(said).filter(F.length("t") <= SAMPLE_CHARS).limit(SAMPLE_ROWS).collect()
    seen: Counter[str] = Counter()
    for (t,) in rows:
        seen.update(pre_tokens(t))
    words = [w for w, n in seen.most_common(TABLE_ENTRIES) if n > 1 and len(w) <= CACHED_CHARS]
    return dict(zip(words, piece_counts(load_model(path), words), strict=True)) if words else {}


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every row with n_bytes and n_tokens (both long)."""
    shared = docs.sparkSession.sparkContext.broadcast(pack_table(frequent_table(docs, text, model_path)))

    def factory():
        model = load_model(model_path)
        key = hash(shared.value)
        if key not in _tables:
            _tables.clear()
            _tables[key] = unpack_table(shared.value)
        tier1 = _tables[key]
        tier2 = _cache.setdefault(model_path, {})

        def kernel(array):
            raws = byte_texts(array)
            split = [pre_tokens(x.decode()) for x in raws]
            new: set[str] = set()
            rest: list[list[str]] = []
            counts = []
            for words in split:
                got = list(map(tier1.get, words))
                if None in got:
                    missed = [w for w, n in zip(words, got) if n is None]
                    counts.append(sum(filter(None, got)))
                    new.update(w for w in missed if w not in tier2)
                    rest.append(missed)
                else:
                    counts.append(sum(got))
                    rest.append([])
            fresh = list(new)
            if len(tier2) + len(fresh) > CACHE_ENTRIES:
                known = {w: tier2[w] for missed in rest for w in missed if w in tier2}
                tier2.clear()
                tier2.update(known)
            big: dict[str, int] = {}
            if fresh:
                for w, n in zip(fresh, piece_counts(model, fresh)):
                    (tier2 if len(w) <= CACHED_CHARS else big)[w] = n
            for i, missed in enumerate(rest):
                if missed:
                    counts[i] += sum(tier2[w] if w in tier2 else big[w] for w in missed)
            return [pa.array([len(x) for x in raws], pa.int64()), pa.array(counts, pa.int64())]

        return kernel

    return map_texts(docs, text, [("n_bytes", "long"), ("n_tokens", "long")], factory, keep)
