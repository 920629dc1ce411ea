"""Line differences between consecutive versions of many texts.

Each version meets the one before it by a window over its key, and workers compare the two: a greedy search for a
shortest edit script over the lines that both have (Myers). Lines that only one side has are never kept, so they are set
aside first; common lines at both ends need no search. A patch is a list of hunks on the older version: from line `at`,
`cut` lines go and the lines `put` come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HUNKS = "array<struct<at:int,cut:int,put:array<string>>>"
Hunk = tuple[int, int, list[str]]


def lines_of(text: str | None) -> list[str]:
    """Lines with their line feeds, so that joining them gives the text again; none of null or empty text."""
    return (text or "").splitlines(keepends=True) if "\n" in (text or "") else [text] if text else []


def _matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by the furthest reaching paths of each number of edits."""
    n, m = len(a), len(b)
    ends, trail = {1: 0}, []
    for edits in range(n + m + 1):
        trail.append(dict(ends))
        for k in range(-edits, edits + 1, 2):
            down = k == -edits or k != edits and ends.get(k - 1, -1) < ends.get(k + 1, -1)
            x = ends.get(k + 1, 0) if down else ends.get(k - 1, 0) + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            ends[k] = x
            if x >= n and x - k >= m:
                return _traced(trail, n, m)
    return []


def _traced(trail: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    """The matches on the way back from the end."""
    out = []
    for edits in range(len(trail) - 1, -1, -1):
        ends, k = trail[edits], x - y
        if edits == 0:
            px, py = 0, 0
        else:
            down = k == -edits or k != edits and ends.get(k - 1, -1) < ends.get(k + 1, -1)
            before = k + 1 if down else k - 1
            px = ends[before]
            py = px - before
        while x > px and y > py and (edits == 0 or x - y == k) and not (edits and (x, y) == ((px, py + 1) if down else (px + 1, py))):
            x, y = x - 1, y - 1
            out.append((x, y))
        if edits:
            x, y = px, py
    return out[::-1]


def edit_script(old: list[str], new: list[str]) -> list[Hunk]:
    """Hunks of a shortest edit script from old to new."""
    top = 0
    while top < min(len(old), len(new)) and old[top] == new[top]:
        top += 1
    end = 0
    while end < min(len(old), len(new)) - top and old[-1 - end] == new[-1 - end]:
        end += 1
    a, b = old[top : len(old) - end], new[top : len(new) - end]
    both = set(a) & set(b)
    ids = {line: i for i, line in enumerate(both)}
    at_a, at_b = [i for i, x in enumerate(a) if x in both], [i for i, x in enumerate(b) if x in both]
    found = _matches([ids[a[i]] for i in at_a], [ids[b[i]] for i in at_b]) if both else []
    hunks, i, j = [], 0, 0
    for x, y in [*((at_a[p], at_b[q]) for p, q in found), (len(a), len(b))]:
        if x > i or y > j:
            hunks.append((top + i, x - i, b[j:y]))
        i, j = x + 1, y + 1
    return hunks


def patched(old: list[str], hunks: list[Hunk]) -> list[str]:
    """The newer version."""
    out, at = [], 0
    for start, cut, put in hunks:
        out += old[at:start]
        out += put
        at = start + cut
    return out + old[at:]


def version_diffs(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, order, n_old, n_new, deleted, inserted (lines), hunks and restored of each version but the first of its key.

    restored: whether the older version with its patch is the newer one. Null texts have no lines. Versions of equal order
    follow one another by their texts. Keys that are null are one key.
    """
    before = F.lag("_new").over(Window.partitionBy("_key").orderBy("_order", "_new"))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("_order", "_new"))
    named = rows.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(text).cast("string").alias("_new"))
    pairs = named.withColumns({"_old": before, "_n": first}).filter("_n > 1").drop("_n")
    made = [("n_old", T.LongType()), ("n_new", T.LongType()), ("deleted", T.LongType()), ("inserted", T.LongType()), ("hunks", T._parse_datatype_string(HUNKS)), ("restored", T.BooleanType())]
    schema = T.StructType([T.StructField(key, pairs.schema["_key"].dataType), T.StructField(order, pairs.schema["_order"].dataType)] + [T.StructField(n, k) for n, k in made])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for new, old in zip(frame["_new"], frame["_old"]):
                a, b = (lines_of(x) for x in (old, new))
                hunks = edit_script(a, b)
                out.append((len(a), len(b), sum(h[1] for h in hunks), sum(len(h[2]) for h in hunks), [{"at": s, "cut": c, "put": p} for s, c, p in hunks], patched(a, hunks) == b))
            yield pd.concat([frame[["_key", "_order"]].set_axis([key, order], axis=1).reset_index(drop=True), pd.DataFrame(out, columns=[n for n, _ in made])], axis=1)

    return pairs.mapInPandas(run, schema)
