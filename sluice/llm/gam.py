"""Quality classifier: a generalised additive model with pairwise interactions.

Measures of the whole text are binned. Cyclic boosting visits one measure after
another and adds a shallow tree over its bins to that measure's look-up table;
then, with those tables fixed, the most useful pairs of measures get tables of
their own from trees over both. A score is the logistic of an intercept and of
look-ups: a few vectorised additions per document.

The model is fitted on the driver on a bounded sample (TRAIN_PER_CLASS rows of each
label, whole texts of any length; labelled.py has the bound on their sum), weighted to the
labels' true shares. Every document is scored on its whole text, however long: measures are
counts of a pass over its bytes. Null and empty texts have all measures 0 and get a score
like any other. Without labels of both kinds every score is the share of label 1, or 0.5 if
there are none. Repeated rows get equal scores; a value on a bin's edge falls in the upper
bin. An empty table gives none. An input column named score is left out of the output.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import byte_texts, map_texts
from .labelled import remainder, training_rows

TRAIN_PER_CLASS = 3000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAVES = 150, 60, 0.1, 2.0, 3
THRESHOLD = 0.7
MODULUS, HELD_OUT = 4, 2

MEASURES = (
    "words", "word_bytes", "distinct", "adjacent", "upper", "symbols", "shouts", "bars", "digits", "stops",
    "lines", "repeated_lines", "wide", "longest", "longest_line",
)

#: Class of each byte: 0 other, 1 A-Z, 2 a-z, 3 digit, 4 white space, 5 line end, 6 symbol, 7 !, 8 |, 9 stop, 10 wide.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\x0b\x0c\r", b"\n", b"#*$%&<>@^~_=+{}[]\\", b"!", b"|", b".,;:?'\"()-"), 1
):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10


def measure(raw: bytes) -> list[float]:
    """The measures of one text."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    count = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11).tolist()
    solid = max(1, len(raw) - count[4] - count[5])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, count[1] + count[2])
    return [
        np.log1p(n), solid / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, count[1] / letters,
        count[6] / solid, count[7] / solid, count[8] / n, count[3] / solid, count[9] / solid,
        len(lines) / n, 1 - len(set(lines)) / len(lines), count[10] / solid, np.log1p(max(map(len, words))), np.log1p(max(map(len, lines))),
    ]


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of the tree that splits ordered bins into at most `leaves` runs."""
    cuts = [0, len(grad)]
    g, h = np.concatenate(([0], np.cumsum(grad))), np.concatenate(([0], np.cumsum(hess)))

    def score(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)

    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            mid = np.arange(a + 1, b)
            if len(mid):
                gain = score(a, mid) + score(mid, b) - score(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(mid[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Values over two binned measures: one split of the first, then one of the second on either side; and the gain."""
    best, out = -1.0, np.zeros_like(grad)
    for flip in (False, True):
        g, h = (grad.T, hess.T) if flip else (grad, hess)
        for k in range(1, g.shape[0]):
            value, gain = np.empty_like(g), 0.0
            for part in (slice(0, k), slice(k, None)):
                gs, hs = g[part].sum(0), h[part].sum(0)
                v = _tree(gs, hs, 2)
                value[part] = v[None, :]
                gain += float((2 * v * gs - v * v * (hs + RIDGE / len(v))).sum())
            if gain > best:
                best, out = gain, value.T if flip else value
    return out, best


class Gam:
    """Edges, tables and intercept."""

    def __init__(self, intercept: float = 0.0):
        self.intercept = intercept
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)])

    def _coarse(self, i: int, bins: np.ndarray) -> np.ndarray:
        return bins * PAIR_BINS // (len(self.edges[i]) + 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        if not self.tables or not len(x):
            return out
        bins = self.bins(x)
        for i, t in enumerate(self.tables):
            out += t[bins[:, i]]
        for i, j, t in self.pairs:
            out += t[self._coarse(i, bins[:, i]), self._coarse(j, bins[:, j])]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Gam:
        share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.intercept = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins, z = self.bins(x), np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for i, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-z))
                g = np.bincount(bins[:, i], weight * (y - p), len(table))
                h = np.bincount(bins[:, i], weight * p * (1 - p), len(table))
                step = RATE * _tree(g, h, LEAVES)
                table += step
                z += step[bins[:, i]]
        coarse = np.column_stack([self._coarse(i, bins[:, i]) for i in range(len(self.edges))])

        def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            p, cell = 1 / (1 + np.exp(-z)), coarse[:, i] * PAIR_BINS + coarse[:, j]
            g = np.bincount(cell, weight * (y - p), PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
            h = np.bincount(cell, weight * p * (1 - p), PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
            return g, h, cell

        gains = {(i, j): _pair_tree(*grid(i, j)[:2])[1] for i in range(len(self.edges)) for j in range(i)}
        chosen = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
        self.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in chosen]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                g, h, cell = grid(i, j)
                step = RATE * _pair_tree(g, h)[0]
                table += step
                z += step.ravel()[cell]
        return self


def train(documents: DataFrame, labels: DataFrame, target: str = "quality") -> Gam:
    """The model of documents whose id's remainder is not held out."""
    rows: pd.DataFrame = training_rows(documents, labels, target, MODULUS, HELD_OUT, TRAIN_PER_CLASS)
    known = labels.filter(remainder(F.col("doc_id"), MODULUS) != HELD_OUT).groupBy(target).count()
    totals = {r[0]: r[1] for r in known.collect() if r[0] in (0, 1)}
    y = rows["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        n = sum(totals.values())
        share = np.clip(totals.get(1, 0) / n, 1e-3, 1 - 1e-3) if n else 0.5
        return Gam(float(np.log(share / (1 - share))))
    x = np.array([measure(t.encode()) for t in rows["text"]])
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    return Gam().fit(x, y, weight * len(y) / weight.sum())


def score(docs: DataFrame, model: Gam, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every row with score, the chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB, whatever the input

    def factory():
        model = shared.value

        def kernel(array):
            x = np.array([measure(raw) for raw in byte_texts(array)]).reshape(-1, len(MEASURES))
            return [pa.array(1 / (1 + np.exp(-model.logits(x))))]

        return kernel

    return map_texts(docs, text, [("score", "double")], factory, keep)
