"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Two levels. A bidirectional recurrent layer reads the characters of a word (its letters
and digits, as bytes; other ASCII characters part words and are not read) and attention
pools them; with the word's own embedding, if it is in the vocabulary
of the training sample, that is the word's input. A second such layer reads the
words of a window and attention pools them into a logit. All windows of WINDOW
words, one every STRIDE words and so overlapping, are scored, down to the end of the
text, so that any passage of up to WINDOW - STRIDE + 1 words lies whole in one; the
document's logit is the largest, mapped to a chance by a logistic line over it and the
number of windows, fitted on the training sample. Numbers beyond the sample's largest
count as that.

Training runs on the driver on a bounded sample (TRAIN_PER_CLASS rows of each label, whole
texts of any length; labelled.py has the bound on their sum), weighted to the labels' true
shares for the line. Weights are fitted first window by window, then document by document,
and last with the worst windows of all clean texts as documents of their own. A text of
over WHOLE words takes part in a step by a span of SPAN words: all its windows are scored
before each epoch, and the span is the one about the largest logit. In the first epoch such
texts stand back, unless a label has no others; then the span is any.
A word's projections are worked out once per Python worker and kept in a bounded
table; windows of many documents run through the recurrence together.

Null and empty texts have one empty window and get a score like any other. Words of
over WORD_BYTES bytes are read as several. Without labels of both kinds every score
is the share of label 1, or 0 if there are none. Repeated rows get equal scores; of equal
largest windows the first counts. An empty table gives none. An input column named score is
left out of the output.
"""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts, texts
from .labelled import remainder, training_rows

TRAIN_PER_CLASS = 1000
WINDOW, STRIDE, WORD_BYTES = 40, 20, 12
WHOLE, SPAN = 11 * WINDOW, 5 * WINDOW
CHAR_DIM, CHAR_HIDDEN, WORD_DIM, HIDDEN, ATTENTION = 8, 10, 8, 8, 8
VOCABULARY = 4096
EPOCHS, BATCH, RATE = 5, 24, 8e-3
TABLE_WORDS = 150_000
CHUNK = 1024
THRESHOLD = 0.5
MODULUS, HELD_OUT = 5, 0

#: ASCII letters, digits and bytes of multi-byte characters stay; the rest is a space.
_LETTERS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    words = text.lower().encode().translate(_LETTERS).split()
    if any(len(w) > WORD_BYTES for w in words):
        return [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return words


def windows(n: int, stride: int = STRIDE) -> list[int]:
    """Starts of the windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, stride), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _active(mask: np.ndarray) -> list:
    """For each step of a mask (t, batch) the rows that it goes on for: a slice where these are the first ones."""
    count = mask.sum(1).tolist()
    return [slice(0, k) if mask[t, :k].all() else np.flatnonzero(mask[t]) for t, k in enumerate(count)]


def _gru(xs, u: np.ndarray, rows: list, keep: list) -> list[np.ndarray]:
    """Hidden states of a gated recurrent layer over input projections xs (t, batch, 3h); rows: see _active."""
    n = u.shape[0]
    h = np.zeros((xs.shape[1], n), np.float32)
    out = []
    for on, x in zip(rows, xs):
        here, x = h[on], x[on]
        hu = here @ u
        gates = _sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
        keep.append((here, z, r, c, hu[:, 2 * n :]))
        h = h.copy()
        h[on] = c + z * (here - c)
        out.append(h)
    return out


def _halved(w: np.ndarray) -> np.ndarray:
    """Weights for _scan: those of the gates halved, as a logistic is (1 + tanh(x / 2)) / 2."""
    w = w.copy()
    w[..., : 2 * w.shape[-1] // 3] *= 0.5
    return w


def _scan(table: np.ndarray, idx: np.ndarray, u: np.ndarray, mask, out: np.ndarray) -> None:
    """The same states without a way back, for rows of a table of halved projections; out (t, batch, h)."""
    n, batch = u.shape[0], idx.shape[1]
    ug = np.ascontiguousarray(u[:, : 2 * n]) * np.float32(0.5)
    uc = np.ascontiguousarray(u[:, 2 * n :]) * np.float32(0.5)
    h = np.zeros((batch, n), np.float32)
    x, g = np.empty((batch, 3 * n), np.float32), np.empty((batch, 2 * n), np.float32)
    c, z = np.empty((batch, n), np.float32), np.empty((batch, n), np.float32)
    for t in range(len(idx)):
        np.take(table, idx[t], axis=0, out=x, mode="clip")
        np.matmul(h, ug, out=g)
        g += x[:, : 2 * n]
        np.tanh(g, out=g)
        g += 1
        np.matmul(h, uc, out=c)
        c *= g[:, n:]
        c += x[:, 2 * n :]
        np.tanh(c, out=c)
        np.subtract(h, c, out=z)
        z *= g[:, :n]
        z *= 0.5
        z += c
        if mask is not None:
            np.copyto(z, h, where=~mask[t][:, None])
        out[t] = z
        h, z = out[t], z


def _gru_back(grad: np.ndarray, kept: list, u: np.ndarray, rows: list):
    """Gradients of the input projections (t, batch, 3h) and of u, from those of the states (t, batch, h)."""
    n, du = u.shape[0], np.zeros_like(u)
    dx = np.zeros((*grad.shape[:2], 3 * n), np.float32)
    carry = np.zeros(grad.shape[1:], np.float32)
    for t in range(len(kept) - 1, -1, -1):
        (h, z, r, c, hn), on = kept[t], rows[t]
        carry = grad[t] + carry
        d, left = carry[on], 1 - z
        dhu = np.empty((len(d), 3 * n), np.float32)
        dz, dr, dc = dhu[:, :n], dhu[:, n : 2 * n], dhu[:, 2 * n :]
        np.multiply(d, left, out=dc)
        dc *= 1 - c * c
        np.multiply(d, h - c, out=dz)
        dz *= z * left
        np.multiply(dc, hn, out=dr)
        dr *= r * (1 - r)
        dx[t][on] = dhu
        dc *= r
        du += h.T @ dhu
        carry[on] = d * z + dhu @ u.T
    return dx, du


class Layer:
    """Bidirectional recurrence with attention pooling; parameters live in a dict under a prefix."""

    def __init__(self, prefix: str, inputs: int, hidden: int):
        self.p, self.inputs, self.hidden = prefix, inputs, hidden

    def start(self, rng) -> dict[str, np.ndarray]:
        h, p = self.hidden, self.p
        out = {}
        for d in "fb":
            out[f"{p}w{d}"] = rng.normal(0, 1 / np.sqrt(self.inputs), (self.inputs, 3 * h))
            out[f"{p}u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
            out[f"{p}o{d}"] = np.zeros(3 * h)
        out[f"{p}a"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, ATTENTION))
        out[f"{p}v"] = rng.normal(0, 1, ATTENTION)
        return {k: v.astype(np.float32) for k, v in out.items()}

    def pool(self, q, states: np.ndarray, mask: np.ndarray):
        """states (t, batch, 2h), mask (t, batch): pooled states and what the way back needs."""
        s = states.reshape(-1, states.shape[2]) @ q[f"{self.p}a"]
        np.tanh(s, out=s)
        e = np.where(mask, (s @ q[f"{self.p}v"]).reshape(mask.shape), np.float32(-1e9))
        weight = np.exp(e - e.max(0)) * mask
        weight /= np.maximum(weight.sum(0), np.float32(1e-9))
        return np.einsum("tb,tbh->bh", weight, states), (s.reshape(*mask.shape, -1), weight)

    def run(self, q, tables, idx: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Pooled states over rows idx (t, batch) of two tables of halved projections."""
        h, even = self.hidden, bool(mask.all())
        states = np.empty((*idx.shape, 2 * h), np.float32)
        _scan(tables[0], idx, q[f"{self.p}uf"], None if even else mask, states[:, :, :h])
        _scan(tables[1], idx[::-1], q[f"{self.p}ub"], None if even else mask[::-1], states[::-1, :, h:])
        return self.pool(q, states, mask)[0]

    def forward(self, q, fx: np.ndarray, bx: np.ndarray, mask: np.ndarray):
        """fx, bx: input projections (t, batch, 3h)."""
        kf: list = []
        kb: list = []
        rows = _active(mask)
        f = _gru(fx, q[f"{self.p}uf"], rows, kf)
        b = _gru(bx[::-1], q[f"{self.p}ub"], rows[::-1], kb)
        states = np.concatenate([np.stack(f), np.stack(b[::-1])], 2)
        pooled, more = self.pool(q, states, mask)
        return pooled, (states, rows, kf, kb, *more)

    def backward(self, q, grad: np.ndarray, cache, into: dict):
        """Adds gradients to `into`; returns those of fx and bx."""
        states, rows, kf, kb, s, weight = cache
        h, p = self.hidden, self.p
        de = (grad[None] * states).sum(2)
        de = weight * (de - (weight * de).sum(0))
        ds = de[:, :, None] * q[f"{p}v"] * (1 - s * s)
        flat = states.reshape(-1, 2 * h)
        into[f"{p}v"] += (de[:, :, None] * s).sum((0, 1))
        into[f"{p}a"] += flat.T @ ds.reshape(-1, ATTENTION)
        dstates = weight[:, :, None] * grad[None] + ds @ q[f"{p}a"].T
        fx, du = _gru_back(dstates[:, :, :h], kf, q[f"{p}uf"], rows)
        into[f"{p}uf"] += du
        bx, du = _gru_back(dstates[::-1, :, h:], kb, q[f"{p}ub"], rows[::-1])
        into[f"{p}ub"] += du
        return fx, bx[::-1]


CHARS = Layer("c", CHAR_DIM, CHAR_HIDDEN)
WORDS = Layer("w", WORD_DIM + 2 * CHAR_HIDDEN, HIDDEN)


def _char_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words, time first, and which places hold one."""
    size = max(map(len, words))
    ids = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(-1, size).T
    length = np.fromiter(map(len, words), np.int64, len(words))
    return ids, np.arange(size)[:, None] < length[None, :]


class Network:
    """Parameters, vocabulary and the final line."""

    def __init__(self, vocabulary: list[bytes], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.q = CHARS.start(rng) | WORDS.start(rng)
        self.q["ec"] = rng.normal(0, 1, (256, CHAR_DIM)).astype(np.float32)
        self.q["ew"] = rng.normal(0, 0.5, (len(vocabulary) + 1, WORD_DIM)).astype(np.float32)
        self.q["ew"][0] = 0
        self.q["d"] = rng.normal(0, 1 / np.sqrt(2 * HIDDEN), 2 * HIDDEN).astype(np.float32)
        self.q["k"] = np.zeros(1, np.float32)
        self.line, self.most = np.array([1.0, 0.0, 0.0]), np.inf

    def _char_projections(self) -> tuple[np.ndarray, np.ndarray]:
        q = self.q
        return q["ec"] @ q["cwf"] + q["cof"], q["ec"] @ q["cwb"] + q["cob"]

    def project(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words, 3h) twice: the halved input projections of words, by direction."""
        q = self.q
        out = np.empty((2, len(words), 3 * HIDDEN), np.float32)
        chars = [_halved(p) for p in self._char_projections()]
        wf, wb = (_halved(q[f"ww{d}"]) for d in "fb")
        of, ob = (_halved(q[f"wo{d}"]) for d in "fb")
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), CHUNK):
            part = order[at : at + CHUNK]
            ids, mask = _char_rows([words[i] for i in part])
            pooled = CHARS.run(q, chars, ids.astype(np.intp), mask)
            x = np.concatenate([q["ew"][[self.index.get(words[i], 0) for i in part]], pooled], 1)
            out[0, part], out[1, part] = x @ wf + of, x @ wb + ob
        return out[0], out[1]

    def window_logits(self, rows: np.ndarray, lengths: np.ndarray, tables) -> np.ndarray:
        """rows (windows, t): places in the tables of the words; lengths: words that count."""
        out = np.empty(len(rows), np.float32)
        order = np.argsort(-lengths, kind="stable")  # full windows together need no mask
        for at in range(0, len(rows), CHUNK):
            part = order[at : at + CHUNK]
            most = max(1, int(lengths[part[0]]))
            idx = np.ascontiguousarray(rows[part, :most].T)
            mask = np.arange(most)[:, None] < lengths[part][None, :]
            out[part] = WORDS.run(self.q, tables, idx, mask) @ self.q["d"] + self.q["k"]
        return out

    def chances(self, logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Chance of label 1 from the largest logit of a document and its number of windows."""
        return 1 / (1 + np.exp(-np.clip(_line_inputs(logits, np.minimum(counts, self.most)) @ self.line, -40, 40)))


def _line_inputs(logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.column_stack([logits.astype(np.float64), np.log(counts), np.ones(len(logits))])


def _layout(sizes: list[int], starts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of word places, lengths, and first window of each document, for words laid end to end."""
    base = np.cumsum([0, *sizes])
    per = np.fromiter(map(len, starts), np.int64, len(starts))
    begin = np.concatenate([np.asarray(s, np.int64) for s in starts]) + np.repeat(base[:-1], per)
    length = np.minimum(WINDOW, np.repeat(base[1:], per) - begin)
    rows = np.minimum(begin[:, None] + np.arange(WINDOW), max(0, int(base[-1]) - 1))
    return rows, length, np.cumsum(per) - per


def _step(net: Network, docs: list[list[bytes]], y: np.ndarray, rng, by_window: bool) -> tuple[dict, float]:
    """Gradients over one batch of documents; by_window: each window is to have its document's label."""
    q = net.q
    grads = {k: np.zeros_like(v) for k, v in q.items()}
    vocabulary = sorted({w for d in docs for w in d}, key=lambda w: (-len(w), w)) or [b" "]  # so that the rows that go on are the first ones
    place = {w: i for i, w in enumerate(vocabulary)}
    flat = np.array([place[w] for d in docs for w in d] or [0], np.int64)
    rows, length, first = _layout([len(d) for d in docs], [windows(len(d), WINDOW) for d in docs])
    idx = flat[rows].T
    mask = np.arange(WINDOW)[:, None] < length[None, :]

    ids, cmask = _char_rows(vocabulary)
    pf, pb = net._char_projections()
    at = ids.astype(np.intp)
    chars, ccache = CHARS.forward(q, np.take(pf, at, axis=0), np.take(pb, at, axis=0), cmask)
    number = np.array([net.index.get(w, 0) for w in vocabulary])
    number[rng.random(len(number)) < 0.3] = 0  # now and then a known word is read by its characters alone
    x = np.concatenate([q["ew"][number], chars], 1)
    f, b = x @ q["wwf"] + q["wof"], x @ q["wwb"] + q["wob"]
    pooled, wcache = WORDS.forward(q, f[idx], b[idx], mask)
    logits = pooled @ q["d"] + q["k"]

    # A document's logit: the mean of its windows' logits, weighted by their exponentials.
    per = np.diff(np.append(first, len(logits)))
    top = np.repeat(np.maximum.reduceat(logits, first), per)
    e = np.exp(logits - top)
    share = e / np.repeat(np.add.reduceat(e, first), per)
    doc = np.add.reduceat(share * logits, first)
    p = _sigmoid(doc)
    loss = float(-np.mean(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-7, 1))))
    dlogit = np.repeat((p - y) / len(y), per) * share * (1 + logits - np.repeat(doc, per))
    if by_window:
        dlogit = (_sigmoid(logits) - np.repeat(y, per)) / len(logits)
    dlogit = dlogit.astype(np.float32)

    grads["d"] += pooled.T @ dlogit
    grads["k"] += dlogit.sum()
    dfx, dbx = WORDS.backward(q, dlogit[:, None] * q["d"][None, :], wcache, grads)
    dx = np.zeros_like(x)
    flat_idx = idx.ravel()
    order = np.argsort(flat_idx, kind="stable")
    at = np.flatnonzero(np.diff(flat_idx[order], prepend=-1))
    there = flat_idx[order][at]
    for name, d, w in (("f", dfx, "wwf"), ("b", dbx, "wwb")):
        g = np.zeros((len(vocabulary), 3 * HIDDEN), np.float32)
        g[there] = np.add.reduceat(d.reshape(-1, 3 * HIDDEN)[order], at, 0)
        grads[w] += x.T @ g
        grads[f"wo{name}"] += g.sum(0)
        dx += g @ q[w].T
    np.add.at(grads["ew"], number, dx[:, :WORD_DIM])
    grads["ew"][0] = 0
    dcf, dcb = CHARS.backward(q, dx[:, WORD_DIM:], ccache, grads)
    held = ids[cmask]  # places beyond a word's end have no gradient
    for name, d, table in (("f", dcf, "cwf"), ("b", dcb, "cwb")):
        by_unit = np.ascontiguousarray(d[cmask].T, np.float64)
        g = np.stack([np.bincount(held, row, 256) for row in by_unit], 1).astype(np.float32)
        grads[table] += q["ec"].T @ g
        grads[f"co{name}"] += g.sum(0)
        grads["ec"] += g @ q[table].T
    return grads, loss


def _document_logits(net: Network, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Largest logit of each document, its number of windows, and where that window starts."""
    vocabulary = sorted({w for d in docs for w in d}) or [b" "]
    return _largest(net, docs, {w: i for i, w in enumerate(vocabulary)}, net.project(vocabulary))


def _largest(net: Network, docs: list[list[bytes]], place: dict[bytes, int], tables) -> tuple[np.ndarray, np.ndarray, list[int]]:
    flat = np.fromiter((place[w] for d in docs for w in d), np.int64)
    if not len(flat):
        flat = np.zeros(1, np.int64)
    starts = [windows(len(d)) for d in docs]
    rows, length, first = _layout([len(d) for d in docs], starts)
    logits = net.window_logits(flat[rows], length, tables)
    counts = np.fromiter(map(len, starts), np.int64, len(starts))
    at = [s[int(logits[k : k + len(s)].argmax())] for k, s in zip(first.tolist(), starts)]
    return np.maximum.reduceat(logits, first), counts, at


@contextmanager
def _one_blas_thread():
    """The products here are small and lose by threads: meanwhile the OpenBLAS that numpy brings along has one."""
    held = None
    for path in (Path(np.__file__).parents[1] / "numpy.libs").glob("*openblas*"):
        lib = ctypes.CDLL(str(path))
        put, get = (getattr(lib, f"scipy_openblas_{k}_num_threads64_", None) for k in ("set", "get"))
        if put and get:
            held = put, get()
            put(1)
    try:
        yield
    finally:
        if held:
            held[0](held[1])


def fit(texts_: list[str], y: np.ndarray, totals: dict[int, int], epochs: int = EPOCHS, log=None) -> Network:
    """A network for texts with labels 0 and 1; totals: how many rows of each label there are in all."""
    every = [words_of(t) for t in texts_]
    short = [i for i, d in enumerate(every) if len(d) <= WHOLE]
    seen: dict[bytes, int] = {}
    for d in every:
        for w in set(d):
            seen[w] = seen.get(w, 0) + 1
    vocabulary = sorted((w for w, n in seen.items() if n > 2), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net, rng = Network(vocabulary), np.random.default_rng(5)
    m = {k: np.zeros_like(v) for k, v in net.q.items()}
    s = {k: np.zeros_like(v) for k, v in net.q.items()}
    count, half = 0, BATCH // 2
    there = set(y[short].tolist())
    long = [i for i, d in enumerate(every) if len(d) > WHOLE]
    for epoch in range(epochs if len(set(y.tolist())) == 2 else 0):
        last = epoch == epochs - 1
        docs, goal = [every[i] for i in short], y[short]
        longer = long if epoch else [i for i in long if y[i] not in there]
        if longer:
            spans = [every[i] for i in longer]
            at = _document_logits(net, spans)[2] if epoch else [int(rng.integers(len(d) or 1)) for d in spans]
            docs = docs + [d[max(0, k - SPAN // 2) :][:SPAN] for d, k in zip(spans, at)]
            goal = np.concatenate([goal, y[longer]])
        clean = [d for d, label in zip(every, y) if label == 0 and d]
        if epoch:  # texts of a few words are rare in the sample
            at = rng.integers(0, [len(d) for d in clean])
            docs = docs + [d[k : k + int(n)] for d, k, n in zip(clean, at.tolist(), rng.integers(1, 12, len(clean)))][::3]
        if epoch >= epochs - 2:
            _, _, at = _document_logits(net, clean)
            docs = docs + [d[k : k + WINDOW] for d, k in zip(clean, at)]
        goal = np.concatenate([goal, np.zeros(len(docs) - len(goal), goal.dtype)])
        ones, zeros = np.flatnonzero(goal == 1), np.flatnonzero(goal == 0)
        rounds = max(1, max(len(ones), len(zeros)) // half)
        a = np.resize(rng.permutation(ones), rounds * half)
        b = np.resize(rng.permutation(zeros), rounds * half)
        losses = []
        for k in range(rounds):
            batch = np.concatenate([a[k * half : (k + 1) * half], b[k * half : (k + 1) * half]])
            grads, loss = _step(net, [docs[i] for i in batch], goal[batch], rng, epoch == 0)
            losses.append(loss)
            count += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * min(1.0, count / 10) * (0.3 if last else 1.0)
            for name, g in grads.items():
                g *= min(1.0, 2.0 / (norm + 1e-9))
                m[name] += 0.1 * (g - m[name])
                s[name] += 0.01 * (g * g - s[name])
                net.q[name] -= rate * (m[name] / (1 - 0.9**count)) / (np.sqrt(s[name] / (1 - 0.99**count)) + 1e-7)
        if log:
            log(epoch, float(np.mean(losses)))
    logits, counts, _ = _document_logits(net, every)
    _fit_line(net, logits, counts, y, totals)
    return net


def _fit_line(net: Network, logits: np.ndarray, counts: np.ndarray, y: np.ndarray, totals: dict[int, int]) -> None:
    """The line of `chances`, at the labels' true shares, by Newton steps with a small ridge."""
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    weight = weight / weight.mean()
    x, prior, ridge = _line_inputs(logits, counts), np.array([1.0, 0.0, 0.0]), 0.5
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (y - p)) - ridge * (w - prior)
        w = w + np.clip(np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), g), -2, 2)
    net.line, net.most = w, counts.max()


class Constant:
    """Stands in where there is nothing to learn from."""

    def __init__(self, chance: float):
        self.chance = chance


def train(documents: DataFrame, labels: DataFrame, target: str = "toxic") -> Network | Constant:
    """The network of documents whose id's remainder is not held out."""
    rows = training_rows(documents, labels, target, MODULUS, HELD_OUT, TRAIN_PER_CLASS)
    known = labels.filter(remainder(F.col("doc_id"), MODULUS) != HELD_OUT).groupBy(target).count()
    totals = {r[0]: r[1] for r in known.collect() if r[0] in (0, 1)}
    y = rows["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        n = sum(totals.values())
        return Constant(totals.get(1, 0) / n if n else 0.0)
    with _one_blas_thread():
        return fit(rows["text"].tolist(), y, totals)


_tables: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}


def score(docs: DataFrame, model: Network | Constant, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every row with score, the chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and the layers' sizes
    key = uuid.uuid4().hex

    def factory():
        net = shared.value
        if key not in _tables:
            _tables.clear()
            _tables[key] = ({}, [np.empty((1024, 3 * HIDDEN), np.float32) for _ in "fb"])

        def kernel(array):
            said = texts(array)
            if isinstance(net, Constant):
                return [pa.array([float(net.chance)] * len(said), pa.float64())]
            docs_ = [words_of(t) for t in said]
            place, tables = _tables[key]
            known = {w for d in docs_ for w in d}
            new = list(known - place.keys())
            if len(place) + len(new) > TABLE_WORDS:
                place.clear()
                new = list(known)
            if new:
                at, need = len(place), len(place) + len(new)
                if need > len(tables[0]):
                    tables = [np.concatenate([t[:at], np.empty((max(need, 2 * len(t)) - at, t.shape[1]), np.float32)]) for t in tables]
                for t, p in zip(tables, net.project(new)):
                    t[at:need] = p
                place.update(zip(new, range(at, need)))
                _tables[key] = (place, tables)
            logits, counts, _ = _largest(net, docs_, place, tables)
            return [pa.array(net.chances(logits, counts))]

        return kernel

    return map_texts(docs, text, [("score", "double")], factory, keep)
