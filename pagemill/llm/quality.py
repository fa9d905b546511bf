"""Quality classifier (operator 6): random-indexing word vectors, pooled, a two-layer network, a temperature.

A word's hash names one of ``ROWS`` rows. A row's index vector is sparse and ternary, drawn from the row's number; its word vector
is that plus the sum of its neighbours' index vectors in the training texts, both of unit length. A document's vector is the mean of
its words' vectors, with measures of its form. The network (tanh, then logistic) is trained by Adam; the temperature that
divides its output is fitted on a fifth of the training rows that the network hasn't seen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import SPACE, mix, spans_hash, text_slices, words
from .labelled import scored, training_rows

ROWS, DIM, NEAR = 1 << 16, 48, 2
#: Rows that training takes at most, and the score from which a document counts as good.
TRAINING_ROWS, THRESHOLD = 6000, 0.3
_CHUNK = 1 << 16


def index_vectors(rows: int = ROWS, dim: int = DIM, ones: int = 6) -> np.ndarray:
    out = np.zeros((rows, dim), np.float32)
    for k in range(ones):
        h = mix(np.arange(rows, dtype=np.uint64) * np.uint64(ones) + np.uint64(k + 1))
        out[np.arange(rows), (h >> np.uint64(1)) % np.uint64(dim)] += np.where(h & np.uint64(1), 1, -1)
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def word_rows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    begin, end, row = words(data, at)
    h = spans_hash(data, begin, end)
    return begin, end, row, h, (h >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)


_UPPER, _DIGIT, _SIGN, _LINE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = _LINE[10] = True
_SIGN[33:127] = True
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = False


def _counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of each text's flags are set."""
    some = np.flatnonzero(at[:-1] < at[1:])
    out = np.zeros(len(at) - 1)
    if len(some):
        out[some] = np.add.reduceat(flags, at[some], dtype=np.int64)
    return out


def form(data: np.ndarray, at: np.ndarray, begin, end, row, h) -> np.ndarray:
    """Measures of each text's form: lengths, shares of kinds of bytes and of words that repeat."""
    n = len(at) - 1
    size = np.diff(at)
    count = np.bincount(row, minlength=n)
    share = [_counts(kind[data], at) / np.maximum(size, 1) for kind in (_UPPER, _DIGIT, _SIGN, SPACE, _LINE)]
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    signs = np.bincount(row[_SIGN[data[end - 1]]], minlength=n) if len(row) else np.zeros(n)
    some = np.maximum(count, 1)
    return np.column_stack([np.log1p(count), np.log1p(size), *share, distinct / some, np.log1p(distinct), np.bincount(row[again], minlength=n) / some, signs / some, np.bincount(row, end - begin, minlength=n) / some])


def features(data: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    begin, end, row, h, place = word_rows(data, at)
    n = len(at) - 1
    pooled = np.zeros((n, vectors.shape[1]))
    for i in range(0, len(row), _CHUNK):
        r = row[i : i + _CHUNK]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        pooled[r[first]] += np.add.reduceat(vectors[place[i : i + _CHUNK]], first, axis=0)
    pooled /= np.maximum(np.bincount(row, minlength=n), 1)[:, None]
    return np.hstack([pooled, form(data, at, begin, end, row, h)])


def word_vectors(texts: list[str]) -> np.ndarray:
    index = index_vectors()
    around = np.zeros_like(index)
    for data, at in text_slices(texts):
        _, _, row, _, place = word_rows(data, at)
        for step in range(1, NEAR + 1):
            same = np.flatnonzero(row[step:] == row[:-step])
            for i in range(0, len(same), _CHUNK):
                s = same[i : i + _CHUNK]
                np.add.at(around, place[s], index[place[s + step]])
                np.add.at(around, place[s + step], index[place[s]])
    return _unit(index + _unit(around))


class Network:
    """x -> tanh(x A + a) -> logistic((h B + b) / temperature); inputs are standardized."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 60, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        x = (x - self.mean) / self.scale
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.temperature = 1.0
        aside = rng.random(len(x)) < 0.2
        if len(set(y[~aside])) < 2:  # nothing to tell apart: the share of label 1
            self.p = [0 * p for p in self.p]
            share = (y.sum() + 1) / (len(y) + 2)
            self.p[3] = np.array([np.log(share / (1 - share))])
            return
        self.fit(x[~aside], y[~aside], rounds, rng)
        if aside.any():
            z = self.logits(x[aside])
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.mean(np.logaddexp(0, z / t) - y[aside] * z / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, a0, b, b0 = self.p
        return np.tanh(x @ a + a0) @ b + b0[0]

    def fit(self, x, y, rounds, rng, rate=0.01, decay=1e-3, size=64) -> None:
        m, v = [0 * p for p in self.p], [0 * p for p in self.p]
        t = 0
        for epoch in range(rounds):
            order = rng.permutation(len(x))
            for i in range(0, len(x), size):
                k = order[i : i + size]
                h = np.tanh(x[k] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3][0], -30, 30))) - y[k]) / len(k)
                back = np.outer(d, self.p[2]) * (1 - h * h)
                g = [x[k].T @ back + decay * self.p[0], back.sum(axis=0), h.T @ d + decay * self.p[2], d.sum(keepdims=True)]
                t += 1
                for j in range(4):
                    m[j] = 0.9 * m[j] + 0.1 * g[j]
                    v[j] = 0.999 * v[j] + 0.001 * g[j] ** 2
                    step = rate * (1 - epoch / rounds)
                    self.p[j] = self.p[j] - step * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class QualityModel:
    """Called with the bytes of texts and where each begins: the probabilities of label 1."""

    def __init__(self, texts: list[str], y: np.ndarray):
        self.vectors = word_vectors(texts)
        rows = [features(data, at, self.vectors) for data, at in text_slices(texts)]
        self.network = Network(np.concatenate(rows) if rows else features(np.zeros(0, np.uint8), np.zeros(1, np.int64), self.vectors), y)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.network(features(data, at, self.vectors))


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; others are ignored).

    Learns ``labels.quality`` from at most ``most`` rows; see ``training_rows``. A null text is empty and scored as such. Without labels
    of both kinds every score is the share of label 1 (a half without any).
    """
    return scored(docs, QualityModel(*training_rows(docs, labels, "quality", most)), threshold)
