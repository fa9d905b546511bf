"""Toxicity (operator 10): subword-bag embeddings, averaged, into a linear softmax; all of it trained jointly in numpy.

A word, A-Z lower-cased, is the bag of its runs of three to five bytes, with the space before and after it, so a misspelling shares most
of its runs with the word it hides. Each run's hash names an embedding row. The embeddings of a word's runs are averaged and
go through the softmax's linear map, which gives the word's margin (toxic less clean). A document's margin is the soft average of its
words' margins, log(mean(exp)): a plain average for words that are alike, and one that a few words of a large margin still move in a
long text. Embeddings, linear map and intercept are trained together on the documents' labels alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import FIRST, SPACE, eights, mix, spans_hash, text_slices, words
from .labelled import scored, training_rows

ROWS, DIM, RUNS = 1 << 17, 4, (3, 4, 5)
#: Rows that training takes at most, and the score from which a document counts as toxic.
TRAINING_ROWS, THRESHOLD = 6000, 0.5
#: Rounds of training, its step, the factor on margins, the floor of a row's own scale (as a share of the largest): the lower, the faster rare runs learn.
ROUNDS, RATE, GAIN, FLOOR = 40, 0.1, 10.0, 0.1
_WINDOW, _WORDS = 1 << 18, 1 << 14
#: What parts words here: white space and all other ASCII signs.
GAP = SPACE.copy()
GAP[:128] |= [not chr(b).isalnum() for b in range(128)]
_SHIFT = np.uint64(64 - ROWS.bit_length() + 1)


def _row_of(eight: np.ndarray, i: np.ndarray, size: int) -> np.ndarray:
    """The embedding row of the run of ``size`` bytes at each place ``i``."""
    return (mix((eight[i] & FIRST[size]) ^ np.uint64(size << 56)) >> _SHIFT).astype(np.int32)


def runs(data: np.ndarray, at: np.ndarray):
    """(embedding row, word) arrays of all runs, window by window; the document of every word."""
    n = len(at) - 1
    # one space before each text and one after all, so that words at the edges have theirs
    spaced = np.full(len(data) + n + 1, 32, np.uint8)
    where = np.repeat(np.arange(1, n + 1), np.diff(at)) + np.arange(len(data))
    spaced[where] = np.where(GAP[data], np.uint8(32), data)
    gap = spaced == 32
    first = ~gap
    first[1:] &= gap[:-1]
    begins = np.flatnonzero(first)
    doc = np.searchsorted(at[:-1] + np.arange(n), begins, "right") - 1
    eight = eights(spaced)

    def windows():
        for a in range(0, len(spaced), _WINDOW):
            near = gap[a : a + _WINDOW + max(RUNS)]
            seen = np.concatenate([[0], np.cumsum(near)])
            for size in RUNS:
                i = np.arange(max(0, min(_WINDOW, len(near) - size + 1)))
                i = i[(seen[i + size - 1] == seen[i + 1]) & ~(near[i] & near[i + 1])]
                yield _row_of(eight, a + i, size), np.searchsorted(begins, a + i + 1, "right") - 1

    return windows(), doc


def _bags(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all runs, word by word, and where each word's begin (one more: the end)."""
    places, counts = [], []
    for i in range(0, len(spelled), _WORDS):
        part = spelled[i : i + _WORDS]
        data = np.frombuffer(b"".join(b" " + w + b" " for w in part), np.uint8)
        size = np.array([len(w) + 2 for w in part])
        owner, eight = np.repeat(np.arange(len(part)), size), eights(data)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(data))
        where = [np.flatnonzero(left >= k) for k in RUNS]
        word = owner[np.concatenate(where)]
        places.append(np.concatenate([_row_of(eight, w, k) for w, k in zip(where, RUNS)])[np.argsort(word, kind="stable")])
        counts.append(np.bincount(word, minlength=len(part)))
    return np.concatenate(places), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _sums(table: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of ``table``'s rows ``index`` from each ``at`` to the next, some at a time."""
    out = np.empty((len(at) - 1, table.shape[1]), table.dtype)
    for i in range(0, len(out), _WORDS):
        j = min(len(out), i + _WORDS)
        out[i:j] = np.add.reduceat(table[index[at[i] : at[j]]], at[i:j] - at[i], axis=0)
    return out


def _vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of every word of the texts, in order: its text and its number; the words by number."""
    number: dict[int, int] = {}
    spelled, word, doc, before = [], [], [], 0
    for data, at in text_slices(texts):
        data = np.where(GAP[data], np.uint8(32), data)
        begin, end, row = words(data, at)
        name, first, back = np.unique(spans_hash(data, begin, end), return_index=True, return_inverse=True)
        known = np.empty(len(name), np.int64)
        for k, (x, i) in enumerate(zip(name.tolist(), first.tolist())):
            if x not in number:
                number[x] = len(number)
                spelled.append(data[begin[i] : end[i]].tobytes())
            known[k] = number[x]
        word.append(known[back].astype(np.int32))
        doc.append((row + before).astype(np.int32))
        before += len(at) - 1
    return np.concatenate(doc), np.concatenate(word), spelled


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pooled(margin: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """log(mean(exp)) of each document's margins (0 without words), and each word's share in it. ``doc`` ascends."""
    some, start, count = np.unique(doc, return_index=True, return_counts=True)
    out = np.zeros(n)
    if not len(some):
        return out, margin
    top = np.maximum.reduceat(margin, start)
    e = np.exp(margin - np.repeat(top, count))
    total = np.add.reduceat(e, start)
    out[some] = np.log(total / count) + top
    return out, e / np.repeat(total, count)


class ToxicityModel:
    """Called with the bytes of texts and where each begins: the probabilities of label 1."""

    def __init__(self, texts: list[str], y: np.ndarray, seed: int = 11, rounds: int = ROUNDS):
        y = np.asarray(y, np.float64)
        share = (y.sum() + 1) / (len(y) + 2)
        self.weight, self.bias = np.zeros(ROWS, np.float32), float(np.log(share / (1 - share)))
        if len(set(y.tolist())) < 2:
            return
        doc, word, spelled = _vocabulary(texts)
        if len(spelled):
            self._fit(doc, word, *_bags(spelled), y, np.random.Generator(np.random.PCG64(seed)), rounds)

    def _fit(self, doc, word, place, at, y, rng, rounds) -> None:
        """Momentum on the logistic loss; both labels weigh alike at first, each document does at the end."""
        n, kinds = len(y), len(at) - 1
        used = np.unique(place)
        local = np.searchsorted(used, place).astype(np.int32)
        size = np.diff(at).astype(np.float32)[:, None]
        # orders in which the sums back from words to kinds of words, and from these to runs, are sums of neighbours
        by_run = np.argsort(local, kind="stable")
        run_at = np.searchsorted(local[by_run], np.arange(len(used) + 1))
        kind_of_run = np.repeat(np.arange(kinds, dtype=np.int32), np.diff(at))[by_run]
        del by_run, place
        by_kind = np.argsort(word, kind="stable").astype(np.int32)
        kind_at = np.searchsorted(word[by_kind], np.arange(kinds))
        p = [rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
        m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        even = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for t in range(1, rounds + 1):
            weight = even ** min(1.0, 2 * (1 - t / rounds))
            mean = _sums(p[0], local, at) / size * GAIN
            z = mean @ p[1]
            pooled, part = _pooled((z[:, 1] - z[:, 0])[word], doc, n)
            g = ((_sigmoid(pooled + p[2][1] - p[2][0]) - y) * weight / n).astype(np.float32)
            back = np.add.reduceat((g[doc] * part)[by_kind], kind_at)[:, None] * np.array([-1, 1], np.float32)
            to_mean = back @ p[1].T / size * GAIN
            slope = [_sums(to_mean, kind_of_run, run_at), mean.T @ back, np.array([-g.sum(), g.sum()], np.float32)]
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * slope[k]
                v[k] = 0.99 * v[k] + 0.01 * slope[k] ** 2
                scale = np.sqrt(v[k] / (1 - 0.99**t))
                p[k] = p[k] - RATE * (1 - t / (rounds + 1)) * (m[k] / (1 - 0.9**t)) / ((1 - FLOOR) * scale + FLOOR * scale.max() + 1e-9)
        # a softmax of two classes is the logistic of their difference: one number for each row is all that scoring needs
        self.weight[used] = GAIN * (p[0] @ (p[1][:, 1] - p[1][:, 0]))
        self.bias = float(p[2][1] - p[2][0])

    def __call__(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        parts, doc = runs(data, at)
        total, size = np.zeros(len(doc)), np.zeros(len(doc))
        for place, word in parts:
            if len(word):
                low, most = int(word[0]), int(word[-1]) + 1
                total[low:most] += np.bincount(word - low, self.weight[place], minlength=most - low)
                size[low:most] += np.bincount(word - low, minlength=most - low)
        return _sigmoid(_pooled(total / np.maximum(size, 1), doc, len(at) - 1)[0] + self.bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; others are ignored).

    Learns ``labels.toxic`` from at most ``most`` rows; see ``training_rows``. A null text is empty and scored as such; a text without words
    gets what the intercept says. Without labels of both kinds, or without words, every score is the share of label 1 (a half without any).
    """
    return scored(docs, ToxicityModel(*training_rows(docs, labels, "toxic", most)), threshold)
