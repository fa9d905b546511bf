"""The classifiers' scores against plain Python, and every operator on a table with a very long text."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import fingerprint, jaccard, labelled, mixing, packing, quality, secrets, sstable, toxicity
from pagemill.llm.common import mix, shared_dir, spans_hash, text_slices, utf8
from pagemill.llm.encoding import encoder

from .test_operators import BYTE, WORD

TEXTS = ["You IDIOT, you id1ot! Ünd so weiter; a b", "one\ttwo  two Two 3,000\n\nüber-all ÄÖ end.", "", " \n", "x", "word " * 300 + "moron", "né" * 400]


def _mixed(x: int) -> int:
    return int(mix(np.array([x], np.uint64))[0])


def _word_hash(word: bytes) -> int:
    return int(spans_hash(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def test_hash_of_a_word_is_its_own():
    """Whatever stands about it, and A-Z as a-z."""
    words = [b"a", b"abcdefgh", b"abcdefghi", "größe".encode(), b"x" * 300, b"X" * 300]
    data = b"  ".join(words)
    begin = np.array([sum(len(w) + 2 for w in words[:k]) for k in range(len(words))])
    got = spans_hash(np.frombuffer(data, np.uint8), begin, begin + [len(w) for w in words]).tolist()
    assert got == [_word_hash(w.lower() if w.isascii() else w) for w in words] and len(set(got)) == 5


def test_toxicity_by_hand():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["fine", "day", "sun", "tree", "idiot" if i % 3 == 0 else "walk"], 30)) for i in range(120)]
    model = toxicity.ToxicityModel(texts, np.array([float("idiot" in x) for x in texts]), rounds=30)
    got = np.concatenate([model(data, at) for data, at in text_slices(TEXTS)])
    for text, score in zip(TEXTS, got):
        margins = []
        for w in re.split(rb"[\x00-/:-@\[-`{-\x7f]+", text.encode()):
            if w:
                s = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in w) + b" "
                runs = [s[i : i + k] for k in (3, 4, 5) for i in range(len(s) - k + 1)]
                rows = [_mixed(int.from_bytes(r, "little") ^ len(r) << 56) >> 47 for r in runs]
                margins.append(sum(float(model.weight[r]) for r in rows) / len(rows))
        z = (math.log(sum(map(math.exp, margins)) / len(margins)) if margins else 0.0) + model.bias
        assert abs(score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-5
    assert model(*utf8(pa.array(["an idi0t here", "what an idiot you are", "a fine day under the tree"])))[1] > 0.5 > model(*utf8(pa.array(["a fine day under the tree"])))[0]


def test_toxicity_with_little_to_learn_from():
    for texts, y in ((["alpha", "beta"], [0, 1]), (["", "a"], [0, 1]), (["", ""], [0, 1]), ([], []), (["a"], [1])):
        s = toxicity.ToxicityModel(texts, np.array(y, float))(*utf8(pa.array(["", "alpha", "other"])))
        assert ((s >= 0) & (s <= 1)).all()
        s = quality.QualityModel(texts, np.array(y, float))(*utf8(pa.array(["", "alpha", "other"])))
        assert ((s >= 0) & (s <= 1)).all()


def test_quality_features_by_hand():
    vectors = quality.word_vectors(TEXTS)
    got = np.concatenate([quality.features(data, at, vectors) for data, at in text_slices(TEXTS)])
    kinds = [(65, 90), (48, 57)]
    for text, row in zip(TEXTS, got):
        raw = text.encode()
        words = [w for w in re.split(rb"[\x20\t-\r]+", raw) if w]
        low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
        pooled = sum((vectors[_word_hash(w) >> 48].astype(float) for w in words), np.zeros(vectors.shape[1])) / max(1, len(words))
        n, size = max(1, len(words)), max(1, len(raw))
        sign = lambda c: 33 <= c < 127 and not chr(c).isalnum()
        share = [sum(a <= c <= b for c in raw) / size for a, b in kinds] + [sum(map(sign, raw)) / size, sum(c in b" \t\n\x0b\x0c\r" for c in raw) / size, raw.count(b"\n") / size]
        again = sum(a == b for a, b in zip(low, low[1:]))
        form = [math.log1p(len(words)), math.log1p(len(raw)), *share, len(set(low)) / n, math.log1p(len(set(low))), again / n, sum(sign(w[-1]) for w in words) / n, sum(map(len, words)) / n]
        assert np.allclose(row, [*pooled, *form], atol=1e-5)


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = np.random.default_rng(4)
    words = rng.choice(["alpha", "Beta", "gämma", "delta9", "x"], 400_000).tolist()
    words[200_000] = 'token="0123456789abcdef0123"'
    texts = [" ".join(words), "y" * 2_500_000, "short text of some words here", None]
    return spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, source string"), texts


def test_very_long_texts(spark, long_docs):
    docs, texts = long_docs
    whole = [x or "" for x in texts]
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    e, start = encoder(WORD, "<u2"), 0
    for i, r in sorted(by_id(sstable.token_spans(docs, WORD)).items()):
        ids = np.frombuffer(e(whole[i]) + b"\2\0", "<u2").astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc32(ids.tobytes()))
        start += len(ids)
    assert {i: r.n_chars for i, r in by_id(fingerprint.fingerprints(docs)).items()} == {i: len(x) for i, x in enumerate(whole)}
    found = by_id(secrets.secret_report(docs, f"{shared_dir(spark)}/long"))
    at = whole[0].index("token=")
    assert found[0].spans == f"assign:{at}:{at + 27},hex:{at + 7}:{at + 27}" and found[1].spans == "" and found[3].spans == ""
    sets = by_id(jaccard.jaccard_components(docs))
    w = whole[0].lower().split(" ")
    assert sets[0].n_shingles == len(set(zip(*(w[k:] for k in range(5))))) and sets[1].n_shingles == 1 and sets[3].n_shingles == 0
    assert {i: r.size for i, r in by_id(mixing.mixture(docs)).items()} == {0: 400_000, 1: 1, 2: 6, 3: 0}
    used = Counter()
    for p in packing.pack(docs, BYTE).collect():
        used[p.doc_id] += p.length
    byte = encoder(BYTE)
    assert used == {i: len(byte(x)) // 4 + 1 for i, x in enumerate(whole)}
    for model in (quality.QualityModel(["a b", "c d"] * 20, np.array([0.0, 1.0] * 20)), toxicity.ToxicityModel(["a b", "c d"] * 20, np.array([0.0, 1.0] * 20))):
        got = by_id(labelled.scored(docs, model, 0.5))
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got.values())


def test_balanced_rates_by_bisection(spark):
    """The multipliers of the dual meet each source's target, as a bisection in Python finds them."""
    rng = np.random.default_rng(9)
    size = np.concatenate([rng.integers(1, 50, 200), [5000], rng.integers(1, 400, 100)])
    key = ["=a"] * 201 + ["=b"] * 100
    rows = spark.createDataFrame([(i, k, i, int(n)) for i, (k, n) in enumerate(zip(key, size))], "doc_id long, key string, h long, size long")
    own = {k: int(size[[x == k for x in key]].sum()) for k in ("=a", "=b")}
    target = {"=a": 0.4 * own["=a"], "=b": 2.2 * own["=b"]}
    goals = spark.createDataFrame([(k, own[k], target[k]) for k in own], "key string, source_size long, target double")
    for r in mixing.balanced(rows, goals).collect():
        x = size[[k == r.key for k in key]]
        mean = x.mean()
        now = lambda m: float((x * 3 / (1 + 2 * np.exp(np.clip(-m * x / mean, -700, 700)))).sum())  # noqa: B023, E731
        low, high = -1e3, 1e3
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if now(m) < target[r.key] else (low, m)
        assert abs(r["mean"] - mean) < 1e-9 and abs(r.m - m) < 1e-3 * max(1, abs(m)) and abs(now(r.m) / target[r.key] - 1) < 1e-5
    assert mixing.balanced(rows.where(F.lit(False)), goals.where(F.lit(False))).count() == 0
