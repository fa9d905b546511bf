"""Each stage of the corpus pipeline against brute force, and the whole of it."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from pagemill.llm import labelled, mixing, quality, secrets
from pagemill.llm.common import utf8
from pagemill.llm.encoding import encoder, tokenizer_path

from .test_operators import BYTE, DIR, DOCS, components, docs, none, rows  # noqa: F401  fixtures


def _tuples(df):
    return Counter(tuple(r) for r in df.collect())


def test_good_quality(spark, docs):  # noqa: F811
    real = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("score", F.lit("x"))
    both = real.unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit("y").alias("score")))
    got = pipeline.good_quality(spark, both, DIR)
    assert got.columns == both.columns
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    texts, y = labelled.training_rows(both, labels, "quality", quality.TRAINING_ROWS)
    taught = {r.doc_id: r.quality for r in labels.collect() if crc32(str(r.doc_id).encode()) % 5}
    assert len(texts) == len({r.doc_id for r in both.collect()} & set(taught)) and len(y) == len(texts)
    model = quality.QualityModel(texts, y)
    want = Counter(tuple(r) for r in both.collect() if model(*utf8(pa.array([r.text or ""])))[0] >= quality.THRESHOLD)
    assert _tuples(got) == want and 0 < sum(want.values()) < both.count()


def test_training_rows_are_bounded(spark):
    """Repeated ids give one text, and texts come while they fit."""
    docs = spark.createDataFrame([(i % 40, "a" * (1 + i)) for i in range(400)], "doc_id long, text string")  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    free = sum(1 for i in range(40) if crc32(str(i).encode()) % 5)
    texts, y = labelled.training_rows(docs, labels, "quality", 1000)
    assert len(texts) == len(y) == free
    assert len(labelled.training_rows(docs, labels, "quality", 7)[0]) == 7
    few, _ = labelled.training_rows(docs, labels, "quality", 1000, most_bytes=500)
    assert few == texts[: len(few)] and sum(map(len, few)) <= 500 < sum(map(len, texts[: len(few) + 1]))
    assert labelled.training_rows(docs.limit(0), labels, "quality", 10)[0] == []


def test_without_near_duplicates(spark, docs, rows):  # noqa: F811
    twice = spark.createDataFrame([(1000, "a text of its own that is not in any other row", "en", s, n) for s, n in (("a", 1), ("b", 1), ("b", 2), ("a", 1))], DOCS)
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(twice)
    want = components({r[0]: r[1] for r in rows if r[0] is not None})
    first = {i for i, (_, c) in want.items() if c == i} | {1000}
    expected = {tuple(r) for r in more.collect() if r.doc_id in first or r.doc_id is None}
    assert _tuples(pipeline.without_near_duplicates(spark, more, DIR)) == Counter(expected)


def _without_secrets(text):
    spans = []
    for rule in secrets.RULES:
        pattern = re.compile(rule.pattern.replace("{0,1000}+", "{0,1000}"))
        spans += [m.span() for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]
    out, at = "", 0
    for begin, end in sorted(spans):
        if begin > at or (not at and not out):
            out += text[at:begin] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_without_secrets(spark, docs):  # noqa: F811
    got = pipeline.without_secrets(spark, docs, DIR)
    assert got.columns == docs.columns
    texts = {(r.doc_id, r.source): r for r in got.collect()}
    for r in docs.collect():
        new = texts[r.doc_id, r.source]
        if r.text is None:
            assert new.text is None
        else:
            assert new.text == _without_secrets(r.text) and new.n_chars == len(new.text)


def test_mixed_sources(spark, docs):  # noqa: F811
    plan = defaultdict(list)
    for r in mixing.copies(docs).collect():
        plan[r.doc_id].append(r.copies)
    got = Counter(r.doc_id for r in pipeline.mixed_sources(spark, docs, DIR).collect())
    assert got == Counter({k: n for k, v in plan.items() if (n := sum(v))})


def test_packed_sequences(spark, docs, rows):  # noqa: F811
    encode, pieces, used = encoder(BYTE), defaultdict(Counter), Counter()
    for p in pipeline.packed_sequences(spark, docs, DIR).collect():
        pieces[p.doc_id][p.start, p.length, p.ids_crc32] += 1
        used[p.sequence_id] += p.length
    for i, text in Counter((r[0], r[1]) for r in rows):
        ids = encode(text or "") + bytes(4)
        for start, length, crc in pieces[i]:
            if i is not None:
                assert crc32(ids[4 * start : 4 * (start + length)]) == crc
        times = sum(r[0] == i for r in rows)
        assert sum(length * k for (_, length, _), k in pieces[i].items()) == times * len(ids) // 4
    assert max(used.values()) <= 1024


@pytest.mark.parametrize("empty", [False, True])
def test_run(spark, tmp_path, empty):
    """The stages one after another on whole tables."""
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{DIR}/{name}.parquet")
        (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert not got
        return
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")  # noqa: F811
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    encode = encoder(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(encode(r.text or "")) // 4 + 1
    have = Counter()
    for p in got:
        have[p.doc_id] += p.length
    assert have == want and np.all([p.offset + p.length <= 1024 for p in got])
