"""Numbers and dictionaries against Python's own."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.operators import numbering


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_numbered(spark, parts):
    rows = [(i * 7919 % 500, ["b", "A", None, "a"][i % 4]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s string").withColumn("key", F.lit(1)).withColumn("part", F.lit(2)).withColumn("row", F.lit("x")).repartition(6)
    got = numbering.numbered(df, [F.lower("s"), "id"], parts=parts)
    assert got.columns == ["id", "s", "key", "part", "row", "number"]
    want = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").lower(), r[0]))
    assert [(r.id, r.s) for r in sorted(got.collect(), key=lambda r: r.number)] == want and sorted(r.number for r in got.collect()) == list(range(500))
    # no task sees more than its range: the only window over everything has one row for each of them
    assert numbering.numbered(df.limit(0), ["id"]).count() == 0


def test_equal_rows_and_hot_keys(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"))
    got = numbering.numbered(df, ["k"], parts=8).collect()
    assert sorted(r.number for r in got) == list(range(1000)) and all(r.k == (r.number >= 500) for r in got)


def test_numbered_paths(spark):
    files = spark.createDataFrame([("B.pdf", 1), ("a.pdf", 2), ("A.PDF", 3), ("b.pdf", 0), ("ç.pdf", 4)], "path string, ord int")
    assert sorted(map(tuple, numbering.numbered_paths(files).collect()), key=lambda r: r[1]) == [("A.PDF", 0), ("B.pdf", 1), ("ç.pdf", 2)]


def test_first_seen(spark):
    docs = [(i, [f"w{(i * j) % 37}" for j in range(i % 23)] + [None]) for i in range(80)]
    rows = [(i, k, w) for i, ws in docs for k, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "doc int, place int, word string").repartition(7)
    codes: dict[str, int] = {}
    for _, _, w in rows:
        if w is not None:
            codes.setdefault(w, len(codes))
    dictionary = numbering.first_seen(df, "word", ["doc", "place"])
    assert {r.word: r.code for r in dictionary.collect()} == codes
    coded = numbering.coded(df, "word", dictionary)
    assert Counter(map(tuple, coded.select("doc", "place", "code").collect())) == Counter((i, k, codes.get(w)) for i, k, w in rows)
    back = numbering.decoded(coded, "word", dictionary)
    assert Counter(map(tuple, back.select("doc", "place", "word").collect())) == Counter(rows)
    assert numbering.first_seen(df.limit(0), "word", ["doc", "place"]).count() == 0


def test_folded_words(spark):
    """One row for each word of a text, however often it stands there, with what its places add up to."""
    texts = [(1, "b a b  b"), (2, None), (3, ""), (4, " \ta\r\nb "), (5, "ä a\u00a0a ä ä"), (6, "x " * 5000), (1, "b c")]
    want = Counter()
    for i, t in texts:
        found = {}
        for k, w in enumerate(re.split(r"[ \t\n\r]+", t) if t is not None else []):
            found.setdefault(w, []).append(k)
        want.update((i, w, at[0], len(at), sum(at) + len(at)) for w, at in found.items())
    df = spark.createDataFrame(texts, "id long, t string")
    for rows in (df.coalesce(1), df.repartition(5)):
        got = numbering.folded_words(rows, "id", "t", r"[ \t\n\r]+")
        assert Counter(map(tuple, got.collect())) == want and got.columns == ["id", "word", "place", "n", "places"]
    exploded = df.select("id", F.posexplode(F.split("t", r"[ \t\n\r]+")).alias("place", "word")).groupBy("id", "word").agg(F.count("*"), F.sum(F.col("place") + 1))
    assert Counter(map(tuple, exploded.collect())) == Counter(map(tuple, got.groupBy("id", "word").agg(F.sum("n"), F.sum("places")).collect()))
    assert numbering.folded_words(df.limit(0), "id", "t", " ").count() == 0
