"""Operators 11 to 13 against brute force in plain Python, and against their DuckDB twins."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import centroids, divergence, neardup, queries

DIR = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_embedding_neardup", "op13_source_divergence"])
def test_twin(spark, name):
    c = duckdb.connect()
    for n in ("documents", "embeddings"):
        c.execute(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    rel = c.execute(queries.ORACLES[name])
    at = [x[0] for x in rel.description]
    assert sorted(at) == sorted(df.columns)
    assert Counter(map(tuple, df.select(at).collect())) == Counter(rel.fetchall())


def clashing(df):
    for k, name in enumerate(("name", "n", "id", "h", "v", "x", "s", "copies", "group", "part", "term", "node")):
        df = df.withColumn(name, F.lit(k))
    return df


# --- 11 ---------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, width):
    kept = [(i, [centroids.quantized(x) for x in v]) for i, v, _ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]
    far = lambda v, m: sum((x - y) ** 2 for x, y in zip(v, m))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)].append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j])] if j in of else m for j, m in enumerate(c)]
    at = [(i, near(v), far(v, c[near(v)])) for i, v in kept]
    sums = Counter()
    for _, j, e in at:
        sums[j] += e
    long = lambda x: x if x < 2**63 else None
    return Counter((i, j, long(e), long(sums[j]), long(sum(sums.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, e in at)


@pytest.mark.parametrize("scale", [1.0, 3e4, 2e5, 1e12, 1e300])
def test_op11_every_magnitude(spark, scale):
    rng = np.random.default_rng(4)
    v = (rng.normal(0, 1, (70, 6)) + rng.integers(0, 4, 70)[:, None] * 3) * np.where(np.arange(70) % 7, 1.0, scale)[:, None]
    rows = [(i, x.tolist(), None) for i, x in enumerate(v)]
    rows += [rows[3], rows[3], (3, rows[5][1], None), (None, rows[8][1], 1), (-4, [0.0] * 6, 1), (-5, [-0.0] * 6, 1), (900, None, 1), (901, [], 1), (902, [1.0] * 5, 1), (903, [1.0] * 5 + [None], 1)]
    rows += [(904, [1.0] * 5 + [math.nan], 1), (905, [math.inf] + [1.0] * 5, 1)]
    if scale == 1e300:
        rows.append((950, [1.7e308, -1.7e308, 0.0, 1.0, 2.0, 3.0], 1))  # beyond doubles once quantized
    got = centroids.cluster(clashing(spark.createDataFrame(rows, VECTORS).repartition(3)), 4, 5, 6).collect()
    assert Counter(map(tuple, got)) == plain_clusters(rows, 4, 5, 6)


def test_op11_bounds_and_ties():
    at = math.isqrt(centroids.DOUBLE // 4)
    x = np.array([[0.5, -0.5, 0.25, 0], [2.0**40, 1, 1, 1], [-(2.0**60), 1, 1, 1], [(at - 2.0) / 1024, 0, 0, 0], [(at + 2.0) / 1024, 0, 0, 0]])
    c = [[1, -1, 1, -1], [-1, 1, -1, 1], [0, 0, 0, 0]]
    got = {int(i): (a.dtype.kind, [int(z) for z in row]) for some, a, far in centroids.distances(x, c) for i, row in zip(some, far)}
    for i, v in enumerate(x):
        assert got[i][1] == [sum((centroids.quantized(float(p)) - q) ** 2 for p, q in zip(v, m)) for m in c]
    assert [got[i][0] for i in range(5)] == ["f", "O", "O", "f", "i"]
    _, _, far = next(centroids.distances(np.zeros((1, 4)), c[:2]))
    assert far.argmin(axis=1).tolist() == [0]


def test_op11_few_and_none(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroids.cluster(none).collect() == [] and centroids.cluster(none).dtypes[2] == ("distance", "bigint")
    one = spark.createDataFrame([(5, [0.25] * 64, 1)] * 3, VECTORS)
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in centroids.cluster(one).collect()] == [(5, 0, 0, 0)] * 3


# --- 12 ---------------------------------------------------------------------------------------------------------------


def plain_links(rows, least=neardup.COSINE):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and neardup.cosine(np.array(rows[i][1]), np.array(rows[j][1])) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r[0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], n[i], first[root(i)], r[0] == first[root(i)]) for i, r in enumerate(rows))


@pytest.fixture(scope="module")
def crowded():
    """Tight groups, chains, copies, a label that holds most rows, vectors of several lengths and odd ones."""
    rng = np.random.default_rng(7)
    rows, d = [], 20
    base = rng.normal(0, 1, (12, d))
    for i in range(360):
        rows.append((1000 - i, (base[i % 12] + rng.normal(0, 0.3, d) * (i % 5) / 2).tolist(), 1 if i % 3 else i % 4))
    step = rng.normal(0, 1, (2, d))
    for i in range(60):  # a chain: each links with its neighbours, its ends with nothing of each other
        rows.append((2000 + i, (step[0] * math.cos(i / 8) + step[1] * math.sin(i / 8)).tolist(), 7))
    rows += [(3000 + i, rows[5][1], rows[5][2]) for i in range(40)] + [(3000, rows[5][1], rows[5][2]), (3001, rows[9][1], 9)]  # copies, ids that come twice
    rows += [(None, rows[5][1], rows[5][2]), (None, [9.0] * d, 5), (None, [9.0] * d, 5), (None, rows[7][1], None), (4001, [1.0, 2.0], 1), (4002, [2.0, 4.0], 1), (4003, [-1.0, -2.0], 1)]
    rows += [(4010, None, 1), (4011, [], 1), (4012, [0.0] * d, 1), (4013, [None] + [1.0] * (d - 1), 1), (4014, [math.nan] * d, 1), (4015, [math.inf] * d, 1), (4016, [1e300] * d, 1), (4017, [1e-300] * d, 1), (4018, [5e-324] * d, 1), (4019, [-0.0] * (d - 1) + [3.0], 1), (4020, [0.0] * (d - 1) + [5.0], 1)]
    return rows


@pytest.mark.parametrize("sequence", [neardup.SEQUENCE, 1500, 160])
def test_op12_brute_force(spark, crowded, sequence):
    want = plain_links(crowded)
    assert len({c for (_, _, c, _) in want}) > 5 and max(n for (_, n, _, _) in want) > 50
    want = Counter({(i, n, c, i == c): k for (i, n, c, _), k in want.items()})
    got = neardup.near_duplicates(clashing(spark.createDataFrame(crowded, VECTORS).repartition(5)), sequence=sequence).collect()
    assert Counter(map(tuple, got)) == want


def test_op12_at_the_threshold(spark):
    b = (1 - 0.93**2) ** 0.5
    rows = [(1, [1.0, 0.0], 1), (2, [0.93, b], 1), (3, [0.93, -b - 1e-12], 1), (4, [3.0, 4.0], 2), (5, [6.0, 8.0], 2)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter(map(tuple, got)) == plain_links(rows)


def test_op12_leaves_skip_only_what_is_distant():
    rng = np.random.default_rng(2)
    u = neardup.unit(np.concatenate([rng.normal(c, 0.2, (300, 8)) for c in np.eye(8) * 4]))
    x = neardup.coordinates(u, {})
    held = neardup.boxes(x)
    pairs = list(neardup.leaves(held, held, len(u), len(u), True, 0.14))
    seen = np.zeros((len(u), len(u)), int)
    for (a, b), (c, d) in pairs:
        seen[a:b, c:d] += 1
        if a != c:
            seen[c:d, a:b] += 1
    near = u @ u.T >= 0.93
    assert seen.max() == 1 and seen[near].all() and seen.mean() < 0.4


def test_op12_empty(spark):
    none = neardup.near_duplicates(spark.createDataFrame([], VECTORS))
    assert none.collect() == [] and none.columns == ["vec_id", "n_links", "component_id", "kept"]
    odd = neardup.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [1.0], None), (None, None, None)], VECTORS)).collect()
    assert sorted(map(tuple, odd), key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)


# --- 13 ---------------------------------------------------------------------------------------------------------------


def plain_audit(rows, least, ranks):
    found = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    frequency, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = [w.translate(lower) for w in found.findall(text or "")]
        groups.add((lang or "", source or ""))
        frequency[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = Counter()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in frequency[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for la, s in groups if la == lang}
        own[None] = {t: sum(own[s][t] for s in own) for t in kept}
        rate = {s: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()} for s, c in own.items()}
        for s in own:
            if s is None:
                continue
            pairs = [(sum(abs(rate[s][t] - rate[o][t]) for t in kept), o) for o in own if o not in (s, None)]
            terms = [(rate[s][t] - rate[None][t], t) for t in kept if own[s][t] and rate[s][t] > rate[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out.update((lang, s, part, item, value, k) for k, (value, item) in enumerate(items[:most], 1))
    return out


DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}" for a in "ab cé dß Éf 日本 ﬁ İx".split() for b in "xyzäö"]
    out = []
    for i in range(160):
        words = rng.choice(vocabulary, int(rng.integers(0, 40)), p=(w := np.arange(1, len(vocabulary) + 1) ** -0.7) / w.sum())
        sign = [" ", "\n", "-", "1", "_", "\x00", "\x7f", "{", "@", "'"][i % 10]
        text = sign.join(x.upper() if i % 4 == 0 and x.isascii() else x for x in words)
        out.append((text, ["en", "de", None, ""][i % 4 if i % 3 else 0], f"s{i % 9}" if i % 5 else None))
    out += [(None, "en", "nothing"), ("", "xx", "a"), ("word", "xx", "b"), ("123 !", "yy", "alone"), ("abx " * 30000, "en", "s1"), ("q" * 200000, "en", "s1")] + [("abx cézx", "en", "s2")] * 4
    return out


@pytest.mark.parametrize(("least", "ranks", "shard", "tile"), [(3, 50, divergence.SHARD, divergence.TILE), (1, 2, 50_000, 2), (10**6, 50, 64, 1)])
def test_op13_brute_force(spark, texts, monkeypatch, least, ranks, shard, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "CELLS", divergence.CELLS if tile > 2 else 40)
    monkeypatch.setattr(divergence, "ROOM", 25)
    df = clashing(spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], DOCS).repartition(4))
    got = divergence.audit(df, least, ranks, shard)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_audit(texts, least, ranks)


def test_op13_counts_beyond_a_long(spark):
    """Rates stay exact where a count times 10^9 is beyond a long."""
    n, total, size = 7 * 10**14 + 3, 9 * 10**14 + 1, 12345
    df = spark.createDataFrame([(n, total, size)], "n long, total long, size long")
    got = df.select(divergence._rate(F.col("n"), F.col("total"), F.col("size"))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * size)


def test_op13_empty(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
