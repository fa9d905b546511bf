"""Approximate nearest neighbours (operator 7) by cross-polytope hashing.

A hash is a pair of pseudo-rotations (signs and fast Hadamard transforms, three times), each followed by the nearest signed
axis; a bucket is a pair of axes, and each of ``TABLES`` tables has rotations of its own. A query ranks the buckets of a table by the inner
product that a vector in them is expected to have with it, probes the best ones, and every vector in a probed bucket is a candidate,
scored exactly. The share of the buckets that is probed falls with the number of vectors, as ``share`` says.

Directions are hashed, so the largest inner product is the nearest vector as far as norms are alike. Vectors are therefore kept by ranges
of norm, each with tables of its own, searched from the largest norm on until no vector of the next could be a result.

Vectors and queries are dealt in blocks of bounded size, and every block of queries meets every block of vectors once: a vector is
sent once for each block of queries, a query once for each block of vectors, and only its best rows of the block come back. Equal
vectors are one candidate, of which the smallest ids are kept: as many as a result may hold. A query left with fewer rows than
wanted is scored against all rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

TABLES = 24
#: Bytes of vectors in a block: of those searched, of queries.
BLOCK, ASKED = 4 << 20, 2 << 20
#: The probed share of a table's buckets at ``AT`` vectors, and the power by which it falls above and rises below.
SHARE, AT, ABOVE, BELOW = 0.011, 2000, 0.33, 0.55
#: The ratio of norms that are one range.
RANGE = 1.1
_CHUNK = 128


def share(n: int) -> float:
    """Of a table's buckets, the share that is probed where ``n`` vectors are hashed: for a recall of over nine tenths of random ones."""
    return min(1.0, SHARE * (AT / n) ** (ABOVE if n > AT else BELOW))


def hadamard(y: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of columns whose length is a power of two, orthonormal."""
    d, n = y.shape
    step = 1
    while step < d:
        pairs = y.reshape(d // (2 * step), 2, step, n)
        y = np.empty_like(pairs)
        np.add(pairs[:, 0], pairs[:, 1], out=y[:, 0])
        np.subtract(pairs[:, 0], pairs[:, 1], out=y[:, 1])
        step *= 2
    return y.reshape(d, n) * np.float32(d**-0.5)


@cache
def signs(d: int, number: int, seed: int = 5) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, number])).choice(np.array([-1, 1], np.float32), (3, d, 1))


def width(x: np.ndarray) -> int:
    return 1 << max(1, (x.shape[1] - 1).bit_length())


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """The rows of ``x``, as columns, after a pseudo-rotation."""
    d = width(x)
    y = np.zeros((d, len(x)), np.float32)
    y[: x.shape[1]] = x.T
    for s in signs(d, number):
        y = hadamard(y * s)
    return y


def nearest_axes(x: np.ndarray, number: int) -> np.ndarray:
    """Of each row the nearest signed axis: 2 i is axis i, 2 i + 1 its negative."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), _CHUNK * 8):
        y = rotated(x[i : i + _CHUNK * 8], number).T
        best = np.abs(y).argmax(axis=1)
        out[i : i + len(y)] = 2 * best + (y[np.arange(len(y)), best] < 0)
    return out


def signed(y: np.ndarray) -> np.ndarray:
    """The inner product with every signed axis."""
    return np.stack([y, -y], axis=2).reshape(len(y), -1)


@cache
def rank_pairs(axes: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ranks that can be among the ``probes`` largest sums of one number of each of two falling lists."""
    i = np.repeat(np.arange(axes), [min(axes, probes // (k + 1)) for k in range(axes)])
    j = np.concatenate([np.arange(min(axes, probes // (k + 1))) for k in range(axes)])
    return i, j


def probed(q: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Of each direction the ``probes`` best buckets of a table."""
    first, second = (signed(rotated(q, 2 * table + k).T) for k in (0, 1))
    axes = first.shape[1]
    if probes >= axes * axes:
        return np.broadcast_to(np.arange(axes * axes), (len(q), axes * axes))
    a, b = np.argsort(-first, axis=1), np.argsort(-second, axis=1)
    i, j = rank_pairs(axes, probes)
    total = np.take_along_axis(first, a, 1)[:, i] + np.take_along_axis(second, b, 1)[:, j]
    best = np.argpartition(-total, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(a, i[best], 1) * axes + np.take_along_axis(b, j[best], 1)


class Index:
    """The tables of a block's vectors, by ranges of norm from the largest on. counts: how many vectors all blocks have in each range."""

    def __init__(self, v: np.ndarray, span: np.ndarray, counts: dict[int, int], tables: int, whole: bool):
        self.parts = []
        top = np.abs(v).max(axis=1, keepdims=True)
        for s in np.unique(span)[::-1]:
            rows = np.flatnonzero(span == s)
            u = v[rows] / top[rows]
            length = np.linalg.norm(u, axis=1, keepdims=True)
            with np.errstate(over="ignore"):
                most = float((top[rows] * length).max())
            portion = 1.0 if whole else share(counts[int(s)])
            codes = None
            if portion < 1:
                u /= length
                hashes = [nearest_axes(u, k) for k in range(2 * tables)]
                axes = 2 * width(v)
                codes = [hashes[2 * t] * axes + hashes[2 * t + 1] for t in range(tables)]
            self.parts.append((rows, most, portion, codes))

    def candidates(self, q: np.ndarray, part: int) -> np.ndarray:
        """A flag for each direction and vector of the range."""
        rows, _, portion, codes = self.parts[part]
        out = np.zeros((len(q), len(rows)), bool)
        if codes is None:
            out[:] = True
            return out
        axes = 2 * width(q)
        probes = max(1, int(np.ceil(portion * axes * axes)))
        for t, code in enumerate(codes):
            open_ = np.zeros((len(q), axes * axes), bool)
            np.put_along_axis(open_, probed(q, t, probes), True, 1)
            out |= open_[:, code]
        return out


def _exact(d: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with ``q``, their terms added one after another."""
    out = np.zeros(len(d))
    for k in range(len(q)):
        out = out + d[:, k] * q[k]
    return out


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: of every row with vec_id divisible by ``every`` its ``k`` nearest other rows found.

    vectors: vec_id, embedding (others are ignored). Score: the inner product of the given vectors in double precision; ties go to the
    smaller vec_id. Null ids, and vectors that are null, empty, zero or hold a component that is null or not finite, take no part. Of rows with
    the same id one counts (that of the least hash of its vector). Vectors of different lengths have no product: a query
    meets those of its own length alone. A pair whose sum isn't a number (of components so large that terms overflow) is no result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("v", F.expr("transform(v, x -> x + 0D)")).withColumn("name", F.sha2(F.concat_ws(",", F.expr("transform(v, x -> string(x))")), 256))
    rows = cut(rows.groupBy("vec_id").agg(F.min(F.struct("name", "v")).alias("x")).select("vec_id", "x.name", "x.v"))
    # of equal vectors the k + 1 smallest ids (one may be the query's own): first within a part, then of all
    part = W.partitionBy("name", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    ids = rows.select("name", "vec_id").withColumn("i", F.row_number().over(part)).where(f"i <= {k + 1}")
    ids = ids.withColumn("i", F.row_number().over(W.partitionBy("name").orderBy("vec_id"))).where(f"i <= {k + 1}")
    groups = ids.groupBy("name").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    kinds = rows.join(groups.withColumn("vec_id", F.col("ids")[0]), ["name", "vec_id"]).select("vec_id", "v", "ids")
    # the logarithm of the norm, of components as large as may be
    top = F.expr("array_max(transform(v, x -> abs(x)))")
    size = F.log("top") + 0.5 * F.log(F.expr("aggregate(v, 0D, (a, x) -> a + (x / top) * (x / top))"))
    kinds = cut(kinds.withColumn("top", top).withColumn("span", F.round(size / float(np.log(RANGE))).cast("int")).drop("top"))
    # one row for each length of vectors and range of norm, of which doubles have fewer than 15,000
    counts: dict[int, dict[int, int]] = {}
    for r in kinds.groupBy(F.size("v").alias("d"), "span").count().collect():
        counts.setdefault(r.d, {})[r.span] = r["count"]
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = cut(_best(_searched(asked, kinds, counts, k, tables, False), k))
    if not counts:
        return found
    few = cut(asked.join(found.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti"))
    if few.isEmpty():
        return found
    again = _best(_searched(few, kinds, counts, k, tables, True), k)
    return found.join(few.select("query_id"), "query_id", "left_anti").unionByName(again)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _blocks(rows: DataFrame, v: str, size: int, n: str) -> DataFrame:
    """(d, n): into how many blocks of ``size`` bytes the vectors of each length go."""
    return rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("k")).select("d", F.expr(f"cast((k * d * 8) div {size} as int) + 1").alias(n))


def _searched(asked: DataFrame, kinds: DataFrame, counts: dict[int, dict[int, int]], k: int, tables: int, whole: bool) -> DataFrame:
    """(query_id, vec_id, score): of each query and block of vectors the ``k`` best rows among the candidates, or among all."""
    n = cut(_blocks(kinds, "v", BLOCK, "nd").join(_blocks(asked, "q", ASKED, "nq"), "d"))  # a row for each length

    def dealt(rows: DataFrame, name: str, v: str, own: str, other: str, i: str, j: str) -> DataFrame:
        rows = rows.withColumn("d", F.size(v)).join(n, "d")
        return rows.withColumn(i, F.pmod(F.xxhash64(name), F.col(own)).cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("nd", "nq")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, d = (np.array(t.column(c).combine_chunks().flatten()).reshape(t.num_rows, -1) for t, c in ((left, "q"), (right, "v")))
            names, ids = left.column("query_id").to_pylist(), right.column("ids").to_pylist()
            index = Index(d, right.column("span").to_numpy(), counts[d.shape[1]], tables, whole)
            for a in range(0, len(q), _CHUNK):
                out += _block_best(names[a : a + _CHUNK], q[a : a + _CHUNK], d, ids, index, k)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    left = dealt(asked, "query_id", "q", "nq", "nd", "j", "i").groupBy("d", "i", "j")
    right = dealt(kinds, "vec_id", "v", "nd", "nq", "i", "j").groupBy("d", "i", "j")
    return left.cogroup(right).applyInArrow(best, "query_id long, vec_id long, score double")


def _block_best(names: list[int], q: np.ndarray, d: np.ndarray, ids: list[list[int]], index: Index, k: int) -> list[tuple]:
    """(query's id, id, score) of the ``k`` best rows of a block for each query."""
    top = np.abs(q).max(axis=1, keepdims=True)
    u = q / top
    length = np.linalg.norm(u, axis=1, keepdims=True)
    directions = u / length
    rows: list[list[np.ndarray]] = [[] for _ in names]
    scores: list[list[np.ndarray]] = [[] for _ in names]
    least = np.full(len(names), -np.inf)
    for part, (members, most, _, _) in enumerate(index.parts):
        with np.errstate(over="ignore", invalid="ignore"):
            bound = (top * length)[:, 0] * most * (1 + 1e-9)
        todo = np.flatnonzero(~(bound < least))  # the others have k + 1 rows that no vector of this range can reach
        if not len(todo):
            continue
        flags = index.candidates(directions[todo], part)
        for x, t in enumerate(todo):
            near = members[flags[x]]
            if not len(near):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                s = d[near] @ q[t]
                if not np.isfinite(s).all():  # then the order of additions decides
                    s = _exact(d[near], q[t])
                    near, s = near[~np.isnan(s)], s[~np.isnan(s)]
            rows[t].append(near)
            scores[t].append(s)
            if part + 1 < len(index.parts):
                every = np.concatenate(scores[t])
                if len(every) > k:
                    rows[t], scores[t] = [np.concatenate(rows[t])], [every]
                    low = np.partition(every, len(every) - k - 1)[len(every) - k - 1]
                    least[t] = low - 1e-9 * abs(low) if np.isfinite(low) else -np.inf
    out = []
    for t, name in enumerate(names):
        if not rows[t]:
            continue
        near, s = np.concatenate(rows[t]), np.concatenate(scores[t])
        if len(s) > k + 1:  # all that may be among the k + 1 best once their terms are added in order
            low = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
            near = near[~(s < low - 1e-9 * abs(low) - 1e-300)] if np.isfinite(low) else near
        with np.errstate(over="ignore", invalid="ignore"):
            s = _exact(d[near], q[t])
        got = [(-x, i) for x, r in zip(s.tolist(), near.tolist()) for i in ids[r] if i != name]
        got.sort()
        out += [(name, i, -x) for x, i in got[:k]]
    return out
