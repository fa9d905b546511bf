"""Centroid clustering (operator 11): Lloyd's rounds over integer vectors, exact at every magnitude.

Vectors are quantized to integers and lie in blocks of rows, each a matrix of doubles, which hold these integers exactly. Squared distances
to all centroids come from |x|^2 - 2 x.c + |c|^2 by one matrix product a block. Where ``d (|x| + |c|)^2`` (largest components) is below 2^53
every sum on the way is an integer that a double holds, whatever the order of the additions; rows beyond that bound take 64-bit
integers, rows beyond 2^63 Python's. Counts and sums of each cluster meet by the RDD's treeAggregate; the driver sees one such sum a round.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CLUSTERS, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
#: Rows of a block.
BLOCK = 4096
#: The largest sum that a double, or a long, holds with all integers below it.
DOUBLE, LONG = 2**53 - 1, 2**63 - 1

OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantized(x: float, scale: int = SCALE) -> int:
    """floor(scale * x) of one double, also where the product is beyond all doubles. scale: a power of two."""
    return math.floor(y) if math.isfinite(y := x * scale) else int(x) * scale


def distances(x: np.ndarray, centroids: list[list[int]], scale: int = SCALE):
    """Of some rows of ``x`` at a time: (their numbers, their integers, squared distances to all centroids), each exact.

    x: doubles before quantization. The integers are doubles, longs or Python's, as the rows' magnitude asks.
    """
    n, d = x.shape
    with np.errstate(over="ignore"):
        q = np.floor(x * scale)
    most = np.abs(q).max(axis=1, initial=0)
    far = max((abs(v) for c in centroids for v in c), default=0)
    of = [math.isqrt(limit // d) - far for limit in (DOUBLE, LONG)]
    small = most <= max(of[0], -1)
    middle = ~small & (most <= max(min(of[1], DOUBLE), -1))
    if len(rows := np.flatnonzero(small)):
        a, c = q[rows], np.array(centroids, np.float64)
        yield rows, a, np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    if len(rows := np.flatnonzero(middle)):
        a, c = q[rows].astype(np.int64), np.array(centroids, np.int64)
        yield rows, a, np.stack([np.square(a - v).sum(axis=1) for v in c], axis=1)
    for i in np.flatnonzero(~small & ~middle):
        a = np.array([[quantized(float(v), scale) for v in x[i]]], object)
        yield np.array([i]), a, np.array([[sum((int(v) - w) ** 2 for v, w in zip(a[0], c)) for c in centroids]], object)


def _summed(x: np.ndarray, centroids: list[list[int]], scale: int, totals: list[list]) -> list[list]:
    """Adds to each cluster's [rows, componentwise sum, sum of distances] those of a block, as Python integers."""
    for _, a, far in distances(x, centroids, scale):
        near = far.argmin(axis=1)
        for k in np.unique(near):
            rows, t = near == k, totals[k]
            t[0] += int(rows.sum())
            t[1] = [v + int(w) for v, w in zip(t[1], a[rows].sum(axis=0))]  # of at most BLOCK rows of either magnitude: exact
            t[2] += int(far[rows, k].astype(object).sum())
    return totals


def _joined(a: list[list], b: list[list]) -> list[list]:
    return [[n + m, [v + w for v, w in zip(s, t)], e + f] for (n, s, e), (m, t, f) in zip(a, b)]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = 3) -> DataFrame:
    """``OUT`` of every row of ``vectors`` (vec_id, embedding; others are ignored) with exactly ``width`` components, none null or not finite.

    Components count as floor(scale * x). Centroids start as the k rows with the least SHA-256 of ``seed:vec_id``; ties go to the lesser
    vector, a null id comes last. Each of ``rounds`` assigns every row to the nearest centroid (the smaller number of several) and moves
    every centroid with rows to the floor of their mean; those without stay. Fewer than k rows give as many centroids, no row none.
    Repeated rows count each time. A distance or sum beyond a long is null.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == width)
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    first = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "v").limit(k)
    centroids = [[quantized(x, scale) for x in r.v] for r in first.select("v").collect()]

    def blocks(batches):
        for batch in batches:
            v = batch.column("v")
            for at in range(0, batch.num_rows, BLOCK):
                part = v.slice(at, BLOCK)
                x = part.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("vec_id").slice(at, BLOCK).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    whole = cut(rows.mapInArrow(blocks, "ids array<long>, x binary"))
    if not centroids:
        return spark.createDataFrame([], OUT)
    matrices = whole.select("x").rdd.map(lambda r: np.frombuffer(r.x).reshape(-1, width))

    def totals() -> list[list]:
        now = centroids  # the function below must not see later ones
        zero = [[0, [0] * width, 0] for _ in now]
        return matrices.treeAggregate(zero, lambda t, x: _summed(x, now, scale, t), _joined)

    for _ in range(rounds):
        centroids = [[v // n for v in s] if n else c for c, (n, s, _) in zip(centroids, totals())]
    inertia = [e for _, _, e in totals()]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    now = centroids

    def long(v: int) -> int | None:
        return v if v <= LONG else None

    def assigned(batches):
        for batch in batches:
            for ids, x in zip(batch.column("ids"), batch.column("x")):
                m = np.frombuffer(x.as_py()).reshape(-1, width)
                near, at = np.zeros(len(m), np.int64), [None] * len(m)
                for some, _, far in distances(m, now, scale):
                    near[some] = best = far.argmin(axis=1)
                    for i, e in zip(some.tolist(), far[np.arange(len(some)), best].tolist()):
                        at[i] = long(int(e))
                of = [pa.array([long(inertia[c]) for c in near], pa.int64()), pa.array([long(sum(inertia))] * len(m), pa.int64()), pa.array([names[c] for c in near])]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(near.astype(np.int32)), pa.array(at, pa.int64()), *of], [c.split()[0] for c in OUT.split(", ")])

    return whole.mapInArrow(assigned, OUT)
