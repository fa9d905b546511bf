"""Connected components of an edge table, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROWS as EDGES
from .common import cut, plain_plans, release, whole


def _least(pairs: DataFrame, parts: int) -> DataFrame:
    """(u, v, m): of every pair, and m the least of u and all that u is paired with."""
    if parts == 1:  # a node of very many pairs is in one task anyhow, and ``pairs`` are made once
        return pairs.withColumn("m", F.least(F.min("v").over(W.partitionBy("u")), "u"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Alternating large and small stars: each round shuffles the edges four times (or not at all, once they fit in one partition), and the number of
    rounds grows with the logarithm of the nodes. Every round is written to the shared folder; only its checksum comes to the driver. Null ends and
    loops are ignored; an empty table gives none. ``edges`` are read once, so they needn't be written before.

    parts: in how many files the edges are written first, where they are known to be few; else in as many as the shuffle has partitions.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(now.coalesce(parts) if parts else now)
    release(edges.sparkSession)
    with plain_plans(edges.sparkSession):
        now = _stars(now)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _stars(now: DataFrame) -> DataFrame:
    """Edges (u, v) of which every u points to the least node it can reach."""
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, parts = mark, mark[0] // EDGES + 1  # no round has more edges than the last
        now = whole(now, parts)
        both = whole(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), parts)
        large = _least(both, parts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = _least(large, parts)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(whole(small.where("u <> v"), parts).distinct().coalesce(parts))
    return whole(now, mark[0] // EDGES + 1)
