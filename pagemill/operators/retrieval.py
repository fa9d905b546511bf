"""Keyword search, chunks, hash embeddings and vector search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_text, empty_to_null, keyword_score, query_terms, snippet

#: Vectors of one block in a search of many queries.
BLOCK = 4096
#: Texts that are embedded at once, so that a task holds few of them as Python's strings.
EMBEDDED = 256


def keyword_search(records: DataFrame, query: str, limit: int = 10, record_type: str | None = None, page_bonus: bool = True, order: str = "record_id", total: bool = False) -> DataFrame:
    """score, record_id, record_type, page, snippet (and, if asked for, total: how many have a hit) of the best ``limit`` records with a hit.

    Searched are text, type and, of ``metadata`` (JSON, if there is such a column), classification, review_role and layout_class.
    Best: score, then smaller page, type, and ``order`` (the input's order). Map side only, but for the top rows and one count.
    """
    terms = query_terms(query)
    rows = records if record_type is None else records.where(F.col("record_type") == record_type)
    extra = [F.get_json_object("metadata", f"$.{n}") for n in ("classification", "review_role", "layout_class")] if "metadata" in records.columns else []
    rows = rows.withColumn("score", keyword_score("text", "record_type", extra, terms, page_bonus)).where("score > 0")
    page = F.coalesce("page", F.lit(0))
    top = rows.orderBy(F.desc("score"), page, F.coalesce("record_type", F.lit("")), order).limit(limit)
    found = top.select("score", "record_id", "record_type", page.alias("page"), snippet("text", terms).alias("snippet"))
    return found.withColumn("total", rows.agg(F.count("*")).scalar()) if total else found


def chunks(records: DataFrame, most: int = 1400) -> DataFrame:
    """The records' texts in chunks; chunk ids count from 0."""
    rows = records.select("*", F.posexplode(chunk_text("text", most)).alias("chunk_index", "chunk"))
    name = F.concat_ws("::", empty_to_null("record_id"), F.format_string("chunk%04d", "chunk_index"))
    return rows.withColumn("chunk_id", name).drop("text").withColumnRenamed("chunk", "text")


#: Tokens whose places a worker keeps; numbers of one block of counts.
KEPT, COUNTS = 500_000, 1 << 20


class _Places(dict):
    """Four bytes of a token's hash, and its sign as the lowest bit, by token; found at the first use."""

    def __missing__(self, token: str) -> int:
        digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
        self[token] = place = int.from_bytes(digest[:4], "big") * 2 + digest[4] % 2
        return place


_places = _Places()


def hash_embeddings(texts: list[str | None], dimensions: int) -> np.ndarray:
    """Signed counts of the hashes of space-parted tokens, each row of unit length (zeros for none)."""
    out = np.zeros((len(texts), dimensions))
    step = max(1, COUNTS // (2 * dimensions))
    for begin in range(0, len(texts), step):
        rows = [list(filter(None, (x or "").lower().replace("\n", " ").split(" "))) for x in texts[begin : begin + step]]
        if len(_places) >= KEPT:
            _places.clear()
        sizes = list(map(len, rows))
        places = np.fromiter(map(_places.__getitem__, chain.from_iterable(rows)), np.int64, sum(sizes))
        at = np.repeat(np.arange(len(rows)) * dimensions, sizes) + places // 2 % dimensions
        counts = np.bincount(at * 2 + places % 2, minlength=2 * dimensions * len(rows)).reshape(len(rows), dimensions, 2)
        signed = counts[:, :, 0] - counts[:, :, 1]
        norm = np.sqrt((signed * signed).sum(axis=1))  # of whole numbers, so exact up to the root
        out[begin : begin + step] = signed / np.where(norm > 0, norm, 1.0)[:, None]
    return out


def hash_embedding(text: str, dimensions: int) -> list[float]:
    """``hash_embeddings`` of one text."""
    return hash_embeddings([text], dimensions)[0].tolist()


class HashProvider:
    """An embedding provider: ``info``, ``embed`` and, for many texts at once, ``embed_all``. Any object with the first two can take its place."""

    def __init__(self, dimensions: int = 32):
        if dimensions <= 0:
            raise ValueError("dimensions must be positive")
        self.info = {"provider": "local", "model": "token-hash", "dimensions": dimensions, "fingerprint": f"token-hash-blake2b-{dimensions}"}

    def embed(self, text: str) -> list[float]:
        return hash_embedding(text, self.info["dimensions"])

    def embed_all(self, texts: list[str]) -> np.ndarray:
        return hash_embeddings(texts, self.info["dimensions"])


def embedding(text: Column | str, provider) -> Column:
    """``provider.embed`` of a column, in Arrow batches; ``provider.embed_all`` where there is one."""
    every = getattr(provider, "embed_all", None)
    embed: Callable[[str], list[float]] = provider.embed

    if every is None:

        @F.pandas_udf("array<double>")
        def go(s: pd.Series) -> pd.Series:
            return s.fillna("").map(embed)

    else:

        @F.arrow_udf("array<double>")
        def go(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([part(texts.slice(i, EMBEDDED)) for i in range(0, max(len(texts), 1), EMBEDDED)])

        def part(texts: pa.Array) -> pa.Array:
            made = np.asarray(every([x or "" for x in texts.to_pylist()]), np.float64)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))

    return go(text)


def vector_index(records: DataFrame, provider, most: int = 1400) -> DataFrame:
    """Chunks with embedding and its norm, so that a search computes no norm."""
    rows = chunks(records, most).withColumn("embedding", embedding("text", provider))
    return rows.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).withColumn("fingerprint", F.lit(provider.info["fingerprint"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm: Column | None = None) -> Column:
    """0 if a norm is 0; other lengths are an error. norm: that of ``a``, where it is known."""
    na, nb = F.sqrt(dot(a, a)) if norm is None else norm, F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def vector_top(rows: DataFrame, query: list[float], limit: int, key: str, vector: str = "embedding") -> DataFrame:
    """The ``limit`` rows nearest by cosine; ties by ``key``. The query is a literal, so the scan has no join; a column norm is used."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = F.col("norm") if "norm" in rows.columns else None
    return rows.withColumn("score", cosine(F.col(vector).cast("array<double>"), q, norm)).orderBy(F.desc("score"), key).limit(limit)


def vector_search(index: DataFrame, query: str, provider, limit: int = 10) -> DataFrame:
    """score (six digits), chunk_id, record_id, text of the chunks nearest to ``query``."""
    if not query.strip():
        raise ValueError("an empty query")
    return vector_top(index, provider.embed(query), limit, "chunk_id").select(F.round("score", 6).alias("score"), "chunk_id", "record_id", "text")


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Every row of ``a`` with every row of ``b``, added up in the order of ``dot``."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += x[:, None] * y
    return out


def _squares(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x in a.T:
        out += x * x
    return out


def _six_digits(x: np.ndarray) -> np.ndarray:
    """As SQL rounds: half away from zero of the decimal value."""
    y = np.abs(x) * 1e6
    out = np.sign(x) * np.floor(y + 0.5) / 1e6
    for i in zip(*np.nonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4), strict=True):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0


def nearest_pairs(rows: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: each query's nearest other rows by cosine; a vector that is null or holds a null scores null, which is last.

    Rows and queries meet in blocks, each of which gives ``limit`` rows a query; no side is broadcast.
    """
    from pyspark.sql import Window as W

    def dealt(df: DataFrame, mine: str, other: str, others: int) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        whole = F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False))
        one = df.select(F.col(key).cast("long").alias("id"), F.when(whole, v).alias("v"))
        return one.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n[mine] // BLOCK))))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, -(-others // BLOCK) - 1)).cast("long"))))

    n = {"i": rows.count(), "j": queries.count()}
    left, right = dealt(queries, "j", "i", n["i"]), dealt(rows, "i", "j", n["j"])

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
        good = pc.is_valid(t.column("v")).to_numpy().astype(bool)
        return t.column("id").to_numpy(), good, t.column("v").to_pylist()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        (qi, qg, q), (di, dg, d) = read(left), read(right)
        out = [[], [], []]
        lengths = {len(x) for x in [*q, *d] if x is not None}
        if len(lengths) > 1 and qg.any() and dg.any():
            raise ValueError("vectors of different lengths")
        zero = [0.0] * max(lengths, default=1)
        d = np.array([zero if x is None else x for x in d], float).reshape(len(di), -1)
        for a in range(0, len(qi) if len(di) else 0, 64):
            part, good = qi[a : a + 64], qg[a : a + 64, None] & dg
            x = np.array([zero if v is None else v for v in q[a : a + 64]], float)
            norms = np.sqrt(_squares(x))[:, None], np.sqrt(_squares(d))
            with np.errstate(all="ignore"):
                score = np.where((norms[0] == 0) | (norms[1] == 0), 0.0, _dots(x, d) / (norms[0] * norms[1]))
            score = _six_digits(score)
            rank = np.where(good, np.where(np.isnan(score), np.inf, score), -np.inf)
            for i, own in enumerate(part):
                others = np.flatnonzero(di != own)
                top = others[np.lexsort((di[others], -rank[i, others]))[:limit]]
                out[0] += [own] * len(top)
                out[1] += di[top].tolist()
                out[2] += [float(s) if g else None for s, g in zip(score[i, top], good[i, top], strict=True)]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "query_id long, id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
