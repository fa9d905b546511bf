"""One-permutation MinHash fingerprints (operator 4).

Every shingle is hashed once; the hash's top bits name one of ``bins`` bins and the rest compete for its minimum. An
empty bin takes the value of the first filled bin in its own fixed random order of all bins (optimal densification: the
same order for every document, so two sets' empty bins agree as often as the sets do). Of each value ``bits`` low bits
are packed. Two unrelated values agree by chance once in 2**bits; ``likeness`` takes that out of the share of equal bins.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, scan_bytes, shingles, utf8

BINS, BITS = 512, 4
#: Ranges of doc_id at most; beyond, they grow with the table, and a task streams through its own.
RANGES = 1 << 14
_SMALL = 1 << 20


@cache
def probe_orders(bins: int) -> np.ndarray:
    """Of each bin, all bins in a random order fixed for ever."""
    rng = np.random.Generator(np.random.PCG64(20170814))
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)


def densified(rows: np.ndarray, hashes: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """(n, bins) values from the rows' shingle hashes; a row without any is all 0."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    none = np.uint64((1 << 64) - 1)
    values = np.full(n * bins, none, np.uint64)
    place = rows * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(values, place, hashes & np.uint64((1 << int(shift)) - 1))
    values = values.reshape(n, bins)
    filled = values != none
    source = values.copy()
    some = filled.any(axis=1)
    row, bin_ = np.nonzero(~filled & some[:, None])
    orders = probe_orders(bins)
    for attempt in range(bins):
        if not len(row):
            break
        other = orders[bin_, attempt]
        hit = filled[row, other]
        values[row[hit], bin_[hit]] = source[row[hit], other[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    values[~some] = 0
    return values


def low_bits(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of each value hashed with its bin, so that one value copied to many bins isn't one chance many times."""
    bins = mix(np.arange(1, values.shape[1] + 1, dtype=np.uint64))
    return np.where(values > 0, mix(values ^ bins) & np.uint64((1 << bits) - 1), 0).astype(np.uint8)


def packed(low: np.ndarray, bits: int = BITS) -> list[str]:
    """Base64 of each row's low bits in a row, most significant first."""
    spread = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :]
    return [base64.b64encode(x.tobytes()).decode() for x in np.packbits(spread.reshape(len(low), -1), axis=1)]


def unpacked(fingerprint: str, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    raw = np.unpackbits(np.frombuffer(base64.b64decode(fingerprint), np.uint8))[: bins * bits].reshape(bins, bits)
    return (raw * (1 << np.arange(bits)[::-1])).sum(axis=1).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The estimated Jaccard likeness, 0 to 1, of rows of low bits; chance agreement is taken out."""
    by_chance = 0.5**bits
    return np.clip(((a == b).mean(axis=-1) - by_chance) / (1 - by_chance), 0.0, 1.0)


def text_low_bits(texts: list[str]) -> np.ndarray:
    data, at = utf8(pa.array(texts, pa.large_string()))
    return low_bits(densified(*shingles(data, at), len(texts)))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning, as long, of ``following`` (by all of it, if shorter)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _range_of(value: Column, edges: list[int]) -> Column:
    """How many of the ascending ``edges`` are at most ``value`` (none for a null), by binary search."""
    if not edges:
        return F.lit(0)
    steps = ",".join(str(1 << k) for k in reversed(range(len(edges).bit_length())))
    found = F.expr(f"array({steps})")
    listed = F.lit(edges).cast("array<bigint>")
    return F.aggregate(found, F.lit(0), lambda k, step: k + F.when((k + step <= len(edges)) & (F.get(listed, k + step - 1) <= value), step).otherwise(0))


def fingerprints(docs: DataFrame, part_bytes: int = 16 << 20) -> DataFrame:
    """One row of ``OUT`` a document, whose next one is that with the next larger doc_id (after the last, the first).

    docs: doc_id, text; other columns are ignored. A null text is empty, a null doc_id comes first, rows of equal id follow
    one another by the text's hash. Of a single document the next one is itself. A text without words has a fingerprint
    of zeros, and likeness 1 to another such text, 0 to any other.

    Texts move once: by ranges of doc_id, and within one task in order. The first row of every range is also sent to the
    range before it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", F.xxhash64("text")]
    n = min(RANGES, max(1, -(-scan_bytes(rows) // part_bytes)))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    edges = ids.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("e")).first().e if n > 1 else []
    part = _range_of(F.col("doc_id"), sorted(set(edges or [])))
    firsts = ids.withColumn("part", part).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"))
    firsts = [(r.part, r["first"].doc_id) for r in firsts.orderBy("part").collect()]  # one row a range, ``RANGES`` at most
    # the first row of each range goes to the range before it as well, as its end
    where = spark.createDataFrame([(f is None, f or 0, firsts[k - 1][0]) for k, (_, f) in enumerate(firsts)], "null_id boolean, first long, to int")
    placed = rows.withColumn("part", part)
    first_rows = placed.join(F.broadcast(where), F.col("doc_id").eqNullSafe(F.when(~F.col("null_id"), F.col("first"))))
    first_rows = first_rows.withColumn("h", F.xxhash64("text")).select("doc_id", "text", "to", "h")
    ends = first_rows.groupBy("to", "doc_id").agg(F.min_by("text", "h").alias("text")).selectExpr("doc_id", "text", "to as part", "true as end")
    both = placed.select("doc_id", "text", "part", F.lit(False).alias("end")).unionByName(ends)
    dealt = both.repartitionById(n, F.col("part"))
    dealt = dealt.sortWithinPartitions("part", "end", *order).select("doc_id", "text", "end")

    def batches_of(batches):
        held: tuple | None = None  # a row whose next one isn't known yet: id, text, low bits
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_ids, texts, ends_ = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < _SMALL):
                    size += len(texts[j])
                    j += 1
                low = text_low_bits(texts[i:j])
                group = [] if held is None else [held]
                group += list(zip(doc_ids[i:j], texts[i:j], low, ends_[i:j], strict=True))
                if out := _pairs(group):
                    yield out
                held, i = group[-1], j

    return dealt.mapInArrow(batches_of, OUT)


def _pairs(group: list[tuple]) -> pa.RecordBatch | None:
    """A row for each of ``group`` but the last, and but the copies that end a range."""
    pairs = [(a, b) for a, b in zip(group, group[1:]) if not a[3]]
    if not pairs:
        return None
    changed = [edited(a[1], b[1]) for a, b in pairs]
    low, low_edited = np.stack([a[2] for a, _ in pairs]), text_low_bits(changed)
    near_next = likeness(low, np.stack([b[2] for _, b in pairs]))
    columns = [
        pa.array([a[0] for a, _ in pairs], pa.int64()),
        pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
        pa.array(packed(low)),
        pa.array(packed(low_edited)),
        pa.array(likeness(low, low_edited)),
        pa.array(near_next),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])
