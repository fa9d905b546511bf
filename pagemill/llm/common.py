"""What the operators of this subpackage share: inputs, the shared folder, and hashing of words in Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a session on one machine gets a temporary folder once; any other is refused, as its executors
    could not see such a folder.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{jsc.getCheckpointDir().get()}/{uuid.uuid4().hex}"


_libc = ctypes.CDLL(None)
#: Seconds between releases by ``cut``; when the last one was.
RELEASE_S = 0.5
_released = [0.0]
#: Bytes of an Arrow batch while this subpackage runs an action of its own.
BATCH = 4 << 20


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """Arrow batches of ``BATCH`` bytes at most within; the session's own setting is as it was after."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")


def plain_plans(spark: SparkSession):
    """Plans that aren't changed while they run, within: for loops of many small steps, in which each exchange of an adaptive plan would take the
    driver a thread for a minute."""
    return _set(spark, "spark.sql.adaptive.enabled", "false")


#: Rows of a partition of a written table of few columns.
ROWS = 500_000


def whole(df: DataFrame, parts: int) -> DataFrame:
    """``df``, a written table or steps on such ones, in one partition if ``parts`` (its rows by ``ROWS``, rounded up) is 1: grouping and joining such
    tables then needs no shuffle, of which each would be as many tasks for the driver as the session's shuffles have partitions."""
    return df.coalesce(1) if parts == 1 else df


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and goes on from there: lineage ends, lost executors cost nothing.

    What the lineage held is released, if the last release is some seconds ago.
    """
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        out = df.checkpoint()
    if time.monotonic() - _released[0] > RELEASE_S:
        release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of lineages cut so far; else they stay on the executors' disks until the driver next collects."""
    _released[0] = time.monotonic()
    gc.collect()  # frames that nothing refers to any more still hold their plans
    trim()  # what training has freed
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def scan_bytes(df: DataFrame) -> int:
    """The size of the files that ``df`` scans, all columns; where it comes from elsewhere or from a join, that of its texts (a scan)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if leaves.size() == 1 and (size := int(str(leaves.apply(0).stats().sizeInBytes()))) < 1 << 55:
        return size
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket5(doc_id):
    """crc32 of the id as text, modulo 5: rows with 0 are held out of training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


# --- words of UTF-8 buffers -------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply and shift-xor, twice)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
#: The low bytes of an eight-byte number, by their count.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Spans longer than this are hashed one by one.
_LONG = 256


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins (one more: the end); null is empty."""
    a = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every run of bytes other than ``[\\x20\\x09-\\x0D]``."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = at[:-1][at[:-1] < at[1:]]
    first[edge] = solid[edge]
    edge = at[1:][at[:-1] < at[1:]] - 1
    last[edge] = solid[edge]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(at, begin, "right") - 1


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on (A-Z as a-z, zeros after the end) as one little-endian number; a view."""
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=padded[: len(data)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def spans_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, A-Z as a-z: eight bytes after eight, each mixed with all before."""
    size = end - begin
    out = mix(size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(0x9E3779B97F4A7C15))
    eight = eights(data)
    live = np.flatnonzero(size <= _LONG)
    at, left, h = begin[live], size[live], out[live]
    while len(live):
        h = mix(h ^ (eight[at] & FIRST[np.minimum(left, 8)]))
        out[live] = h
        more = np.flatnonzero(left > 8)
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(_LOWER[data[begin[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    return out


_TURN = mix(np.arange(101, 101 + SHINGLE, dtype=_U)) | _U(1)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of five words, A-Z lower-cased; of fewer words, the one whole sequence. In row order."""
    begin, end, row = words(data, at)
    h = spans_hash(data, begin, end)
    n = len(h)
    rows, out = [], []
    if n >= SHINGLE:
        s = np.zeros(n - SHINGLE + 1, _U)
        for k in range(SHINGLE):
            s += h[k : n - SHINGLE + 1 + k] * _TURN[k]
        whole = row[: n - SHINGLE + 1] == row[SHINGLE - 1 :]
        rows.append(row[: n - SHINGLE + 1][whole])
        out.append(mix(s[whole]))
    if n:
        count = np.bincount(row, minlength=len(at) - 1)
        first = np.searchsorted(row, np.arange(len(at) - 1))
        for m in range(1, SHINGLE):
            short = np.flatnonzero(count == m)
            if len(short):
                s = np.full(len(short), m, _U)
                for k in range(m):
                    s += h[first[short] + k] * _TURN[k]
                rows.append(short)
                out.append(mix(mix(s)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    rows, out = np.concatenate(rows), np.concatenate(out)
    order = np.argsort(rows, kind="stable")
    return rows[order], out[order]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Parts of ``batch`` with about ``most`` bytes of ``column`` each, at least one row."""
    data, at = utf8(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def text_slices(texts: list[str], most: int = 2 << 20):
    """The bytes of ``texts`` and where each begins, about ``most`` bytes at a time."""
    i = 0
    while i < len(texts):
        parts, size = [], 0
        while i < len(texts) and (not parts or size < most):
            parts.append(texts[i].encode())
            size += len(parts[-1])
            i += 1
        yield np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
