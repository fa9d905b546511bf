"""Token-ID output (operator 2): sorted-string-table shards of encoded documents.

Documents are dealt by ranges of their id, sorted, encoded and written as one file a range by Spark's own committer, so
a lost executor leaves no half file. A shard is, in a row, each part followed by one 0x0A:

- data blocks: ``<u4 raw length><u4 entries>``, zstd of the entries, ``<u4 crc32 of all before>``. Of an entry: varint length of the
  prefix that its key shares with the key before (0 at a block's begin), varint length of the rest, varint length of the
  value, the rest of the key, the value (ids, 2 or 4 bytes each, little-endian). A key has 9 bytes: 0 for a null id or
  1, then the id big-endian with its sign bit flipped, so that bytes sort as ids do.
- the sparse index: for each block its first key, ``<u8 offset><u4 length>``;
- a Bloom filter of the keys (ten bits each, seven probes);
- the footer: see ``FOOTER``.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, scan_bytes, shared_dir, small_batches
from .encoding import encoder

MAGIC = b"PMSST\x00\x01\n"
#: entries, ids, bytes of an id, index offset, index length, filter offset, filter length, crc32 of index and filter, magic
FOOTER = struct.Struct("<QQBQIQII8s")
ENTRY = struct.Struct("<9sQI")
PROBES, BITS = 7, 10


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" + bytes(8) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The probed bits of each key (an unsigned 64-bit number), by double hashing."""
    a = mix(keys)
    b = mix(a) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def key_number(key: bytes) -> int:
    return struct.unpack(">Q", key[1:])[0] ^ (0 if key[0] else 0x5BD1E995)


class ShardWriter:
    """Takes (id, packed ids) in ascending order of id and gives the parts of a shard, one at a time."""

    def __init__(self, width: int, block: int = 1 << 16):
        self.width, self.block = width, block
        self.raw, self.n, self.first, self.last = bytearray(), 0, b"", b""
        self.index, self.keys, self.at, self.ids = [], [], 0, 0

    def part(self, data: bytes) -> bytes:
        self.at += len(data) + 1  # the sink ends every part with a line feed
        return data

    def add(self, doc_id: int | None, value: bytes):
        key = key_of(doc_id)
        shared = 0
        if self.n:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.raw += varint(shared) + varint(9 - shared) + varint(len(value)) + key[shared:] + value
        self.n, self.last = self.n + 1, key
        self.keys.append(key_number(key))
        self.ids += len(value) // self.width
        if len(self.raw) >= self.block:
            yield self.flush()

    def flush(self) -> bytes:
        packed = struct.pack("<II", len(self.raw), self.n) + pa.compress(bytes(self.raw), codec="zstd", asbytes=True)
        packed += struct.pack("<I", zlib.crc32(packed))
        self.index.append(ENTRY.pack(self.first, self.at, len(packed)))
        self.raw, self.n = bytearray(), 0
        return self.part(packed)

    def close(self):
        if self.n:
            yield self.flush()
        index = b"".join(self.index)
        bits = max(64, (BITS * len(self.keys) + 7) // 8 * 8)
        filled = np.zeros(bits, bool)
        for i in range(0, len(self.keys), 1 << 16):
            filled[bloom_places(np.array(self.keys[i : i + (1 << 16)], np.uint64), bits)] = True
        bloom = np.packbits(filled, bitorder="little").tobytes()
        index_at = self.at
        yield self.part(index)
        bloom_at = self.at
        yield self.part(bloom)
        yield self.part(FOOTER.pack(len(self.keys), self.ids, self.width, index_at, len(index), bloom_at, len(bloom), zlib.crc32(index + bloom), MAGIC))


class Shard:
    """Reads a shard's bytes: all entries in order, or one by binary search."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.n, self.ids, self.width, at, size, bloom_at, bloom_size, crc, magic = FOOTER.unpack(self.data[-FOOTER.size - 1 : -1])
        index, self.bloom = bytes(self.data[at : at + size]), bytes(self.data[bloom_at : bloom_at + bloom_size])
        if magic != MAGIC or crc != zlib.crc32(index + self.bloom):
            raise ValueError("not a whole shard")
        self.index = list(ENTRY.iter_unpack(index))

    def block(self, offset: int, size: int):
        part = self.data[offset : offset + size]
        if zlib.crc32(part[:-4]) != struct.unpack("<I", part[-4:])[0]:
            raise ValueError(f"the block at {offset} is damaged")
        raw_size, n = struct.unpack("<II", part[:8])
        raw = pa.decompress(part[8:-4], decompressed_size=raw_size, codec="zstd", asbytes=True)
        at, key = 0, b""
        for _ in range(n):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            length, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + length]
            at += length

    def __iter__(self):
        for _, offset, size in self.index:
            for key, value in self.block(offset, size):
                yield id_of(key), value

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key; none if there is none."""
        key = key_of(doc_id)
        places = bloom_places(np.array([key_number(key)], np.uint64), len(self.bloom) * 8)[0]
        if not all(self.bloom[int(p) >> 3] >> (int(p) & 7) & 1 for p in places):
            return []
        firsts = [x[0] for x in self.index]
        i = max(0, bisect_right(firsts, key) - 1)
        while i and firsts[i] == key:  # a key that occurs again may begin in the block before
            i -= 1
        found = []
        while i < len(firsts) and firsts[i] <= key:
            found += [np.frombuffer(v, f"<u{self.width}") for k, v in self.block(*self.index[i][1:]) if k == key]
            i += 1
        return found


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, width: int = 2, shard_bytes: int = 16 << 20) -> None:
    """Encodes every text and writes the shards to ``path``.

    docs: doc_id, text; other columns are ignored. A null text is empty; a document's ids end with ``end_id``; a null
    doc_id sorts first; rows with equal ids are all kept. An empty table gives no shard. ``width``: bytes of an id.
    ``shard_bytes``: input bytes of a shard.
    """
    spark = docs.sparkSession
    end = end_id.to_bytes(width, "little")

    def shard(batches):
        encode, out = encoder(tokenizer, f"<u{width}"), ShardWriter(width)
        parts = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts += out.add(doc_id, encode(text.as_py() or "") + end)
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["part"])
                parts = []
        if out.keys:
            for part in out.close():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], ["part"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = max(1, -(-scan_bytes(rows) // shard_bytes))
    # ties are broken by the text's hash and the row's place, so that rows of one id spread over ranges, too
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("k", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, "doc_id", "h", "k").sortWithinPartitions("doc_id", "h", "k").select("doc_id", "text")
    with small_batches(spark):
        rows.mapInArrow(shard, "part binary").select(F.col("part").cast("string")).write.text(path)


ENTRIES = "shard long, at long, doc_id long, ids binary, width int"
SUMS = "shard long, at long, doc_id long, n_tokens long, ids_crc32 long"


def read_shards(spark: SparkSession, path: str, sums: bool = False) -> DataFrame:
    """``ENTRIES`` of every entry: the shard's number, the entry's place in it (ids before it), packed ids and their width.

    With ``sums``, ``SUMS``: number and crc32 (as little-endian 32-bit integers) in place of the ids. One shard is held at a time.
    """

    def entries(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_buffer())
                rows, size, at = [], 0, 0
                for doc_id, value in shard:
                    n = len(value) // shard.width
                    if sums:
                        rows.append((number, at, doc_id, n, zlib.crc32(np.frombuffer(value, f"<u{shard.width}").astype("<u4").tobytes())))
                    else:
                        rows.append((number, at, doc_id, value, shard.width))
                    size, at = size + (64 if sums else len(value)), at + n
                    if size > 1 << 21:
                        yield _batch(rows, kinds)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, kinds)

    names = [x.split() for x in (SUMS if sums else ENTRIES).split(", ")]
    kinds = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]) for name, kind in names])
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    files = files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("shard"), "content")
    return files.mapInArrow(entries, SUMS if sums else ENTRIES)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def token_spans(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the shards, reads them back and gives of each document doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/shards"
    write_shards(docs, path, tokenizer, end_id)
    rows = cut(read_shards(spark, path, sums=True))
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))  # one row a file
    base = totals.select("shard", F.expr("sum(total) over (order by shard) - total").alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
