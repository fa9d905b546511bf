"""Harmonic packing (operator 8): documents in sequences of a fixed capacity, each task by itself.

A piece of length x is in class j = capacity // x, and a bin of class j takes j pieces, whatever their exact lengths: a
worker keeps one open bin for each class and never looks at another. What a class's bins leave unused is capacity - j*x,
so a piece that would leave more than ``slack`` of its length is cut at capacity // (j+1), which fills a bin of the
next class. The pieces in bins still open at a task's end are laid end to end and cut anew into full sequences; the rest
goes to sequences whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_KIND = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
#: Sequence ids of a task begin at its partition's number times this.
SEQUENCES = 1 << 36
WIDTH = 4


def lengths(n: int, capacity: int, slack: float) -> list[int]:
    """The pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if capacity / j - rest <= slack * rest or rest * 32 <= capacity:
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= out[-1]
    return out


class Packer:
    """Takes documents as packed ids of ``WIDTH`` bytes each."""

    def __init__(self, first_sequence: int, capacity: int, slack: float):
        self.next, self.capacity, self.slack = first_sequence, capacity, slack
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []
        self.cuts: dict[int, list[int]] = {}  # the pieces of what is left of a document after whole sequences, by its length

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            length = len(ids) // WIDTH
            self.rows.append((doc_id, start, length, crc32(ids), n, self.next, offset))
            offset += length
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        start, n = 0, len(ids) // WIDTH
        rest = n % self.capacity
        if rest not in self.cuts:
            self.cuts[rest] = lengths(rest, self.capacity, self.slack)
        for x in [self.capacity] * (n // self.capacity) + self.cuts[rest]:
            piece = (doc_id, start, ids[start * WIDTH : (start + x) * WIDTH], n)
            start += x
            j = self.capacity // x
            if j == 1:
                self.close([piece])
                continue
            bin_ = self.open.setdefault(j, [])
            bin_.append(piece)
            if len(bin_) == j:
                self.close(self.open.pop(j))

    def finish(self) -> None:
        left = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        total = sum(len(p[2]) for p in left) // WIDTH
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << k for k in reversed(range(self.capacity.bit_length())) if (total % self.capacity) >> k & 1]
        i = at = 0
        for size in sizes:
            pieces = []
            while size:
                doc_id, start, ids, n = left[i]
                part = ids[at * WIDTH : (at + size) * WIDTH]
                pieces.append((doc_id, start + at, part, n))
                taken = len(part) // WIDTH
                size, at = size - taken, at + taken
                if at * WIDTH == len(ids):
                    i, at = i + 1, 0
            self.close(pieces)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, slack: float = 1 / 64) -> DataFrame:
    """Rows of ``SCHEMA``, one for each piece; every id of every document lies in exactly one.

    docs: doc_id, text; other columns are ignored. A null text is empty and gives ``end_id`` alone; an equal row is packed
    again. No row moves between tasks. Sequence ids are unique, not without gaps, and follow the input's splits.
    """

    def packed(batches):
        encode = encoder(tokenizer, "<u4")
        end = end_id.to_bytes(WIDTH, "little")
        packer = Packer(TaskContext.get().partitionId() * SEQUENCES, capacity, slack)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, encode(text.as_py() or "") + end)
                if len(packer.rows) > 5000:
                    yield _rows(packer)
        packer.finish()
        if packer.rows:
            yield _rows(packer)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)


def _rows(packer: Packer) -> pa.RecordBatch:
    rows, packer.rows = packer.rows, []
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_KIND)
