"""Folds whose outcome depends on the order of a page's boxes, streamed: a task sorts its groups and passes over them once.

Each holds only what later rows can still reach: the matches of one cluster of positions, the rows of boxes near the current height.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def streamed(rows: DataFrame, by: list[str], order: list, fold: Callable[[Iterator[tuple]], Iterator[tuple]], out: str) -> DataFrame:
    """What ``fold`` makes of the rows of each group, in order. Groups are dealt by hash; of each the rows come as they are needed."""
    kind = StructType.fromDDL(out)
    ordered = rows.repartition(*by).sortWithinPartitions(*by, *order)
    size, names = len(by), rows.columns
    places = [names.index(b) for b in by]

    def run(batches):
        schema = to_arrow_schema(kind)

        def every():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        stream, held = every(), []
        ahead = next(stream, None)
        while ahead is not None:
            key = tuple(ahead[p] for p in places)

            def group(key=key):
                nonlocal ahead
                while ahead is not None and tuple(ahead[p] for p in places) == key:
                    row, ahead = ahead, next(stream, None)
                    yield row

            mine = group()
            for row in fold(mine):
                held.append((*key, *row))
                if len(held) >= 10_000:
                    yield _batch(held, schema)
                    held = []
            for _ in mine:  # what the fold has left
                pass
        if held:
            yield _batch(held, schema)

    assert [f.name for f in kind][:size] == by
    return ordered.mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Free:
    """Spans that aren't taken yet, by place; those at one place go in order."""

    def __init__(self, spans: list[tuple[float, int]]):
        self.at, self.waiting = [], []
        for x, span in sorted(spans):
            if not self.at or self.at[-1] != x:
                self.at.append(x)
                self.waiting.append([])
            self.waiting[-1].append(span)
        for w in self.waiting:
            w.reverse()  # the first is at the end
        n = len(self.at)
        self.left, self.right = list(range(n + 1)), list(range(n + 1))  # nearest place with spans; 0 and n: none

    @staticmethod
    def _find(up: list[int], i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def nearest(self, x: float) -> tuple[float, int, int] | None:
        """(distance, span, number of its place) of the nearest span; the first in order of several."""
        i, n, best = bisect.bisect_left(self.at, x), len(self.at), None
        for up, j, step, stop in ((self.right, i, 1, n), (self.left, i, -1, 0)):
            near = None
            while True:
                j = self._find(up, j)
                if j == stop:
                    break
                place = j if step > 0 else j - 1
                away = abs(self.at[place] - x)
                if near is not None and away > near:
                    break
                near = away
                found = (away, self.waiting[place][-1], place)
                best = found if best is None else min(best, found)
                j += step
        return best

    def take(self, place: int) -> None:
        self.waiting[place].pop()
        if not self.waiting[place]:
            self.right[place] = place + 1
            self.left[place + 1] = place


def cluster_matches(texts: list[tuple[int, float]], spans: list[tuple[float, int]], most: float) -> Iterator[tuple[int, int, float]]:
    """(id, span, distance): texts (id, x) in order of id, each with the nearest span (x, span) that none before has taken."""
    free = Free(spans)
    for i, x in sorted(texts):
        best = free.nearest(x)
        if best is not None and best[0] <= most:
            free.take(best[2])
            yield i, best[1], best[0]


def matches(texts: DataFrame, spans: DataFrame, most: float) -> DataFrame:
    """(page, id, span, away): texts (page, id, text, x) in order of id, each with the nearest span (page, ord, text, x) of equal text that no
    text before has taken, at most ``most`` away; of several the first. Rows without page, text or place match nothing.

    Along a page's places, what lies more than ``most`` from its neighbours is apart, so only one such cluster of one wording is in
    memory; each of its texts costs a binary search.
    """
    both = texts.select("page", "text", "x", F.lit(True).alias("left"), F.col("id").cast("long").alias("id"))
    both = both.unionByName(spans.select("page", "text", "x", F.lit(False).alias("left"), F.col("ord").cast("long").alias("id")))
    both = both.where("page is not null and text is not null and x is not null and not isnan(x) and abs(x) < double('infinity') and id is not null")

    def fold(rows):
        sides, last = ([], []), None
        for _, _, x, left, i in rows:
            if last is not None and x - last > most:
                yield from cluster_matches(*sides, most)
                sides = ([], [])
            last = x
            if left:
                sides[0].append((i, x))
            else:
                sides[1].append((x, i))
        yield from cluster_matches(*sides, most)

    kind = both.schema["page"].dataType.simpleString()
    return streamed(both, ["page", "text"], ["x"], fold, f"page {kind}, text string, id long, span long, away double").drop("text")


def stacked(rows, tolerance: float, running: bool) -> Iterator[tuple[int, float, int, int]]:
    """(number of the row, its last centre, place, ord) of boxes (edge, least edge of all that follow, x0, ord) in order.

    A box joins the first row, in order of their making, whose centre is within ``tolerance`` of its edge. running: the centre is
    the mean of its boxes' edges, else the middle of the old centre and the new edge. Rows that no later box can reach are given out.
    """
    open_: list[list] = []
    made = 0

    def out(row):
        number, centre, boxes = row[0], row[1], row[2]
        for place, (_, ord_) in enumerate(sorted(boxes, key=lambda b: b[0])):
            yield number, centre, place, ord_

    for edge, least, x0, ord_ in rows:
        far = tolerance + 1e-9 * (1 + abs(least) + tolerance)
        if open_ and any(least - r[1] > far for r in open_):
            for r in open_:
                if least - r[1] > far:
                    yield from out(r)
            open_ = [r for r in open_ if not least - r[1] > far]
        for r in open_:
            if abs(edge - r[1]) <= tolerance:
                n = len(r[2])
                r[1] = (r[1] * n + edge) / (n + 1) if running else (r[1] + edge) / 2.0
                r[2].append((x0, ord_))
                break
        else:
            open_.append([made, edge, [(x0, ord_)]])
            made += 1
    for r in open_:
        yield from out(r)


def _numbered(rows: DataFrame, order: list[str], tolerance: float, running: bool) -> DataFrame:
    kind = rows.schema["page"].dataType.simpleString()
    found = streamed(rows, ["page"], order, lambda g: stacked((r[1:5] for r in g), tolerance, running), f"page {kind}, made long, centre double, place int, ord long")
    top = W.partitionBy("page").orderBy("centre", "made")
    return found.select("page", (F.dense_rank().over(top) - 1).alias("row"), "place", "ord")


def box_rows(records: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(page, row, place, ord) of records (page, ord, x0, y0, x1, y1) with an area, taken by top, then left: by the middle of their height,
    a row's centre being its records' mean. Rows go from the top, places from the left; equal ones as they came."""
    rows = records.where("x1 > x0 and y1 > y0").select("page", ((F.col("y0") + F.col("y1")) / 2).alias("edge"), F.col("y0").alias("least"), "x0", F.col("ord").cast("long").alias("ord"))
    return _numbered(rows, ["least", "x0", "ord"], tolerance, True)


def word_rows(words: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(page, row, place, ord) of words (page, ord, x0, y0) by their top edge, taken by bands of ``tolerance``, within a band from the left.

    ord: the words' own order, by block, line and word. A row's centre moves halfway to each word that joins it.
    """
    band = F.rint(F.col("y0") / tolerance)  # halves go to the even band
    rows = words.select("page", F.col("y0").cast("double").alias("edge"), ((band - 0.5) * tolerance).alias("least"), "x0", F.col("ord").cast("long").alias("ord"))
    return _numbered(rows, ["least", "x0", "ord"], tolerance, False)
