"""Boxes as structs of x0, y0, x1, y1 in points, y growing downward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    return F.struct(*[F.col(c).cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])


def width(a: Column, b: Column) -> Column:
    """Of the boxes' intersection; 0 or less if they don't meet."""
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])


def height(a: Column, b: Column) -> Column:
    return F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """The intersection's share of ``a``'s area (of 1 if that is less): not symmetric."""
    shared = F.greatest(F.lit(0.0), width(a, b)) * F.greatest(F.lit(0.0), height(a, b))
    return shared / F.greatest(F.lit(1.0), (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]))


def intersection(a: Column, b: Column) -> Column:
    pairs = (("x0", F.greatest), ("y0", F.greatest), ("x1", F.least), ("y1", F.least))
    return F.struct(*[f(a[n], b[n]).alias(n) for n, f in pairs])


def inside(a: Column, b: Column, slack: float = 1.0) -> Column:
    """``a`` lies in ``b`` widened by ``slack``."""
    return (a["x0"] >= b["x0"] - slack) & (a["y0"] >= b["y0"] - slack) & (a["x1"] <= b["x1"] + slack) & (a["y1"] <= b["y1"] + slack)


def valid(a: Column) -> Column:
    """Four numbers with x1 > x0 and y1 > y0, else null."""
    return F.when((a["x1"] > a["x0"]) & (a["y1"] > a["y0"]), a)


def visible(a: Column, page: Column, least: float = 0.01) -> Column:
    return (width(a, page) > least) & (height(a, page) > least)


def alignment(a: Column, page_width) -> Column:
    return F.when(F.abs((a["x0"] + a["x1"]) / 2 - F.lit(page_width) / 2) < 0.08 * F.lit(page_width), "center").otherwise("left")


def polygon_box(points: Column, dpi: float) -> Column:
    """The box of an array of (x, y) pairs in pixels, in points, rounded to three digits."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(*[F.round(f(v) * 72 / dpi, 3).alias(n) for n, f, v in (("x0", F.array_min, xs), ("y0", F.array_min, ys), ("x1", F.array_max, xs), ("y1", F.array_max, ys))])


def union_box(a: str = "box") -> list[Column]:
    """Aggregates: the box around all, zeros if there is none."""
    return [F.coalesce(F.round(f(F.col(a)[n]), 3), F.lit(0.0)).alias(n) for n, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]


def box_pairs(left: DataFrame, right: DataFrame, slack: float = 0.0, band: float = 64.0) -> DataFrame:
    """Pairs of rows (l, r), each once, of one page whose boxes share a horizontal band; the caller's condition follows.

    ``left`` and ``right`` have columns page and box. Boxes are dealt by (page, band) and meet by an equi-join, so a page
    with many boxes is no nested loop; a pair that shares several bands counts in the first alone.
    """

    def dealt(df: DataFrame, name: str, more: float) -> DataFrame:
        b = F.sequence(F.floor((F.col("box.y0") - more) / band), F.greatest(F.floor((F.col("box.y0") - more) / band), F.floor((F.col("box.y1") + more) / band)))
        return df.select("page", F.struct("*").alias(name), b[0].alias(f"{name}_first"), F.explode(b).alias("band"))

    pairs = dealt(left, "l", slack).join(dealt(right, "r", 0.0), ["page", "band"])
    return pairs.where(F.col("band") == F.greatest("l_first", "r_first")).select("page", "l", "r")
