"""Rules on tables held as arrays of rows of cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

_EDGE = f"^{WS}|{WS}$"


def stripped(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), _EDGE, "")


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)``, in which ``x`` is computed once a row however often ``f`` names it: the value of a lambda over an array of it alone."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def columns(rows: Column) -> Column:
    """The length of the longest row."""
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def padded(rows: Column) -> Column:
    """Rows of equal length, filled up with empty cells; null cells are empty."""
    fill = lambda rows, most: F.transform(rows, lambda r: F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), most - F.size(r))))
    return once(rows, lambda rows: once(columns(rows), lambda most: fill(rows, most)))


def compacted(rows: Column) -> Column:
    """Cells stripped, blank ones left out, rows filled up at the right."""
    return padded(F.transform(rows, lambda r: F.filter(F.transform(r, stripped), lambda c: c != "")))


def cleaned(rows: Column) -> Column:
    """Cells stripped, empty rows and columns left out; a lone cell in the first row joins a fuller second row."""
    count = lambda r: F.size(F.filter(r, lambda c: c != ""))

    def dense(full: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(columns(full), F.lit(1))), lambda i: F.exists(full, lambda r: F.coalesce(F.try_element_at(r, i), F.lit("")) != ""))
        return once(places, lambda places: F.transform(full, lambda r: F.transform(places, lambda i: F.try_element_at(r, i))))

    def merged(dense: Column) -> Column:
        first, second = F.try_element_at(dense, F.lit(1)), F.try_element_at(dense, F.lit(2))
        both = F.concat(F.array(F.zip_with(first, second, lambda a, b: F.when(a != "", a).otherwise(b))), F.slice(dense, 3, F.greatest(F.size(dense), F.lit(1))))
        return F.when((F.size(dense) >= 2) & (count(first) == 1) & (count(second) >= 2), both).otherwise(dense)

    some = F.filter(F.transform(rows, lambda r: F.transform(r, stripped)), lambda r: F.exists(r, lambda c: c != ""))
    return once(once(padded(some), dense), merged)


def table_class(rows: Column, fallback: str = "structured_table") -> Column:
    """A class by words in the table's text (fixed values)."""
    text = F.lower(F.array_join(F.transform(rows, lambda r: F.array_join(r, ",")), "\n"))
    return once(text, lambda text: _ladder(text, text, r"bio-e|sdc|spd").when(text.rlike("speed:|tabletop inches"), "movement_table").otherwise(fallback))


def _ladder(text: Column, raw: Column, stats: str) -> Column:
    return F.when(text.rlike(r"avg\.|damage") | raw.contains("$"), "equipment_table").when(text.contains("height") & text.contains("weight"), "height_weight_table").when(text.rlike(stats), "stat_table")


def table_score(text: Column, rows: Column) -> Column:
    """(class, score) of a text block laid out in cells; null and 0 if it isn't like a table."""
    title = lambda low: low.rlike(r"\b(table|weapons|equipment|size|weight|bio-e|damage|avg\.|iq|ps|pe|spd|sdc)\b")
    filled = lambda r: F.filter(r, lambda c: stripped(c) != "")

    def shares(some: Column) -> Column:
        n = F.size(some)
        dense = F.size(F.filter(some, lambda r: F.size(filled(r)) >= 3)) / F.greatest(n, F.lit(1))
        numeric = F.size(F.filter(some, lambda r: (F.size(r) >= 3) & (F.size(F.filter(r, lambda c: F.lower(c).rlike(r"[\d$%]|yes|no|d\d"))) >= 2))) / F.greatest(n, F.lit(1))
        return F.struct(n.alias("n"), columns(some).alias("columns"), dense.alias("dense"), numeric.alias("numeric"))

    def scored(low: Column, x: Column) -> Column:
        like = (x["n"] >= 3) & (x["columns"] >= 4) & ((x["dense"] >= 0.45) | (x["numeric"] >= 0.35)) & (title(low) | (x["numeric"] >= 0.5))
        kind = _ladder(low, text, "bio-e|sdc").otherwise("structured_table")
        return once(F.when(like, kind), lambda kind: given(kind, x))

    def given(kind: Column, x: Column) -> Column:
        plain = kind == "structured_table"
        score = F.least(F.when(plain, 0.9).otherwise(0.95), F.when(plain, 0.5).otherwise(0.55) + x["dense"] * 0.25 + x["numeric"] * 0.25)
        return F.struct(kind.alias("class"), F.when(kind.isNotNull(), score).otherwise(0.0).alias("score"))

    some = F.filter(rows, lambda r: F.exists(r, lambda c: stripped(c) != ""))
    return once(F.lower(text), lambda low: once(once(some, shares), lambda x: scored(low, x)))


def image_class(area, mean, contrast, alpha) -> Column:
    """Background, near-blank or content image (fixed thresholds)."""
    a, m, c, t = (F.col(x) if isinstance(x, str) else x for x in (area, mean, contrast, alpha))
    return F.when((a >= 0.85) & (m >= 215) & (c <= 35), "background_image").when((m >= 245) & (c <= 8) & (t >= 250), "near_blank_image").otherwise("content_image")
