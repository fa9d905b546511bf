"""Lines, spans and paragraphs: what a line is made of, where it ends, and whether its breaks matter.

Frames hold one row for each piece (a run of text with a position) or take arrays as columns, as said in each function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import alignment, visible
from ..functions.tables import columns, once, stripped
from ..functions.text import clean_text, color_hex, first_number

#: Fonts whose signs are pictures; words and patterns of the rules below.
PICTURE_FONTS = "symbol|wingdings|dingbat|zapf"
FIRST_CELLS = ("percentile", "description", "penalties", "roll", "result")
FIRST_CELL = r"^(?:\d{1,3}-\d{1,3}|[A-Za-z]+)$"
NUMERIC_LEAD = r"^\s*(?:\d{1,3}(?:[-–]\d{1,3}|-\d{2}|[.,)]|$)|[IVXLCDM]+\b)"
TABLE_LABEL = r"\b(?:Table|Cost|Bonus|Range|Duration|Damage|Weight|Length|Size Level)\b"
TRAIT_LABEL = r":\s*$|^\s*(Bio-E Cost|Range|Duration|Saving Throw|Alignment|Attributes|Skills|Weapons|Armor)\b"
VALUE_ROW, BULLETS = r"\s[—-]\s", ("•", "●", "-")
RANGE_ROW = r"^(.+?\.)(\s*(?:Spd|PE|PP|PS|IQ|PB|Reduce|None\.|[-+]?\d|[1½]/?2|-\d+%).*)$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- pieces of a line -------------------------------------------------------------------------------------------------


def positioned_pieces(value: Column | str, xs: Column | str, gap: float = 22.0) -> Column:
    """array<struct<text, x>>: the text cut where the next sign stands over ``gap`` away, unless all before the cut is blank.

    xs: a position for each sign. Of another number of positions the text stays whole, at the first (0 if there is none); a blank end goes.
    """
    kind = "array<struct<text:string,x:double>>"

    def cut(value: Column, xs: Column) -> Column:
        zero = F.struct(F.lit(1).alias("start"), F.array().cast(kind).alias("out"))
        named = lambda text, start: F.struct(text.alias("text"), F.get(xs, start - 1).alias("x"))
        # only where the next sign stands far away is the text before it looked at
        far = F.filter(F.sequence(F.lit(2), F.greatest(F.size(xs), F.lit(2))), lambda i: F.get(xs, i - 1) - F.get(xs, i - 2) > gap)

        def step(a: Column, i: Column) -> Column:
            piece = F.substring(value, a["start"], i - a["start"])
            return once(piece, lambda text: F.when(stripped(text) != "", F.struct(i.alias("start"), F.array_append(a["out"], named(text, a["start"])).alias("out"))).otherwise(a))

        def end(a: Column) -> Column:
            rest = F.substring(value, a["start"], F.length(value))
            return once(rest, lambda text: F.when(stripped(text) == "", a["out"]).otherwise(F.array_append(a["out"], named(text, a["start"]))))

        return F.aggregate(far, zero, step, end)

    def pieces(value: Column, xs: Column) -> Column:
        whole = F.array(F.struct(value.alias("text"), F.coalesce(F.get(xs, F.lit(0)), F.lit(0.0)).alias("x"))).cast(kind)
        some = once(cut(value, xs), lambda found: F.when(F.size(found) == 0, whole).otherwise(found))
        return F.when((F.size(xs) <= 1) | (F.size(xs) != F.length(value)), whole).otherwise(some)

    return once(F.struct(_c(value).alias("value"), _c(xs).alias("xs")), lambda row: pieces(row["value"], row["xs"]))


def paragraph_lines(pieces: DataFrame, by: list[str], order: str) -> DataFrame:
    """``pieces`` (text, y; blank ones left out) with line, from 0: a new one where y is there and isn't the last y that was."""
    rows = pieces.where(clean_text("text") != "")
    before = W.partitionBy(*by).orderBy(order)
    last = F.last("y", ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(F.col("y") != last, F.lit(False)).cast("int")
    return rows.withColumn("__b", begins).withColumn("line", F.sum("__b").over(before.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def sensitive_columns(pieces: DataFrame, by: list[str], line: str = "line", x: str = "x") -> DataFrame:
    """(``by``, sensitive): whether a line has pieces at several positions."""
    each = pieces.groupBy(*by, line).agg((F.min(x) < F.max(x)).alias("several"))
    return each.groupBy(*by).agg(F.coalesce(F.bool_or("several"), F.lit(False)).alias("sensitive"))


def line_edges(pieces: Column | str, measured: bool = True) -> Column:
    """struct<left, right> of a line, an array of struct<text, x, size, width> (null x: where the last ended; null size: 10).

    The right edge is that of the piece that reaches farthest: by its width, if known and ``measured``, else half a size for each sign.
    """
    pieces = _c(pieces)
    left = F.coalesce(F.get(pieces, F.lit(0))["x"], F.lit(0.0))

    def step(right: Column, p: Column) -> Column:
        n = F.length(clean_text(p["text"]))
        guess = n * F.coalesce(p["size"], F.lit(10.0)) * 0.5
        wide = F.when(p["width"] > 0, p["width"]).otherwise(guess) if measured else guess
        return F.when(n == 0, right).otherwise(F.greatest(right, F.coalesce(p["x"], right) + wide))

    return F.struct(left.alias("left"), F.aggregate(pieces, left, step).alias("right"))


def paragraph_right(lines: Column | str) -> Column:
    """The farthest right edge of lines, estimated from their signs; 0 if there is none."""
    edges = F.transform(F.filter(_c(lines), lambda x: F.size(x) > 0), lambda x: line_edges(x, measured=False)["right"])
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(edges), F.lit(0.0)))


def ragged_left(lines: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """(``by``, variants, ragged): left edges to a tenth; three or more that lie over 18 apart are ragged."""
    r = F.round(x, 1)
    g = lines.groupBy(*by).agg(F.count_distinct(r).alias("variants"), (F.max(r) - F.min(r)).alias("spread"))
    return g.select(*by, "variants", ((F.col("variants") >= 3) & (F.col("spread") > 18)).alias("ragged"))


# --- paragraphs -------------------------------------------------------------------------------------------------------


def stays_in_lines(items: DataFrame, by: list[str], order: str) -> DataFrame:
    """(``by``, stays): whether a group of lines (text, x, y) reads like a table, so that its lines stay apart."""
    text = clean_text("text")
    rows = items.withColumn("__t", F.when(text != "", text))
    share = lambda p: F.count_if(F.coalesce(p, F.lit(False)))
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("__t").alias("k"), F.min_by("__t", F.when(F.col("__t").isNotNull(), F.col(order))).alias("first"),
        (F.max("y") - F.min("y")).alias("dy"), (F.max("x") - F.min("x")).alias("dx"), share(F.length("__t") <= 42).alias("short"),
        share(F.col("__t").rlike(NUMERIC_LEAD)).alias("numeric"), share(F.col("__t").rlike(TABLE_LABEL)).alias("labels"),
    )
    cell = F.col("first").rlike(FIRST_CELL) | F.lower("first").isin(*FIRST_CELLS)
    one_line = (F.col("n") >= 2) & (F.col("dy") < 1.1) & (F.col("dx") > 42.0) & F.coalesce(cell, F.lit(False))
    short = F.col("short") / F.col("k")
    table = (F.col("n") >= 4) & (F.col("k") >= 4) & ((short >= 0.65) | (F.col("numeric") >= 3) | ((F.col("labels") >= 2) & (short >= 0.45)))
    return g.select(*by, (one_line | F.coalesce(table, F.lit(False))).alias("stays"))


def keeps_breaks(lines: Column | str, page: Column | str | None = None, pages: tuple[int, ...] = ()) -> Column:
    """Whether a paragraph's source lines (array<string>, blank ones count as lines but say nothing) keep their breaks; always on ``pages``."""
    lines = _c(lines)
    values = F.filter(F.transform(lines, stripped), lambda t: t != "")
    n, k = F.size(values), F.size(lines)
    count = lambda p: F.size(F.filter(values, p))
    short = count(lambda t: F.length(t) <= 72)
    few = (n <= 5) & (short == n) & F.exists(values, lambda t: t.rlike(":|[—-]"))
    labels = (count(lambda t: t.rlike(r":\s*$")) >= 1) & (short / F.greatest(n, F.lit(1)) >= 0.5)
    rows = count(lambda t: t.rlike(VALUE_ROW) & (F.length(t) <= 92)) >= 2
    bullets = count(lambda t: reduce(lambda a, b: a | b, [t.startswith(x) for x in BULLETS])) >= 2
    narrow = count(lambda t: F.length(t) <= 42) / F.greatest(k, F.lit(1)) >= 0.55
    keeps = ((n >= 2) & (rows | bullets | labels | few)) | ((k >= 8) & (narrow | (count(lambda t: t.rlike(TRAIT_LABEL)) >= 2)))
    return keeps | _c(page).isin(*pages) if pages else keeps


def range_row(value: Column | str) -> Column:
    """struct<description, penalty> of "Text of a row. Spd -2"; nulls if it isn't such a row."""
    x = stripped(_c(value))
    hit = x.rlike(RANGE_ROW)
    return F.struct(*[F.when(hit, stripped(F.regexp_extract(x, RANGE_ROW, k))).alias(n) for k, n in ((1, "description"), (2, "penalty"))])


# --- spans and regions ------------------------------------------------------------------------------------------------


def span_style(font: Column | str, flags: Column | str) -> Column:
    """struct<bold, italic, underline> by the font's name or the flags 16 and 2."""
    font, flags = F.lower(F.coalesce(_c(font), F.lit(""))), F.coalesce(_c(flags), F.lit(0))
    bold = font.contains("bold") | (flags.bitwiseAND(F.lit(16)) != 0)
    italic = font.contains("italic") | font.contains("oblique") | (flags.bitwiseAND(F.lit(2)) != 0)
    return F.struct(bold.alias("bold"), italic.alias("italic"), font.contains("underline").alias("underline"))


def normal_span(text, font, size, flags, color) -> Column:
    """A span with defaults (Arial, 11 points, black), style and colour."""
    style = span_style(font, flags)
    return F.struct(
        F.coalesce(_c(text), F.lit("")).alias("text"), F.coalesce(_c(font), F.lit("Arial")).alias("font"), F.round(F.coalesce(_c(size), F.lit(11.0)), 2).alias("size_pt"),
        *[style[n].alias(n) for n in ("bold", "italic", "underline")], color_hex(_c(color)).alias("color"), F.coalesce(_c(flags), F.lit(0)).alias("flags"),
    )


def block_text(lines: Column | str) -> Column:
    """A block's text from its lines, arrays of span texts: lines stripped, empty ones left out."""
    joined = F.transform(_c(lines), lambda spans: stripped(F.array_join(F.transform(spans, lambda s: F.coalesce(s, F.lit(""))), "")))
    return stripped(F.array_join(F.filter(joined, lambda t: t != ""), "\n"))


def filled_lines(lines: Column | str) -> Column:
    """A block's lines without empty spans, and without lines that have none."""
    kept = F.transform(_c(lines), lambda spans: F.filter(spans, lambda s: F.coalesce(s, F.lit("")) != ""))
    return F.filter(kept, lambda spans: F.size(spans) > 0)


def font_set(fonts: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_c(fonts), F.lower)))


def region_class(text: Column | str, fonts: Column | str) -> Column:
    """Picture text if there is text and all its fonts are of pictures, else normal text."""
    names = font_set(fonts)
    picture = (stripped(_c(text)) != "") & (F.size(names) > 0) & F.forall(names, lambda f: f.rlike(PICTURE_FONTS))
    return F.when(picture, "image_only_stylized_text").otherwise("normal_editable_text")


def text_regions(blocks: DataFrame, page: Column, least: int = 2, most: int = 300, kind: str = "txt") -> DataFrame:
    """(page, region_id, place, text, align) of a page's text blocks (page, ord, text, box): numbered as they come, in reading order.

    Blocks with fewer than ``least`` signs or outside ``page`` (a box) are left out; ``most`` regions of a page stay.
    """
    rows = blocks.where((F.length(stripped(F.col("text"))) >= least) & visible(F.col("box"), page))
    digits = "%03d" if kind == "txt" else "%04d"
    number = F.row_number().over(W.partitionBy("page").orderBy("ord"))
    rows = rows.withColumn("region_id", F.format_string(f"p%d_{kind}_{digits}", "page", number))
    place = F.row_number().over(W.partitionBy("page").orderBy(F.round("box.y0", 3), F.round("box.x0", 3), "region_id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= most)
    return rows.select("page", "region_id", "place", "text", alignment(F.col("box"), page["x1"] - page["x0"]).alias("align"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` (page, ord, x0, y0) with place: by rounded y, then x."""
    w = W.partitionBy("page").orderBy(F.round("y0", 3), F.round("x0", 3), "ord")
    return blocks.withColumn("place", F.row_number().over(w).cast("long"))


def ordered_text(parts: DataFrame, by: list[str], order: str, text: str = "text", glue: str = " ") -> DataFrame:
    """(``by``, text): a group's texts joined in order."""
    g = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("x"))
    return g.select(*by, F.array_join(F.transform("x", lambda x: x[text]), glue).alias("text"))


def first_of(rows: DataFrame, by: list[str], order: list[str], number: str = "place") -> DataFrame:
    """The first row of each group, with the number it had in its page before (``number``, if it isn't there yet)."""
    return rows.withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__i = 1").drop("__i")


def unique_images(images: DataFrame) -> DataFrame:
    """(page, image_id, xref, smask): a page's images by xref and mask, each xref once; ids count all that were listed."""
    listed = images.withColumn("i", F.row_number().over(W.partitionBy("page").orderBy("xref", "smask", "ord")))
    kept = first_of(listed, ["page", "xref"], ["i"])
    return kept.select("page", F.format_string("p%d_img_%03d", "page", "i").alias("image_id"), "xref", "smask")


def longest_text(rows: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """(``by``, text): the longest, of equal ones the first."""
    return rows.groupBy(*by).agg(F.max_by(text, F.struct(F.length(text), -F.col(order))).alias("text"))


def head_rows(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group (a sample to look at)."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("place") <= n)


def numbered(rows: DataFrame, by: list[str], order: str, pattern: str, name: str = "id") -> DataFrame:
    """Ids that count from 1 in each group: ``pattern`` takes the number."""
    return rows.withColumn(name, F.format_string(pattern, F.row_number().over(W.partitionBy(*by).orderBy(order))))


def striped(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rows`` with stripe: every second row, the second first."""
    return rows.withColumn("stripe", F.row_number().over(W.partitionBy(*by).orderBy(order)) % 2 == 0)


# --- geometry of tables -----------------------------------------------------------------------------------------------


def equal_geometry(box: Column, rows: Column, lead: float = 0.72) -> Column:
    """struct<centers, baselines> of a table whose columns and rows are equal: the middles of columns, ``lead`` of the way down each row."""
    n, m = F.greatest(F.size(rows), F.lit(1)), F.greatest(columns(rows), F.lit(1))
    at = lambda first, last, k, share: F.transform(F.sequence(F.lit(0), k - 1), lambda i: first + (last - first) / k * (i + share))
    return F.struct(at(box["x0"], box["x1"], m, 0.5).alias("centers"), at(box["y0"], box["y1"], n, lead).alias("baselines"))


def equipment_columns(box: Column, rows: Column) -> Column:
    """array<struct<x, anchor>> of an equipment table: of five columns, or six of a wide one, the first at its left, the last at its right."""
    wide, m = box["x1"] - box["x0"], columns(rows)
    place = lambda x, anchor: F.struct(x.alias("x"), F.lit(anchor).alias("anchor"))

    def fixed(shares: tuple[float, ...], last: Column) -> Column:
        return F.array(place(box["x0"] + 4, "start"), *[place(box["x0"] + wide * s, "middle") for s in shares], place(last, "end"))

    equal = F.transform(equal_geometry(box, rows)["centers"], lambda x: F.struct(x.alias("x"), F.lit("middle").alias("anchor")))
    six, five = fixed((0.54, 0.66, 0.79, 0.885), box["x0"] + wide * 0.965), fixed((0.46, 0.68, 0.84), box["x1"] - 4)
    return F.when((wide > 400) & (m == 6), six).when(m == 5, five).otherwise(equal)


def screen_position(x: Column | str, y: Column | str, transform: Column | str, height: float = 792.0) -> Column:
    """struct<x, y> on the page, from the first numbers of attributes; a matrix counts y from the foot. Null if one isn't a number."""
    first = lambda v: F.get(F.split(F.trim(_c(v)), r"\s+"), F.lit(0)).try_cast("double")
    y_ = F.when(F.coalesce(_c(transform), F.lit("")).startswith("matrix"), first(y) + height).otherwise(first(y))
    return F.when(first(x).isNotNull() & first(y).isNotNull(), F.struct(first(x).alias("x"), y_.alias("y")))


def in_table(positions: Column | str, box: Column, text: Column | str, slack: float = 8.0) -> Column:
    """Whether a text with one of these positions in the widened box goes with the table; one that ends in "table" stays."""
    hit = F.exists(_c(positions), lambda p: p["x"].between(box["x0"] - slack, box["x1"] + slack) & p["y"].between(box["y0"] - slack, box["y1"] + slack))
    return hit & ~F.lower(stripped(_c(text))).endswith("table")


def overlay_text(box: Column) -> Column:
    """struct<x, baseline, size> of a text laid over an OCR box."""
    h = F.greatest(F.lit(3.0), box["y1"] - box["y0"])
    return F.struct(box["x0"].alias("x"), (box["y0"] + h * 0.82).alias("baseline"), F.greatest(F.lit(4.0), F.least(F.lit(18.0), h * 0.78)).alias("size"))


def line_widths(chars: DataFrame) -> DataFrame:
    """(text, width) of lines of characters (line, ord, char, x0, x1): from the first to the last edge; of lines with equal text the last counts."""
    lines = chars.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "char"))), lambda x: x["char"]), "").alias("t"), (F.max("x1") - F.min("x0")).alias("w"))
    return lines.withColumn("text", stripped(F.col("t"))).where("text <> ''").groupBy("text").agg(F.max_by("w", "line").alias("width"))


def header_widths(texts: DataFrame, widths: DataFrame) -> DataFrame:
    """``texts`` (text) that have a width by their stripped text, with it."""
    return texts.withColumn("__t", stripped(F.col("text"))).join(widths.withColumnRenamed("text", "__t"), "__t").where("width > 0").drop("__t")


def width_scales(texts: DataFrame, bounds: DataFrame) -> DataFrame:
    """(id, scale, shift) of texts (id, x, target) by the widths that were drawn (id, width): those that are off by a thousandth or more."""
    rows = texts.join(bounds.where("width > 0"), "id").withColumn("scale", F.col("target") / F.col("width")).where("abs(scale - 1) >= 0.001")
    return rows.select("id", F.round("scale", 6).alias("scale"), (first_number("x") * (1 - F.col("scale"))).alias("shift"))
