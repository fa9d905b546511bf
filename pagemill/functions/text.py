"""Scalar rules on text, as Column expressions that stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space (Java's own classes differ from it), the bullet sign.
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0  -     　]+"
BULLET = "●"
#: Places where a space is missing, as (before, after).
JOINTS = (("[A-Za-z]", r"\("), (r"\)", "[A-Za-z0-9]"), ("[a-z]", "[A-Z]"), ("[0-9%]", "[A-Za-z]"), ("[A-Za-z]", "[0-9]"), ("[.,:;!?]", "[A-Za-z0-9]"))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_to_null(x: Column | str) -> Column:
    return F.nullif(_col(x), F.lit(""))


def clean_text(x: Column | str) -> Column:
    """Null is empty; runs of white space are one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), WS, " "))


def normalize_search_text(x: Column | str) -> Column:
    """``clean_text`` with bullets spelled out and a space at every joint of ``JOINTS``.

    A joint is two neighbours, and a space in one leaves all others as they are, so one pass finds those of all kinds, and none makes a run of spaces.
    """
    y = clean_text(x)
    spelled = F.when(F.contains(y, F.lit(BULLET)), clean_text(F.replace(y, F.lit(BULLET), F.lit(" bullet ")))).otherwise(y)
    return F.regexp_replace(spelled, "|".join(f"(?<={a})(?={b})" for a, b in JOINTS), " ")


def query_terms(query: str) -> list[str]:
    """Lower-cased words of a query, repeats kept; an empty query is an error."""
    terms = query.lower().split()
    if not terms:
        raise ValueError("an empty query")
    return terms


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs in ``text`` without overlap."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))) / len(term.encode())).cast("long")


def keyword_score(text, record_type, extra: list[Column], terms: list[str], page_bonus: bool = True) -> Column:
    """Occurrences of all terms in the record's lower-cased text, type and ``extra``; one more for a page that has any."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(_col(c), F.lit("")) for c in (text, record_type, *extra)]))
    score = reduce(lambda a, b: a + b, [occurrences(hay, t) for t in terms])
    return score + F.when((_col(record_type) == "page") & (score > 0), 1).otherwise(0).cast("long") if page_bonus else score


def snippet(x: Column | str, terms: list[str], limit: int = 180, lead: int = 45) -> Column:
    """The cleaned text, or ``limit`` characters of it from ``lead`` before the first term on, with dots where it is cut."""
    text = clean_text(x)
    low = F.lower(text)
    first = F.array_min(F.array_compact(F.array(*[F.nullif(F.instr(low, t), F.lit(0)) for t in terms])))
    start = F.greatest(F.coalesce(first - 1, F.lit(0)) - lead, F.lit(0))
    part = F.substring(text, start + 1, F.lit(limit))
    dotted = F.concat(F.when(start > 0, "...").otherwise(""), part, F.when(start + limit < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= limit, text).otherwise(dotted)


def slug(x: Column | str, sign: str = "-", default: str = "source-document", most: int | None = None) -> Column:
    """Lower case, runs of other signs than letters and digits as one ``sign``, none at the ends."""
    y = F.regexp_replace(F.lower(_col(x)), "[^a-z0-9]+", sign)
    y = F.regexp_replace(y, f"^{re.escape(sign)}+|{re.escape(sign)}+$", "")
    return F.coalesce(empty_to_null(F.substring(y, 1, most) if most else y), F.lit(default))


def stem(path: Column | str) -> Column:
    """A path's last part without its last extension."""
    return F.regexp_replace(F.regexp_replace(_col(path), r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def run_identity(path, sha256) -> Column:
    return F.concat(slug(stem(path), "_", "document", 32), F.lit("_"), F.substring(_col(sha256), 1, 8))


def short_number(x: Column | str) -> Column:
    """The first seven hex digits of the SHA-1, as a number."""
    return F.conv(F.substring(F.sha1(_col(x)), 1, 7), 16, 10).cast("long")


def color_hex(x: Column | str) -> Column:
    return F.lpad(F.hex(F.coalesce(_col(x).cast("long"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFF))), 6, "0")


def rgb_hex(r, g, b) -> Column:
    """#rrggbb of parts from 0 to 1; white if one is null."""
    part = [F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(_col(c) * 255).cast("long")))), 2, "0")) for c in (r, g, b)]
    return F.coalesce(F.concat(F.lit("#"), *part), F.lit("#ffffff"))


def column_name(index: Column | str) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA: digits of 26 without a zero, as many as a long needs; 0 has none."""
    x, names, first = _col(index).cast("long") - 1, [], 0
    for k in range(14):
        names.append(F.when(x >= first, F.char(F.call_function("div", x - first, F.lit(26**k)) % 26 + 65)).otherwise(""))
        first += 26 ** (k + 1)
    return F.concat(*reversed(names))


#: Ordered edits of an editable line.
LINE_EDITS = (
    (r"(?<=\d)\s+(?=\d)", ""),
    (r"(?<=\d)\s+(?=[.,;:])", ""),
    (r"(?<=\d)\s*-\s*(?=\d)", "-"),
    (r"(?<!\w)-\s+(?=\d)", "-"),
    (r"(?<=\d)(?=[A-Z][a-z])", " "),
    (r"(?<=%)\s*(?=[A-Z])", " "),
    (r"(?<=[A-Za-z)])\s*(?=\$)", " "),
)


def normalize_line(x: Column | str) -> Column:
    """Closes gaps in numbers and ranges, opens them before words and amounts."""
    return reduce(lambda y, e: F.regexp_replace(y, e[0], e[1].replace("$", r"\$")), LINE_EDITS, _col(x))


def text_width(x, size, wide: bool = False) -> Column:
    """The estimated width: spaces, narrow and broad signs count differently (fixed factors)."""
    x, size = _col(x), _col(size)
    spaces = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    narrow, broad = (F.length(F.regexp_replace(x, f"[^{c}]", "")) for c in ("ilI1.,'", "MW@#%"))
    rest = F.length(x) - spaces - narrow - broad
    return size * F.lit(0.56 if wide else 0.48) * (spaces * 0.55 + narrow * 0.45 + broad * 1.25 + rest)


def anchored_x(x, width, anchor) -> Column:
    x, width = _col(x), _col(width)
    return F.when(_col(anchor) == "middle", x - width / 2).when(_col(anchor) == "end", x - width).otherwise(x)


def first_number(x: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(_col(x), WS), lambda t: t != ""), F.lit(1)).try_cast("double"), F.lit(float(default)))


def to_int(x: Column | str) -> Column:
    """Null, blank, not a number: 0."""
    return F.coalesce(_col(x).try_cast("int"), F.lit(0))


def page_bounds(x: Column | str) -> Column:
    """"a-b" -> (a, b); "p" -> (p, p); a list or anything else -> nulls."""
    m = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"
    first, last = empty_to_null(F.regexp_extract(_col(x), m, 1)).cast("int"), empty_to_null(F.regexp_extract(_col(x), m, 2)).cast("int")
    return F.struct(first.alias("first"), F.coalesce(last, first).alias("last"))


def page_list(x: Column | str) -> Column:
    """"1-3,5" -> [1, 2, 3, 5]: ascending, each once; blanks are skipped and a falling range is empty."""
    parts = F.filter(F.split(_col(x), ","), lambda p: F.trim(p) != "")

    def pages(p: Column) -> Column:
        a = F.trim(F.split(p, "-")[0]).cast("int")
        b = F.coalesce(F.trim(F.try_element_at(F.split(p, "-"), F.lit(2))).cast("int"), a)
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def chunk_label(pages: Column | str) -> Column:
    """"005" of one page, "005-009" of more."""
    p = _col(pages)
    return F.when(F.size(p) == 1, F.format_string("%03d", p[0])).otherwise(F.format_string("%03d-%03d", p[0], F.element_at(p, -1)))


def page_filter(pages: Column | str) -> Column:
    """"a-b" of pages without a gap, else "a,b,...". """
    p = _col(pages)
    dense = (F.element_at(p, -1) - p[0] + 1 == F.size(p)) & (F.size(p) > 1)
    return F.when(dense, F.concat_ws("-", p[0].cast("string"), F.element_at(p, -1).cast("string"))).otherwise(F.array_join(p.cast("array<string>"), ","))


def key_value(x: Column | str) -> Column:
    """Split at the first "="; no "=" gives a null value."""
    parts = F.split(_col(x), "=", 2)
    return F.struct(F.trim(parts[0]).alias("key"), F.trim(F.try_element_at(parts, F.lit(2))).alias("value"))


def twips(points) -> Column:
    return F.bround(_col(points) * 20).cast("long")


def emu(points) -> Column:
    return F.bround(_col(points) * 12700).cast("long")


def toc_like(x: Column | str) -> Column:
    tokens = F.filter(F.split(_col(x), WS), lambda t: t != "")
    return (F.size(tokens) > 1) & F.coalesce(F.try_element_at(tokens, F.lit(-1)).rlike(r"^\d+$"), F.lit(False))


def table_title_like(x: Column | str) -> Column:
    y = F.regexp_replace(F.lower(_col(x)), "[^a-z0-9]+", "")
    return y.contains("table") & y.rlike("experience|point|damage|roll|weapon|skill")


def numeric_row_like(x: Column | str) -> Column:
    return F.lower(_col(x)).rlike(r"^\s*(?:\d{1,4}(?:[-–]\d{1,4})?|\d+d\d+)\b")


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def chunk_text(x: Column | str, most: int = 1400) -> Column:
    """Words packed greedily into chunks of at most ``most`` characters; a longer word is a chunk of its own; empty: none."""
    if most <= 0:
        raise ValueError("a chunk must hold a character")
    zero = F.struct(F.lit(1).alias("start"), F.lit(0).alias("size"), F.array().cast("array<struct<start:int,size:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        n, first = F.length(t), a["size"] == 0
        more = F.when(first, n).otherwise(a["size"] + 1 + n)
        here = F.struct(a["start"].alias("start"), a["size"].alias("size"))
        full = F.struct((a["start"] + a["size"] + 1).alias("start"), n.alias("size"), F.array_append(a["out"], here).alias("out"))
        return F.when(first | (more <= most), F.struct(a["start"].alias("start"), more.alias("size"), a["out"].alias("out"))).otherwise(full)

    def packed(text: Column) -> Column:
        """Places and lengths of the chunks are folded over the words; texts are cut out once."""
        cuts = F.aggregate(F.split(text, " "), zero, step, lambda a: F.array_append(a["out"], F.struct(a["start"].alias("start"), a["size"].alias("size"))))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(cuts, lambda c: F.substring(text, c["start"], c["size"])))

    return F.transform(F.array(clean_text(x)), packed)[0]
