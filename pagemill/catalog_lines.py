"""Queries of lines, spans, regions and geometry, and of scalar rules on text, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import tables as tb
from .functions import text as t
from .operators import layout, lines
from .plans import views as v

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_BOX, _WORD = f"({v.duck(v.BOX)})", f"({v.duck(v.WORD)})"


def _query(sql: str):
    def add(f):
        _Q[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _events(spark, d):
    return v.table(spark, d, "events")


# --- lines ------------------------------------------------------------------------------------------------------------


@_query("""select event_id, piece, string_agg(ch, '' order by i) as text, min(x) as x from (select *, cast(sum(c) over (partition by event_id order by i rows unbounded preceding) as int) as piece from (
 select event_id, i, substr(s, i, 1) as ch, cast(i * 6 + 30 * (i // (3 + event_id % 4)) as double) as x, case when i > 1 and 6 + 30 * (i // (3 + event_id % 4) - (i - 1) // (3 + event_id % 4)) > 22 then 1 else 0 end as c
 from (select event_id, s, unnest(range(1, length(s) + 1)) as i from (select event_id, event_type || '#' || event_id as s from events)))) group by 1, 2""")
def positioned_pieces(spark, d):
    e = _events(spark, d).withColumn("s", F.concat("event_type", F.lit("#"), F.col("event_id").cast("string")))
    xs = F.expr("transform(sequence(1, length(s)), i -> double(i * 6 + 30 * (i div (3 + event_id % 4))))")
    return e.select("event_id", F.posexplode(lines.positioned_pieces("s", xs)).alias("piece", "p")).select("event_id", "piece", "p.text", "p.x")


_PIECE = "select event_id, user_id, case when event_type = 'click' then ' ' else event_type end as text, case when event_id % 5 > 0 then cast(floor(event_id / 40) as double) end as y from "


@_query(f"""select event_id, cast(sum(b) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as line from (
 select *, case when y <> last_value(y ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) then 1 else 0 end as b from ({_PIECE} events) where trim(text) <> '')""")
def paragraph_lines(spark, d):
    return lines.paragraph_lines(v.sql(spark, d, _PIECE + "{events}"), ["user_id"], "event_id").select("event_id", "line")


@_query("""select user_id, coalesce(bool_or(s), false) as sensitive from (select user_id, event_id // 90 as line, min(x) < max(x) as s from (select *, case when event_id % 3 > 0 then event_id % 2 end as x from events) group by 1, 2) group by 1""")
def sensitive_columns(spark, d):
    e = _events(spark, d).select("user_id", F.expr("event_id div 90").alias("line"), F.expr("case when event_id % 3 > 0 then event_id % 2 end").alias("x"))
    return lines.sensitive_columns(e, ["user_id"])


_EDGE = f"select page, line_id, arg_min(x0, (x0, ord)) as \"left\", max(x0 + case when ord % 2 = 0 then x1 - x0 + 1 else length(word) * (10 + ord % 3) * 0.5::double end) as \"right\" from {_WORD} group by 1, 2"


def _line_arrays(spark, d):
    w = v.words(spark, d).withColumn("size", (10 + F.col("ord") % 3).cast("double")).withColumn("width", F.when(F.col("ord") % 2 == 0, F.col("x1") - F.col("x0") + 1))
    x = w.groupBy("page", "line_id").agg(F.array_sort(F.collect_list(F.struct(F.col("x0").alias("x"), "ord", F.col("word").alias("text"), "size", "width"))).alias("p"))
    return x.select("page", "line_id", F.transform("p", lambda p: F.struct(p["text"].alias("text"), p["x"].alias("x"), p["size"].alias("size"), p["width"].alias("width"))).alias("p"))


@_query(f'select page, line_id, "left", round(greatest("left", "right"), 6) as "right" from ({_EDGE})')
def line_edges(spark, d):
    return _line_arrays(spark, d).select("page", "line_id", lines.line_edges("p").alias("e")).select("page", "line_id", "e.left", F.round("e.right", 6).alias("right"))


@_query(f"select page, round(greatest(0, max(x0 + length(word) * (10 + ord % 3) * 0.5::double)), 6) as \"right\" from {_WORD} group by 1")
def paragraph_right(spark, d):
    p = _line_arrays(spark, d).groupBy("page").agg(F.collect_list("p").alias("lines"))
    return p.select("page", F.round(lines.paragraph_right("lines"), 6).alias("right"))


@_query(f"select page, count(distinct r) as variants, count(distinct r) >= 3 and max(r) - min(r) > 18 as ragged from (select page, round(x0 + (ord % 7) * 0.2::double, 1) as r from {_BOX}) group by 1")
def ragged_left(spark, d):
    return lines.ragged_left(v.boxes(spark, d).withColumn("x", F.col("x0") + (F.col("ord") % 7) * 0.2), ["page"])


_ITEM = """select user_id, event_id, case event_id % 5 when 0 then concat(event_id % 20, '-', event_id % 90, ' of it') when 1 then concat('  Cost of ', event_type, ' ') when 2 then ' ' when 3 then 'Roll' else
 concat('a line that is long enough not to be called short by anyone who counts ', event_type) end as text, cast(event_id % 10 as double) * 20 as x, cast(user_id % 3 as double) * (event_id % 4) as y from """


@_query(rf"""select user_id, coalesce(n >= 2 and dy < 1.1 and dx > 42 and (regexp_matches(f, '^(?:\d{{1,3}}-\d{{1,3}}|[A-Za-z]+)$') or lower(f) in ('percentile', 'description', 'penalties', 'roll', 'result')), false)
 or coalesce(n >= 4 and k >= 4 and (s / k >= 0.65 or m >= 3 or (l >= 2 and s / k >= 0.45)), false) as stays from (select user_id, count(*) as n, count(c) as k, arg_min(c, event_id) filter (c is not null) as f, max(y) - min(y) as dy, max(x) - min(x) as dx,
 count(*) filter (length(c) <= 42) as s, count(*) filter (regexp_matches(c, '^\s*(?:\d{{1,3}}(?:[-–]\d{{1,3}}|-\d{{2}}|[.,)]|$)|[IVXLCDM]+\b)')) as m, count(*) filter (regexp_matches(c, '\b(?:Table|Cost|Bonus|Range|Duration|Damage|Weight|Length|Size Level)\b')) as l
 from (select *, nullif(trim(text), '') as c from ({_ITEM} events)) group by 1)""")
def stays_in_lines(spark, d):
    return lines.stays_in_lines(v.sql(spark, d, _ITEM + "{events}"), ["user_id"], "event_id")


_BREAKS = """array[case when event_id % 3 = 0 then 'Range:' else event_type end, case when event_id % 4 = 0 then ' • one ' else repeat('long words ', cast(event_id % 9 as int)) end,
 case when event_id % 5 = 0 then 'Gun — 20 credits' else concat(event_type, ' ', repeat('and more of it ', cast(event_id % 6 as int))) end, case when event_id % 7 < 3 then '- two' when event_id % 7 = 5 then 'Owl — 3' else ' ' end]"""
_MANY = "case when event_id % 6 = 0 then {cat}(l, {cat}(l, {one})) else l end"


@_query(f"""select event_id, (n >= 2 and (len(list_filter(w, lambda x: regexp_matches(x, '\\s[—-]\\s') and length(x) <= 92)) >= 2 or len(list_filter(w, lambda x: substr(x, 1, 1) in ('•', '●', '-'))) >= 2
 or (len(list_filter(w, lambda x: regexp_matches(x, ':\\s*$'))) >= 1 and s / n >= 0.5) or (n <= 5 and s = n and len(list_filter(w, lambda x: regexp_matches(x, ':|[—-]'))) > 0)))
 or (k >= 8 and (len(list_filter(w, lambda x: length(x) <= 42)) / k >= 0.55 or len(list_filter(w, lambda x: regexp_matches(x, ':\\s*$|^\\s*(Bio-E Cost|Range|Duration|Saving Throw|Alignment|Attributes|Skills|Weapons|Armor)\\b'))) >= 2)) as keeps
 from (select event_id, len(l) as k, w, len(w) as n, len(list_filter(w, lambda x: length(x) <= 72)) as s from (select event_id, l, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') as w from (
 select event_id, {_MANY.format(cat='list_concat', one="['Skills of one']")} as l from (select event_id, {_BREAKS} as l from events))))""")
def keeps_breaks(spark, d):
    e = _events(spark, d).select("event_id", F.expr(_BREAKS.replace("array[", "array(").replace("end]", "end)")).alias("l"))
    return e.select("event_id", lines.keeps_breaks(F.expr(_MANY.format(cat="concat", one="array('Skills of one')"))).alias("keeps"))


_PENALTY = "case event_id % 3 when 0 then concat(' Loses balance for a turn. Spd -', event_id % 7) when 1 then concat(event_type, ' only') else concat('Is blind.None. at all ', event_type, ' ') end"


@_query(rf"""select event_id, case when h then trim(regexp_extract(s, p, 1)) end as description, case when h then trim(regexp_extract(s, p, 2)) end as penalty from (select *, regexp_matches(s, p) as h from (
 select event_id, trim({_PENALTY}) as s, '{lines.RANGE_ROW}' as p from events))""")
def range_rows(spark, d):
    return _events(spark, d).select("event_id", lines.range_row(F.expr(_PENALTY)).alias("r")).select("event_id", "r.*")


# --- spans and regions ------------------------------------------------------------------------------------------------

_FONT = "case event_id % 5 when 0 then 'Arial-BOLD' when 1 then 'Times Oblique' when 2 then concat('Underline ', event_type) when 3 then 'ZapfDingbats' end"


@_query(f"""select event_id, contains(f, 'bold') or event_id % 32 & 16 <> 0 as bold, contains(f, 'italic') or contains(f, 'oblique') or event_id % 32 & 2 <> 0 as italic, contains(f, 'underline') as underline,
 coalesce({_FONT}, 'Arial') as font, case when event_id % 4 = 0 then 11 else value end as size_pt, upper(printf('%06x', event_id * 7919 & 16777215)) as color from (select *, lower(coalesce({_FONT}, '')) as f from events)""")
def normal_spans(spark, d):
    e = _events(spark, d).withColumn("font", F.expr(_FONT)).withColumn("size", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    s = lines.normal_span("event_type", "font", "size", (F.col("event_id") % 32).cast("int"), F.col("event_id") * 7919)
    return e.select("event_id", s.alias("s")).select("event_id", *[f"s.{n}" for n in ("bold", "italic", "underline", "font", "size_pt", "color")])


_SPANS = "array[array[event_type, ' ', cast(event_id as varchar)], array[' ', ''], array[case when event_id % 2 = 0 then 'x ' else '' end, event_type], array['']]"


@_query("select event_id, event_type || ' ' || event_id || chr(10) || case when event_id % 2 = 0 then 'x ' else '' end || event_type as text, 3 as filled from events")
def block_texts(spark, d):
    e = _events(spark, d).withColumn("l", F.expr(_SPANS.replace("array[", "array(").replace("]", ")").replace("varchar", "string")))
    return e.select("event_id", lines.block_text("l").alias("text"), F.size(lines.filled_lines("l")).alias("filled"))


_FONTS = "array[case when event_id % 2 = 0 then 'Symbol' else 'WINGDINGS-2' end, case when event_id % 3 = 0 then 'Arial' else 'Symbol' end]"


@_query(f"""select event_id, case when event_type <> 'click' and event_id % 3 <> 0 then 'image_only_stylized_text' else 'normal_editable_text' end as class, array_to_string(list_sort(list_distinct(list_transform({_FONTS}, lambda f: lower(f)))), ',') as fonts from events""")
def region_classes(spark, d):
    e = _events(spark, d).withColumn("f", F.expr(_FONTS.replace("array[", "array(").replace("]", ")"))).withColumn("s", F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type")))
    return e.select("event_id", lines.region_class("s", "f").alias("class"), F.array_join(lines.font_set("f"), ",").alias("fonts"))


@_query(f"""select * from (select page, region_id, row_number() over (partition by page order by round(y0, 3), round(x0, 3), region_id) as place, kind as text, case when abs((x0 + x1) / 2 - 306) < 0.08 * 612 then 'center' else 'left' end as align from (
 select *, 'p' || page || '_txt_' || printf('%03d', row_number() over (partition by page order by ord)) as region_id from {_BOX} where length(kind) >= 2 and least(x1, 612) - greatest(x0, 0) > 0.01 and least(y1, 200) - greatest(y0, 0) > 0.01)) where place <= 20""")
def text_regions(spark, d):
    page = F.struct(*[F.lit(x).alias(n) for n, x in (("x0", 0.0), ("y0", 0.0), ("x1", 612.0), ("y1", 200.0))])
    r = lines.text_regions(v.boxes(spark, d).withColumn("text", F.col("kind")), page, most=20)
    return r.withColumn("place", F.col("place").cast("long"))


@_query("""select user_id as page, printf('p%d_img_%03d', user_id, i) as image_id, xref, smask from (select *, row_number() over (partition by user_id, xref order by i) as k from (
 select *, row_number() over (partition by user_id order by xref, smask, event_id) as i from (select *, event_id % 5 as xref, event_id % 3 as smask from events))) where k = 1""")
def unique_images(spark, d):
    return lines.unique_images(_events(spark, d).select(F.col("user_id").alias("page"), (F.col("event_id") % 5).alias("xref"), (F.col("event_id") % 3).alias("smask"), F.col("event_id").alias("ord")))


@_query("select conv_id, text from (select *, row_number() over (partition by conv_id order by length(text) desc, turn) as i from conversations) where i = 1")
def longest_text(spark, d):
    return lines.longest_text(v.table(spark, d, "conversations"), ["conv_id"], "turn")


@_query("select user_id, event_id, place from (select user_id, event_id, cast(row_number() over (partition by user_id order by event_id) as int) as place from events) where place <= 3")
def head_rows(spark, d):
    return lines.head_rows(_events(spark, d), ["user_id"], "event_id", 3).select("user_id", "event_id", "place")


@_query("select event_id, printf('para_%04d', i) as id, i % 2 = 0 as stripe from (select event_id, row_number() over (partition by user_id order by event_id) as i from events)")
def numbered_stripes(spark, d):
    e = lines.numbered(_events(spark, d), ["user_id"], "event_id", "para_%04d")
    return lines.striped(e, ["user_id"], "event_id").select("event_id", "id", "stripe")


@_query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as i from events) where i = 1")
def first_of_each(spark, d):
    return lines.first_of(_events(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# --- geometry ---------------------------------------------------------------------------------------------------------

_GRID = "transform(sequence(1, int(1 + event_id % 4)), i -> array_repeat('c', int(1 + event_id % 3 + i % 2)))"


@_query("""select event_id, 'center' as kind, i as place, round(x0 + (x1 - x0) / m * (i + 0.5::double), 6) as at from (select *, unnest(range(0, m)) as i from (select event_id, cast(event_id % 61 as double) as x0, event_id % 61 + 50 + value as x1, 2 + event_id % 3 as m from events))
 union all select event_id, 'baseline', i, round(y0 + (y1 - y0) / n * (i + 0.72::double), 6) from (select *, unnest(range(0, n)) as i from (select event_id, cast(event_id % 79 as double) as y0, event_id % 79 + 10 + value as y1, 1 + event_id % 4 as n from events))""")
def equal_geometry(spark, d):
    box = F.struct(*[F.expr(x).cast("double").alias(n) for n, x in (("x0", "event_id % 61"), ("y0", "event_id % 79"), ("x1", "event_id % 61 + 50 + value"), ("y1", "event_id % 79 + 10 + value"))])
    e = _events(spark, d).withColumn("e", lines.equal_geometry(box, F.expr(_GRID)))
    each = lambda kind, name: e.select("event_id", F.lit(kind).alias("kind"), F.posexplode(f"e.{name}").alias("place", "at"))
    return each("center", "centers").unionByName(each("baseline", "baselines")).select("event_id", "kind", F.col("place").cast("long").alias("place"), F.round("at", 6).alias("at"))


@_query("""select event_id, i as place, round(case when m = 6 and w > 400 then [x0 + 4, x0 + w * 0.54, x0 + w * 0.66, x0 + w * 0.79, x0 + w * 0.885, x0 + w * 0.965][i + 1] when m = 5 then [x0 + 4, x0 + w * 0.46, x0 + w * 0.68, x0 + w * 0.84, x1 - 4][i + 1]
 else x0 + (x1 - x0) / m * (i + 0.5::double) end, 6) as x, case when (m = 6 and w > 400) or m = 5 then case when i = 0 then 'start' when i = m - 1 then 'end' else 'middle' end else 'middle' end as anchor
 from (select *, x1 - x0 as w, unnest(range(0, m)) as i from (select event_id, cast(event_id % 61 as double) as x0, event_id % 61 + 200 + value as x1, 4 + event_id % 3 as m from events))""")
def equipment_columns(spark, d):
    box = F.struct(*[F.expr(x).cast("double").alias(n) for n, x in (("x0", "event_id % 61"), ("y0", "0"), ("x1", "event_id % 61 + 200 + value"), ("y1", "10"))])
    e = _events(spark, d).select("event_id", F.posexplode(lines.equipment_columns(box, F.expr("array(array_repeat('c', int(4 + event_id % 3)))"))).alias("place", "c"))
    return e.select("event_id", F.col("place").cast("long").alias("place"), F.round("c.x", 6).alias("x"), "c.anchor")


@_query("""select event_id, case when event_id % 4 > 0 then cast(event_id % 50 as double) end as x, case when event_id % 4 > 0 then value + case when event_id % 3 = 0 then 792 else 0 end end as y from events""")
def screen_positions(spark, d):
    x, y = F.expr("case when event_id % 4 > 0 then concat(' ', event_id % 50, ' 7') else 'auto' end"), F.expr("string(value)")
    p = lines.screen_position(x, y, F.expr("case event_id % 3 when 0 then 'matrix(1 0 0 1 0 0)' when 1 then 'scale(2)' end"))
    return _events(spark, d).select("event_id", p.alias("p")).select("event_id", "p.x", "p.y")


@_query(f"""select ord from {_BOX} where kind <> 'click' and ((x0 between 92 and 308 and y0 between 42 and 158) or (x1 between 92 and 308 and y1 between 42 and 158))""")
def texts_in_table(spark, d):
    box = F.struct(*[F.lit(x).alias(n) for n, x in (("x0", 100.0), ("y0", 50.0), ("x1", 300.0), ("y1", 150.0))])
    text = F.when(F.col("kind") == "click", "the Table ").otherwise(F.col("kind"))
    positions = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    return v.boxes(spark, d).where(lines.in_table(positions, box, text)).select("ord")


@_query("select event_id, round(y0 + h * 0.82::double, 6) as baseline, round(greatest(4, least(18, h * 0.78::double)), 6) as size from (select event_id, cast(event_id % 79 as double) as y0, greatest(3, value / 10) as h from events)")
def overlay_texts(spark, d):
    y = (F.col("event_id") % 79).cast("double")
    e = _events(spark, d).withColumn("box", F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(9.0).alias("x1"), (y + F.col("value") / 10).alias("y1")))
    return e.select("event_id", lines.overlay_text(F.col("box")).alias("o")).select("event_id", F.round("o.baseline", 6).alias("baseline"), F.round("o.size", 6).alias("size"))


_CHARS = "select user_id % 40 as line, event_id as ord, substr(event_type, 1 + cast(event_id % 3 as int), 1) as \"char\", cast(event_id % 90 as double) as x0, event_id % 90 + value as x1 from events where event_id % 9 = user_id % 9"


@_query(f"select text, arg_max(w, line) as width from (select line, string_agg(\"char\", '' order by ord) as text, max(x1) - min(x0) as w from ({_CHARS}) group by 1) group by 1")
def line_widths(spark, d):
    return lines.line_widths(v.sql(spark, d, _CHARS.replace('"', "`").replace("from events", "from {events}")))


@_query("select event_id, width from events join (select event_type as t, cast(count(*) as double) as width from events where event_type <> 'click' group by 1) on t = event_type")
def header_widths(spark, d):
    e = _events(spark, d)
    w = e.where("event_type <> 'click'").groupBy(F.col("event_type").alias("text")).agg(F.count("*").cast("double").alias("width"))
    return lines.header_widths(e.select("event_id", F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("text")), w).select("event_id", "width")


@_query("""select event_id as id, round(value / w, 6) as scale, round(event_id % 50 * (1 - value / w), 6) as shift from (select *, case when event_id % 3 = 0 then value else value / 2 + event_id % 7 end as w from events) where event_id % 2 = 0 and w > 0 and abs(value / w - 1) >= 0.001""")
def width_scales(spark, d):
    e = _events(spark, d)
    texts = e.select(F.col("event_id").alias("id"), F.expr("concat(event_id % 50, ' 9')").alias("x"), F.col("value").alias("target")).where("id % 2 = 0")
    bounds = e.select(F.col("event_id").alias("id"), F.expr("case when event_id % 3 = 0 then value else value / 2 + event_id % 7 end").alias("width"))
    s = lines.width_scales(texts, bounds)
    return s.select("id", "scale", F.round("shift", 6).alias("shift"))


@_query("""select event_id, kind, least(x0, x1) as x0, greatest(x0, x1) as x1, (y0 + y1) / 2 as y from (select event_id, case when event_id % 2 = 0 then 'line' else 'rect' end as kind, value as x0, cast(event_id % 60 * 9 as double) as x1, cast(event_id % 50 as double) as y0, event_id % 50 + (event_id % 9) / 4.0::double as y1 from events)
 where abs(x1 - x0) >= 2 and abs(y1 - y0) <= case kind when 'line' then 0.75 else 1.5 end""")
def rule_segments(spark, d):
    e = _events(spark, d).selectExpr("event_id", "case when event_id % 2 = 0 then 'line' else 'rect' end as kind", "event_id as page", "value as x0", "double(event_id % 60 * 9) as x1", "double(event_id % 50) as y0", "event_id % 50 + (event_id % 9) / 4D as y1")
    r = layout.rule_segments(e)
    return r.select(F.col("page").alias("event_id"), F.expr("case when page % 2 = 0 then 'line' else 'rect' end").alias("kind"), "x0", "x1", "y")


@_query(f"""select ord, least(x1, 400) - greatest(x0, 50) > 0.01 and least(y1 - ord % 20, 150) - greatest(y0, 20) > 0.01 as visible, y1 - ord % 20 > y0 as valid from {_BOX}""")
def box_checks(spark, d):
    b = v.boxes(spark, d).withColumn("low", F.col("y1") - F.col("ord") % 20).withColumn("b", g.box("x0", "y0", "x1", "low"))
    page = F.struct(*[F.lit(x).alias(n) for n, x in (("x0", 50.0), ("y0", 20.0), ("x1", 400.0), ("y1", 150.0))])
    return b.select("ord", g.visible(F.col("b"), page).alias("visible"), g.valid(F.col("b")).isNotNull().alias("valid"))


@_query("""select event_id, round(least(a, b, c) * 72 / 150, 3) as x0, round(greatest(a, b, c) * 72 / 150, 3) as x1, round(least(b, c, a + 1) * 72 / 150, 3) as y0, round(greatest(b, c, a + 1) * 72 / 150, 3) as y1
 from (select event_id, cast(event_id % 101 as double) as a, cast(event_id % 37 as double) as b, cast(event_id % 53 as double) as c from events)""")
def polygon_boxes(spark, d):
    p = F.expr("array(array(double(event_id % 101), double(event_id % 37)), array(double(event_id % 37), double(event_id % 53)), array(double(event_id % 53), double(event_id % 101 + 1)))")
    return _events(spark, d).select("event_id", g.polygon_box(p, 150.0).alias("b")).select("event_id", "b.x0", "b.x1", "b.y0", "b.y1")


_ROWBOX = "transform(sequence(0, int(1 + event_id % 4)), r -> transform(sequence(0, int((event_id + r) % 3)), k -> struct(double(k * 60 + (event_id * r) % 30) as x0, double(k * 60 + 20 + (event_id * r) % 30 + value % 200) as x1, concat(' c', k, ' ') as text)))"


@_query("""select event_id, n >= 3 and coalesce(span <= 360 and first <= 48 and second <= 84, false) as regular, coalesce(span, -1) as span, text from (select event_id, count(*) filter (m > 0) as n, max(m * 60 + 20 + value % 200) filter (m > 0) as span,
 max(s) filter (m > 0) - min(s) filter (m > 0) as first, max(s) filter (m > 0) - min(s) filter (m > 0) as second, arg_min(text, r) as text from (
 select *, (event_id + r) % 3 as m, (event_id * r) % 30 as s, array_to_string(list_transform(range(0, (event_id + r) % 3 + 1), lambda k: 'c' || k), ' ') as text from (select event_id, value, unnest(range(0, 2 + event_id % 4)) as r from events)) group by 1)""")
def regular_rows(spark, d):
    e = _events(spark, d).withColumn("rows", F.expr(_ROWBOX))
    full = F.filter("rows", lambda r: F.size(r) >= 2)
    return e.select("event_id", F.coalesce(layout.regular(F.col("rows")), F.lit(False)).alias("regular"), F.coalesce(F.array_max(F.transform(full, layout.row_span)), F.lit(-1.0)).alias("span"), layout.row_text(F.col("rows")[0]).alias("text"))


# --- scalar rules -----------------------------------------------------------------------------------------------------

_LINE = "concat(event_id % 100, ' ', user_id % 7, ' ', user_id % 10, ' . ', event_id % 9, ' - ', event_id % 8, '%Off ', event_id % 12, 'Day cost$', user_id, ' - ', user_id % 3)"


def _edited(x: str) -> str:
    """The ordered edits without look-arounds: a match takes its neighbours and gives them back; twice, as neighbours may serve two gaps."""
    for pattern, new in ((r"(\d)\s+(\d)", r"\1\2"), (r"(\d)\s+([.,;:])", r"\1\2"), (r"(\d)\s*-\s*(\d)", r"\1-\2"), (r"(^|\W)-\s+(\d)", r"\1-\2"), (r"(\d)([A-Z][a-z])", r"\1 \2"), (r"(%)\s*([A-Z])", r"\1 \2"), (r"([A-Za-z)])\s*(\$)", r"\1 \2")):
        x = f"regexp_replace(regexp_replace({x}, '{pattern}', '{new}', 'g'), '{pattern}', '{new}', 'g')"
    return x


@_query(f"select event_id, {_edited(_LINE)} as line from events")
def editable_lines(spark, d):
    return _events(spark, d).select("event_id", t.normalize_line(F.expr(_LINE)).alias("line"))


@_query("""select event_id, case event_id % 3 when 0 then value - 5 when 1 then value - 10 else value end as x, case when event_id % 4 = 0 then -1 else value end as first, cast(case when event_id % 4 = 0 then 0 else event_id % 50 end as int) as page,
 cast(round_even(value * 12700, 0) as bigint) as emu, event_type as key, case when event_id % 5 > 0 then event_id || '=x' end as val, case when event_id % 3 = 0 then cast(event_id % 50 as int) when event_id % 3 = 1 then 7 end as bound_first,
 case when event_id % 3 = 0 then cast(event_id % 50 + 3 as int) when event_id % 3 = 1 then 7 end as bound_last, printf('#%02x%02x%02x', cast(round_even((event_id % 5) / 4.0::double * 255, 0) as int), cast(least(255, round_even((event_id % 7) / 5.0::double * 255, 0)) as int), 0) as rgb from events""")
def value_rules(spark, d):
    b = t.page_bounds(F.expr("case event_id % 3 when 0 then concat(event_id % 50, ' - ', event_id % 50 + 3) when 1 then ' 7 ' else '3,4' end"))
    k = t.key_value(F.expr("case when event_id % 5 > 0 then concat(event_type, ' = ', event_id, '=x') else event_type end"))
    return _events(spark, d).select(
        "event_id", t.anchored_x("value", F.lit(10.0), F.expr("case event_id % 3 when 0 then 'middle' when 1 then 'end' end")).alias("x"), t.first_number(F.expr("case when event_id % 4 = 0 then 'none 4' else concat('  ', value, ' 8') end"), -1).alias("first"),
        t.to_int(F.expr("case when event_id % 4 = 0 then '' else string(event_id % 50) end")).alias("page"), t.emu("value").alias("emu"), k["key"].alias("key"), k["value"].alias("val"), b["first"].alias("bound_first"), b["last"].alias("bound_last"),
        t.rgb_hex(F.expr("(event_id % 5) / 4D"), F.expr("(event_id % 7) / 5D"), F.lit(0.0)).alias("rgb"),
    )


_CELLS = "[[upper(event_type), '', ' ' || event_id % 9, null], ['', ' '], [' a ', event_type, case when event_id % 2 = 0 then 'z' end]]"
_SPARK_CELLS = "array(array(upper(event_type), '', concat(' ', event_id % 9), null), array('', ' '), array(' a ', event_type, case when event_id % 2 = 0 then 'z' end))"


@_query("""select event_id, upper(event_type) || '|' || event_id % 9 || case when event_id % 2 = 0 then '|' else '' end || '/' || case when event_id % 2 = 0 then '||' else '|' end || '/a|' || event_type || case when event_id % 2 = 0 then '|z' else '' end as cells from events""")
def compacted_rows(spark, d):
    rows = tb.compacted(F.expr(_SPARK_CELLS))
    return _events(spark, d).select("event_id", F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), "/").alias("cells"))


@_query(f"""select event_id, r as row, c as "column", x as text, r = 0 as header from (select event_id, r, unnest(range(0, len(l))) as c, unnest(l) as x from (select event_id, unnest(range(0, len(l))) as r, unnest(l) as l from (select event_id, {_CELLS} as l from events))) where trim(coalesce(x, '')) <> ''""")
def table_cells(spark, d):
    c = layout.table_cells(_events(spark, d).withColumn("rows", F.expr(_SPARK_CELLS)), ["event_id"])
    return c.select("event_id", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), "text", "header")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
