"""All queries of the engine by name, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import tables as tb
from .functions import text as t
from .operators import layout, lines, quality, records, retrieval
from .plans import views as v

TERMS, TYPED = "tion the", "the"
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# --- fragments of DuckDB SQL ------------------------------------------------------------------------------------------

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BOX, _WORD, _RECORD = (f"({v.duck(x)})" for x in (v.BOX, v.WORD, v.RECORD))
_RID = "concat_ws('::', batch_id, book_id, printf('p%03d', page), record_type)"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}', ' ', 'g'))"


def _norm(x: str) -> str:
    y = f"replace({_clean(x)}, '{t.BULLET}', ' bullet ')"
    for a, b in t.JOINTS:
        y = f"regexp_replace({y}, '({a})({b})', '\\1 \\2', 'g')"
    return _clean(y)


def _score(terms: list[str], hay: str = "h") -> str:
    return " + ".join(f"(length({hay}) - length(replace({hay}, '{x}', ''))) // {len(x)}" for x in terms)


def _snippet(x: str, terms: list[str]) -> str:
    first = "list_min(list_filter([%s], lambda i: i > 0))" % ", ".join(f"instr(lower({x}), '{w}')" for w in terms)
    start = f"greatest(coalesce({first} - 1, 0) - 45, 0)"
    return f"case when length({x}) <= 180 then {x} else (case when {start} > 0 then '...' else '' end) || substr({x}, {start} + 1, 180) || (case when {start} + 180 < length({x}) then '...' else '' end) end"


def _over(a: str, b: str) -> str:
    w, h = f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))", f"greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    return f"{w} * {h} / greatest(1, ({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- search and records -----------------------------------------------------------------------------------------------

#: What is searched: text, type and three fields of the metadata.
_HAY = "lower(text || ' ' || record_type || ' ' || concat_ws(' ', metadata ->> '$.classification', metadata ->> '$.review_role', metadata ->> '$.layout_class'))"
_HITS = f"""select score, record_id, record_type, page, {_snippet('c', TERMS.split())} as snippet from (
 select *, s + case when record_type = 'page' and s > 0 then 1 else 0 end as score from (select *, {_score(TERMS.split())} as s from (
 select *, {_RID} as record_id, {_clean('text')} as c, {_HAY} as h from {_RECORD})))
 where score > 0 order by score desc, page, record_type, ord limit 10"""


@_query(_HITS)
def keyword_topk(spark, d):
    return retrieval.keyword_search(v.records(spark, d), TERMS, order="ord")


@_query(f"""select score, record_id, record_type, page, {_snippet('c', [TYPED])} as snippet from (select *, {_score([TYPED])} as score from (
 select *, {_RID} as record_id, {_clean('text')} as c, {_HAY} as h from {_RECORD} where record_type = 'ocr_text'))
 where score > 0 order by score desc, page, record_type, ord limit 10""")
def keyword_typed_hits(spark, d):
    return retrieval.keyword_search(v.records(spark, d), TYPED, record_type="ocr_text", page_bonus=False, order="ord")


@_query(f"""select score, record_id, record_type, page, total from (select *, {_score(['de', 'user'])} as score, count(*) over () as total from (select *, {_RID} as record_id, {_HAY} as h from {_RECORD}) where {_score(['de', 'user'])} > 0)
 order by score desc, page, record_type, ord limit 10""")
def keyword_metadata(spark, d):
    """Terms that stand in the metadata of many records, with the number of all hits."""
    return retrieval.keyword_search(v.records(spark, d), "de user", page_bonus=False, order="ord", total=True).drop("snippet")


@_query(f"select record_type, count(*) as records from {_RECORD} group by 1")
def record_type_counts(spark, d):
    return records.counts(v.records(spark, d))


@_query(f"""select source || '::doc' || doc_id || '::' || printf('p%03d', 1 + doc_id % 50) || '::text' as record_id, source as batch_id, 'doc' || doc_id as book_id, 'synthetic_text' as record_type,
 text, cast(1 + doc_id % 50 as int) as page, sha256(text) as text_sha256 from documents""")
def records_from_documents(spark, d):
    e = v.table(spark, d, "documents").select(F.col("source").alias("batch_id"), F.concat(F.lit("doc"), "doc_id").alias("book_id"), (1 + F.col("doc_id") % 50).alias("page"), "text", F.lit("").alias("record_id"))
    return records.from_texts(e).select("record_id", "batch_id", "book_id", "record_type", "text", "page", F.sha2("text", 256).alias("text_sha256"))


@_query("""select 'conv::' || conv_id || '::' || printf('p%05d', turn) || '::' || substr(sha256(text), 1, 12) || '::ocr' as record_id, 'conv' as batch_id, cast(conv_id as varchar) as book_id,
 'private_ocr_page' as record_type, text, cast(turn as int) as page from conversations""")
def records_from_conversations(spark, d):
    e = v.table(spark, d, "conversations").select(F.lit("conv").alias("corpus_id"), F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("page_number"), "text")
    return records.from_ocr(records.ocr_pages(e)).select("record_id", "batch_id", "book_id", "record_type", "text", "page")


@_query("""select 'web::page' || page_id || '::inventory' as record_id, 'web' as batch_id, 'page' || page_id as book_id, 'inventory_entry' as record_type, url || ' page' || page_id || ' synthetic approved' as text, 0 as page from pages""")
def records_from_pages(spark, d):
    e = v.table(spark, d, "pages").select(F.lit("web").alias("batch_id"), F.concat(F.lit("page"), "page_id").alias("book_id"), F.col("url").alias("display_name"), F.lit("synthetic").alias("privacy_class"), F.lit("").alias("rights_class"), F.lit("approved").alias("intake_state"))
    return records.from_manifest(e).select("record_id", "batch_id", "book_id", "record_type", "text", "page")


@_query("""select 'tpch::n' || n.n_nationkey || '::p' || printf('%03d', n.n_regionkey) || '::t' || n.n_nationkey as record_id, n.n_name || ' t' || n.n_nationkey || ' ' || r.r_name || ' ' || n.n_name || ' tail' as text,
 cast(n.n_regionkey as int) as page, cast(2 as int) as row_count, cast(2 as int) as column_count from nation n join region r on n.n_regionkey = r.r_regionkey""")
def records_from_tables(spark, d):
    n = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    e = n.select(F.lit("tpch").alias("batch_id"), F.concat(F.lit("n"), "n_nationkey").alias("book_id"), F.col("n_regionkey").alias("page"), F.concat(F.lit("t"), "n_nationkey").alias("table_id"), F.col("n_name").alias("caption"), F.array(F.array("r_name", "n_name"), F.array(F.lit("tail"))).alias("cells"))
    r = records.from_tables(e)
    return r.select("record_id", "text", "page", F.get_json_object("metadata", "$.row_count").cast("int").alias("row_count"), F.get_json_object("metadata", "$.column_count").cast("int").alias("column_count"))


@_query("""select 'web::' || page_id || '::' || printf('p%03d', page_id) || '::i' || page_id as record_id, url || ' photo i' || page_id as text, cast(page_id as int) as page from pages""")
def records_from_images(spark, d):
    e = v.table(spark, d, "pages").select(F.lit("web").alias("batch_id"), F.col("page_id").cast("string").alias("book_id"), F.col("page_id").alias("page"), F.col("url").alias("label"), F.lit("photo").alias("classification"), F.lit("").alias("alt_text"), F.concat(F.lit("i"), "page_id").alias("image_id"))
    return records.from_images(e).select("record_id", "text", "page")


@_query(f"select doc_id, {_norm('text')} as text, {_clean('text')} as clean from documents")
def normalize_text(spark, d):
    return v.table(spark, d, "documents").select("doc_id", t.normalize_search_text("text").alias("text"), t.clean_text("text").alias("clean"))


@_query(f"""with recursive tok as (select doc_id, list_filter(string_split({_clean('text')}, ' '), lambda x: x <> '') as w from documents),
 f as (select doc_id, w, 1 as i, w[1] as now, cast(null as varchar) as done, 0 as n from tok where len(w) > 0
 union all select doc_id, w, i + 1, case when i = len(w) then null when length(now) + 1 + length(w[i + 1]) <= 1400 then now || ' ' || w[i + 1] else w[i + 1] end,
 case when i = len(w) or length(now) + 1 + length(w[i + 1]) > 1400 then now end, n + case when done is not null then 1 else 0 end from f where i <= len(w))
 select doc_id, cast(n as int) as chunk_index, printf('doc%d::chunk%04d', doc_id, n) as chunk_id, sha256(done) as sha256 from f where done is not null""")
def chunks(spark, d):
    r = v.table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("record_id"), "text")
    return retrieval.chunks(r).select("doc_id", "chunk_index", "chunk_id", F.sha2("text", 256).alias("sha256"))


@_query("select doc_id, sha256(text) as text_sha256, length(text) as char_count, case when trim(text) <> '' then cast(1 as double) else 0 end as confidence from documents")
def text_hash_len(spark, d):
    return records.ocr_pages(v.table(spark, d, "documents")).select("doc_id", "text_sha256", "char_count", "confidence")


@_query("select doc_id, also_used_by from (select doc_id, lag(source) over (partition by sha256(text) order by doc_id) as also_used_by, source from documents) where also_used_by <> '' and also_used_by <> source")
def duplicate_text(spark, d):
    e = v.table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return quality.repeated_hashes(e, book="source", order="doc_id").select("doc_id", "also_used_by")


@_query(r"""select page_id, coalesce(nullif(trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'source-document') as book_id,
 coalesce(nullif(substr(trim(regexp_replace(lower(s), '[^a-z0-9]+', '_', 'g'), '_'), 1, 32), ''), 'document') || '_' || substr(sha256(html), 1, 8) as run_id from
 (select page_id, html, regexp_replace(regexp_replace(url, '^.*[/\\]', ''), '(.)\.[^.]*$', '\1') as s from pages)""")
def slug_ids(spark, d):
    p = v.table(spark, d, "pages")
    return p.select("page_id", t.slug(t.stem("url")).alias("book_id"), t.run_identity("url", F.sha2("html", 256)).alias("run_id"))


_VEC = "(select list_transform(embedding, lambda x: cast(x as double)) from embeddings where vec_id = 0)"


@_query(f"select vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: cast(x as double)), {_VEC}), 6) as score from embeddings order by 2 desc, 1 limit 10")
def cosine_topk(spark, d):
    e = v.table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first().embedding
    return retrieval.vector_top(e, q, 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@_query("""select * from (select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: cast(x as double)), list_transform(q.embedding, lambda x: cast(x as double))), 6) as score,
 cast(row_number() over (partition by q.vec_id order by round(list_cosine_similarity(list_transform(e.embedding, lambda x: cast(x as double)), list_transform(q.embedding, lambda x: cast(x as double))), 6) desc, e.vec_id) as int) as rank
 from embeddings e join embeddings q on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id) where rank <= 5""")
def cosine_self_join_topk(spark, d):
    e = v.table(spark, d, "embeddings")
    return retrieval.nearest_pairs(e, e.where("vec_id % 100 = 0"), 5)


@_query("select vec_id, 'embedding length must match provider dimensions' as issue from embeddings where len(embedding) <> 32")
def vector_quality(spark, d):
    return quality.issues(v.table(spark, d, "embeddings"), ["vec_id"], quality.vector_rules(32, "vec_id", None))


@_query("""select event_id, unnest(list_filter([case when user_id % 7 = 0 then 'book_id required' end, case when user_id % 11 < 1 then 'page_number invalid' end, case when event_id % 5 = 0 then 'text_sha256 mismatch' end,
 case when length(event_type) <> 5 then 'char_count mismatch' end, case when value > 100 then 'confidence invalid' end], lambda x: x is not null)) as issue from events""")
def ocr_quality(spark, d):
    e = v.table(spark, d, "events")
    sha = F.sha2("event_type", 256)
    rows = e.select("event_id", F.lit("c").alias("corpus_id"), F.when(F.col("user_id") % 7 != 0, "b").otherwise("").alias("book_id"), sha.alias("source_sha256"), (F.col("user_id") % 11).alias("page_number"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 5 == 0, "x").otherwise(sha).alias("text_sha256"), F.lit(5).alias("char_count"), (F.col("value") / 100).alias("confidence"))
    return quality.issues(rows, ["event_id"], quality.ocr_rules())


@_query("""select doc_id, unnest(list_filter([case when doc_id % 13 = 0 then 'display_name is required' end, case when doc_id % 17 = 0 then 'sha256 must be a 64-character hex digest' end, case when n_chars < 100 then 'page_count must be null or greater than zero' end,
 case when lang = 'de' and doc_id % 2 = 0 then 'private OCR requires a separate recorded approval gate' end, case when doc_id % 3 = 0 and doc_id % 2 = 1 then 'blocked entries require blocked_reason' end,
 case when doc_id % 3 <> 0 and doc_id % 2 = 0 then 'blocked_reason is only valid for blocked entries' end], lambda x: x is not null)) as issue from documents""")
def registry_quality(spark, d):
    x = v.table(spark, d, "documents")
    i = F.col("doc_id")
    rows = x.select(i, F.lit("c").alias("corpus_id"), F.lit("b").alias("book_id"), F.when(i % 13 == 0, "").otherwise("n").alias("display_name"), F.when(i % 17 == 0, "zz").otherwise(F.sha2("text", 256)).alias("sha256"), F.col("n_chars").alias("file_size_bytes"), F.floor(F.col("n_chars") / 100).alias("page_count"),
                    F.when(F.col("lang") == "de", "private_local_only").otherwise("synthetic").alias("privacy_class"), F.when(i % 2 == 0, "ocr_approved_private").otherwise("inventory_only").alias("processing_intent"), F.when(i % 3 == 0, "blocked").otherwise("inventoried").alias("intake_state"), F.when(i % 2 == 0, "why").alias("blocked_reason"))
    return quality.issues(rows, ["doc_id"], quality.registry_rules())


@_query(f"select t.record_type, cast(t.required as bigint) as required, coalesce(c.n, -1) as found from (values ('page', 10), ('table', 100000000), ('nothing', 1)) t(record_type, required) left join (select record_type, count(*) as n from {_RECORD} group by 1) c using (record_type) where coalesce(c.n, -1) < t.required")
def required_type_minimums(spark, d):
    return quality.below_minimum(v.records(spark, d), {"page": 10, "table": 100000000, "nothing": 1})


# the rule as Python has it: lines end at any of these signs, the last is one only if it isn't empty, and a finding's line is stripped
_EDGES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LINES = rf"""(select doc_id, line_number, line from (select doc_id, generate_subscripts(p, 1) as line_number, unnest(p) as line, len(p) as n from (
 select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') as p from documents)) where line_number < n or line <> '')"""
_DENY = {"hex token": r'token\s*=\s*"[0-9a-f]{40}', **quality.FORBIDDEN}


def _forbidden_sql() -> str:
    hits = ", ".join(f"case when regexp_matches(line, '{p}') then '{c}' end" for c, p in _DENY.items())
    return f"select doc_id, line_number, unnest(list_filter([{hits}], lambda x: x is not null)) as category, regexp_replace(regexp_replace(line, '^{_EDGES}', ''), '{_EDGES}$', '') as line from {_LINES}"


@_query(_forbidden_sql())
def secret_scan(spark, d):
    return quality.forbidden_lines(v.table(spark, d, "documents"), "doc_id", patterns=_DENY)


@_query(f"select category, count(*) as findings from ({_forbidden_sql()}) group by 1")
def secret_scan_counts(spark, d):
    return secret_scan(spark, d).groupBy("category").agg(F.count("*").alias("findings"))


_LINKED = "replace(html, 'href=\"', case when page_id % 3 = 0 then concat('HREF=', chr(39)) when page_id % 3 = 1 then 'Src=\"' else 'href=\"' end)"


@_query(f"""select * from (select page_id, unnest(list_distinct(regexp_extract_all(h, '(?:href|src)=["'']([^"'']+)["'']', 1, 'i'))) as link from (select page_id, {_LINKED} as h from pages)) where not contains(link, '://') and not starts_with(link, '#')""")
def html_links(spark, d):
    """Links in either quotes and any case; the pages' own are rewritten so."""
    return quality.links(v.table(spark, d, "pages").withColumn("html", F.expr(_LINKED)), "page_id")


@_query("""select user_id, array_to_string(list_sort(list_distinct(flatten([range(a, b + 1), [c]]))), ',') as pages from (
 select user_id, min(event_id) % 40 as a, greatest(min(event_id) % 40 + user_id % 7 - 2, 0) as b, max(event_id) % 50 as c from events group by 1)""")
def page_ranges(spark, d):
    e = v.table(spark, d, "events").groupBy("user_id").agg((F.min("event_id") % 40).alias("a"), (F.max("event_id") % 50).alias("c"))
    spec = F.concat(F.col("a"), F.lit("-"), F.greatest(F.col("a") + F.col("user_id") % 7 - 2, F.lit(0)), F.lit(", ,"), F.col("c"))
    return e.select("user_id", F.array_join(t.page_list(spec).cast("array<string>"), ",").alias("pages"))


@_query("select event_type, user_id, value, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as i from events) where i = 1")
def last_wins_merge(spark, d):
    return quality.last_wins(v.table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_type", "user_id", "value", "event_id")


@_query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_pending(spark, d):
    o, li = v.table(spark, d, "orders"), v.table(spark, d, "lineitem")
    return quality.pending(o.select("o_orderkey"), li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@_query("""select user_id, case when count(*) filter (event_type = 'error' and value > 100) > 0 then 'FAIL' when bool_or(value > 300) then 'PASS_WITH_VISUAL_BLOCKERS' else 'PASS' end as status,
 count(*) filter (not (event_type = 'error' and value > 100)) as passed, count(*) filter (event_type = 'error' and value > 100) as failed from events group by 1""")
def status_rollup(spark, d):
    e = v.table(spark, d, "events")
    bad = (F.col("event_type") == "error") & (F.col("value") > 100)
    return quality.rollup(e.select("user_id", F.when(bad, "FAIL").otherwise("PASS").alias("status"), (F.col("value") > 300).alias("blocked")), ["user_id"])


# --- boxes and layout -------------------------------------------------------------------------------------------------


@_query(f"select ord from {_BOX} a where kind <> 'R' and not exists (select 1 from {_BOX} b where b.kind = 'R' and b.page = a.page and {_over('a', 'b')} > 0.35)")
def box_overlap_antijoin(spark, d):
    b = v.boxes(spark, d)
    return layout.not_covered(b.where("kind <> 'R'"), b.where("kind = 'R'"), "ord").select("ord")


@_query(f"select a.ord as word, b.ord as block from {_BOX} a join {_BOX} b on a.page = b.page and a.kind <> 'R' and b.kind = 'R' and a.x0 >= b.x0 - 1 and a.y0 >= b.y0 - 1 and a.x1 <= b.x1 + 1 and a.y1 <= b.y1 + 1")
def box_contains_join(spark, d):
    b = v.boxes(spark, d)
    return layout.contained(b.where("kind <> 'R'"), b.where("kind = 'R'")).select(F.col("l.ord").alias("word"), F.col("r.ord").alias("block"))


@_query(f"""select a.ord as table_ord, b.ord as shape_ord, greatest(a.x0, b.x0) as x0, greatest(a.y0, b.y0) as y0, least(a.x1, b.x1) as x1, least(a.y1, b.y1) as y1 from {_BOX} a join {_BOX} b
 on a.page = b.page and a.kind = 'R' and b.kind <> 'R' and least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0)""")
def box_intersect_join(spark, d):
    b = v.boxes(spark, d)
    return layout.intersections(b.where("kind = 'R'"), b.where("kind <> 'R'")).select(F.col("l.ord").alias("table_ord"), F.col("r.ord").alias("shape_ord"), "shared.*")


@_query(f"""select ord from {_BOX} a where kind <> 'R' and exists (select 1 from {_BOX} b where b.kind = 'R' and b.page = a.page
 and (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(0.1, a.x1 - a.x0) >= 0.45 and b.y0 between a.y1 - 1 and a.y1 + 3)""")
def underline_semijoin(spark, d):
    b = v.boxes(spark, d)
    rules = b.where("kind = 'R'").withColumn("box", g.box("x0", "y0", "x1", "y0"))
    return layout.underlined(b.where("kind <> 'R'"), rules, "ord").select("ord")


_NEAR = f"""(select a.page, a.ord as id, b.ord as span, abs(a.x0 - b.x0) as away from {_WORD} a join {_WORD} b on a.page = b.page and a.word = b.word and a.ord % 2 = 0 and b.ord % 2 = 1 and abs(a.x0 - b.x0) <= 6)"""


@_query(f"select id, span, away from (select *, row_number() over (partition by page, id order by away, span) as i from {_NEAR}) where i = 1")
def nearest_span(spark, d):
    w = v.words(spark, d).withColumnRenamed("word", "text").withColumnRenamed("x0", "x")
    return layout.nearest_match(w.where("ord % 2 = 0").withColumnRenamed("ord", "id"), w.where("ord % 2 = 1").drop("x1")).select("id", "span", "away")


@_query(f"""select page, line_id, cell, string_agg(word, ' ' order by x0, ord) as text, min(x0) as x0, max(x1) as x1 from (select *, cast(sum(s) over (partition by page, line_id order by x0, ord rows unbounded preceding) as bigint) as cell from (
 select *, case when x0 - lag(x1) over (partition by page, line_id order by x0, ord) >= 60 then 1 else 0 end as s from {_WORD})) group by 1, 2, 3""")
def cells_by_gap(spark, d):
    return layout.row_cells(v.words(spark, d), ["page", "line_id"], 60.0)


_ROWTEXT = "case when event_id % 3 < 2 then cast(cast(value as int) as varchar) || ' ' || event_type else event_type end"


@_query(f"""select user_id, min(event_id) as first, max(event_id) as last, count(*) as rows from (select *, sum(case when n then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) as g from (
 select *, regexp_matches({_ROWTEXT}, '^\\s*(?:\\d{{1,4}}(?:[-–]\\d{{1,4}})?|\\d+d\\d+)\\b') as n from events)) where n group by user_id, g having count(*) >= 3""")
def numeric_runs(spark, d):
    text = F.when(F.col("event_id") % 3 < 2, F.concat(F.col("value").cast("decimal(20,0)").cast("string"), F.lit(" "), "event_type")).otherwise(F.col("event_type"))
    return layout.numeric_runs(v.table(spark, d, "events").withColumn("text", text), ["user_id"], "event_id")


@_query(f"""select ord, col as "column", cast(sum(s) over (partition by page order by col, y0, x0, ord rows unbounded preceding) as bigint) as paragraph from (
 select *, case when lag(ord) over w is null or col <> lag(col) over w or y0 - lag(y0) over w > 13.2 or (abs(y0 - lag(y0) over w) >= 1 and x0 in (45.0, 325.8)) then 1 else 0 end as s
 from (select *, case when x0 >= 300 then 1 else 0 end as col from {_BOX}) window w as (partition by page order by col, y0, x0, ord))""")
def paragraph_groups(spark, d):
    lines = v.boxes(spark, d).select("page", "ord", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return layout.paragraphs(lines).select("ord", "column", "paragraph")


@_query("""select event_id, first_value(case when event_type <> 'click' then value end ignore nulls) over (partition by user_id order by event_id rows between 1 following and unbounded following) as next_value from events""")
def next_nonblank(spark, d):
    e = v.table(spark, d, "events").withColumn("label", F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type")))
    return layout.next_filled(e, ["user_id"], "event_id", "value", "label").select("event_id", "next_value")


@_query(f"select page, round(min(x0), 3) as x0, round(min(y0), 3) as y0, round(max(x1), 3) as x1, round(max(y1), 3) as y1 from {_BOX} group by 1")
def bbox_union(spark, d):
    return v.boxes(spark, d).groupBy("page").agg(*g.union_box())


@_query("select user_id, list_sort(list(value))[count(*) // 2 + 1] as median from events group by 1")
def upper_median(spark, d):
    return v.table(spark, d, "events").groupBy("user_id").agg(layout.upper_median("value").alias("median"))


@_query(f"""select family, "char", round(avg(step), 9) as advance, count(*) as n from (select word as family, substr(word, 1 + cast(ord % 3 as int), 1) as "char", (lead(x0) over (partition by word, line_id, page order by ord) - x0) / 12 as step from {_WORD}) where step > 0 group by 1, 2""")
def char_advance(spark, d):
    w = v.words(spark, d).select(F.col("word").alias("family"), F.struct("page", "line_id").alias("line"), "ord", F.expr("substr(word, 1 + cast(ord % 3 as int), 1)").alias("char"), F.col("x0").alias("x"), F.lit(12.0).alias("size"))
    return layout.advances(w).select("family", "char", F.round("advance", 9).alias("advance"), "n")


@_query("""select event_id, case when value / 300 >= 0.85 and event_id % 256 >= 215 and user_id % 70 <= 35 then 'background_image' when event_id % 256 >= 245 and user_id % 70 <= 8 and event_id % 300 >= 250 then 'near_blank_image' else 'content_image' end as class from events""")
def image_class(spark, d):
    e = v.table(spark, d, "events")
    return e.select("event_id", tb.image_class(F.col("value") / 300, F.col("event_id") % 256, F.col("user_id") % 70, F.col("event_id") % 300).alias("class"))


_LABEL = "case when event_id % 4 = 0 then cast(event_id as varchar) when event_id % 4 = 1 then 'row of ' || event_id else event_type end"


@_query(f"""select ord, case when s >= 18 then 'heading' when l like '% %' and regexp_matches(l, '[0-9]$') then 'table_or_toc_row' when x1 - x0 < 612 * 0.22 and regexp_matches(l, '^[0-9]+$') then 'table_or_toc_page_number' when s <= 8 then 'caption_or_small_text' else 'body_line' end as class
 from (select b.*, e.l, cast(b.ord % 23 as double) as s from {_BOX} b join (select event_id, {_LABEL} as l from events) e on b.ord = e.event_id)""")
def layout_class(spark, d):
    e = v.table(spark, d, "events").select(F.col("event_id").alias("ord"), F.expr(_LABEL.replace("varchar", "string")).alias("l"))
    b = v.boxes(spark, d).join(e, "ord").withColumn("s", (F.col("ord") % 23).cast("double"))
    return b.select("ord", layout.layout_class("l", "s", "x0", "x1", 612.0).alias("class"))


_ROWS = "[[upper(event_type), '', cast(event_id % 9 as varchar), null], ['', ' '], [case when event_id % 5 = 0 then 'damage' when event_id % 5 = 1 then 'height weight' when event_id % 5 = 2 then 'sdc' else 'x' end, ' a ', '7 ']]"
_SPARK_ROWS = "array(array(upper(event_type), '', string(event_id % 9), null), array('', ' '), array(case when event_id % 5 = 0 then 'damage' when event_id % 5 = 1 then 'height weight' when event_id % 5 = 2 then 'sdc' else 'x' end, ' a ', '7 '))"


@_query("""select event_id, case when event_id % 5 = 0 then 'equipment_table' when event_id % 5 = 1 then 'height_weight_table' when event_id % 5 = 2 then 'stat_table' else 'structured_table' end as class from events""")
def table_class(spark, d):
    return v.table(spark, d, "events").select("event_id", tb.table_class(tb.padded(F.expr(_SPARK_ROWS))).alias("class"))


@_query(f"""select event_id, array_to_string(list_transform(list_transform(r, lambda x: list_resize(list_transform(x, lambda c: coalesce(c, '')), 4, '')), lambda x: array_to_string(x, '|')), '/') as cells from (select event_id, {_ROWS} as r from events)""")
def pad_cells(spark, d):
    rows = tb.padded(F.expr(_SPARK_ROWS))
    return v.table(spark, d, "events").select("event_id", F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), "/").alias("cells"))


@_query(f"""select event_id, upper(event_type) || '||' || cast(event_id % 9 as varchar) || '/' || r[3][1] || '|a|7' as cells from (select event_id, event_type, {_ROWS} as r from events)""")
def clean_rows(spark, d):
    rows = tb.cleaned(F.expr(_SPARK_ROWS))
    return v.table(spark, d, "events").select("event_id", F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), "/").alias("cells"))


@_query("""select event_id, case when ok then kind end as class, case when ok then round(case when kind = 'structured_table' then least(0.9, 0.5 + 0.25 * dense + 0.25 * numeric) else least(0.95, 0.55 + 0.25 * dense + 0.25 * numeric) end, 6) else 0 end as score from (
 select *, n >= 3 and (dense >= 0.45 or numeric >= 0.35) and (event_id % 4 < 3 or numeric >= 0.5) as ok, ['equipment_table', 'height_weight_table', 'stat_table', 'structured_table'][event_id % 4 + 1] as kind from (
 select event_id, n, case when 2 + (event_id % 2 = 0)::int + (event_id % 5 > 0)::int >= 3 then 1.0::double else 0 end as dense, case when event_id % 2 = 0 then len(list_filter(range(1, n + 1), lambda i: (event_id + i) % 3 > 0)) / n::double else 0 end as numeric
 from (select event_id, 2 + event_id % 4 as n from events)))""")
def table_score(spark, d):
    """Tables of two to five rows, more or less dense and numeric, under texts with and without a title."""
    text = F.expr("case event_id % 4 when 0 then 'table damage' when 1 then 'height weight' when 2 then 'sdc of it' else 'plain words' end")
    rows = F.expr("transform(sequence(1, int(2 + event_id % 4)), i -> array('a', if((event_id + i) % 3 > 0, '1', 'x'), if(event_id % 2 = 0, '$2', ' '), if(event_id % 5 > 0, 'b', '')))")
    s = tb.table_score(text, rows)
    return v.table(spark, d, "events").select("event_id", s["class"].alias("class"), F.round(s["score"], 6).alias("score"))


@_query(f"""select page, case when n < 3 or k < 3 then 'start' when rs <= 11 and ls >= 10 then 'end' when len(list_filter(big, lambda x: x >= big[k // 2 + 1] * 0.86)) >= greatest(3, cast(floor(k * 0.58) as int)) and rs <= 26 then 'justify' else 'start' end as align
 from (select *, len(big) as k from (select page, count(*) as n, max(x0) - min(x0) as ls, max(x1) - min(x1) as rs, list_sort(coalesce(list(x1 - x0) filter (x1 - x0 >= 80), [])) as big from {_BOX} group by 1))""")
def text_align(spark, d):
    return layout.text_align(v.boxes(spark, d).select("page", F.col("x0").alias("left"), F.col("x1").alias("right")), ["page"])


@_query(f"select page, ord, row_number() over (partition by page order by round(y0, 3), round(x0, 3), ord) as place from {_BOX}")
def reading_order(spark, d):
    return lines.reading_order(v.boxes(spark, d)).select("page", "ord", "place")


_VARIANT = "value / 500 as line_width, (event_id % 97) / 97.0 as source_line, (event_id % 89) / 89.0 as bounded, case when event_id % 3 > 0 then (event_id % 83) / 83.0 end as path_fidelity, case when event_id % 4 > 0 then (event_id % 79) / 79.0 end as background, event_id % 2 as tables, event_id % 5 as kept_widths, event_id % 7 as reflowed, event_id % 3 as converted, event_id % 31 = 0 as overlay"


@_query(f"""select event_id, case when overlay then 'ocr_editable_overlay' when tables = 0 and background is not null and background <= least(m, coalesce(path_fidelity, 1)) then 'source_render_background_hidden_editable_text'
 when tables = 0 and path_fidelity is not null and path_fidelity + 0.002 < m then 'path_fidelity_hidden_editable_text' when source_line + 0.005 < bounded or (kept_widths > 0 and reflowed > 0 and source_line <= bounded + 0.005) then 'source_line_preserving'
 when converted = 0 and reflowed = 0 then 'line_width_preserving' else 'bounded_textbox' end as variant from (select *, least(line_width, source_line, bounded) as m from (select event_id, {_VARIANT.replace(".0", "::double")} from events))""")
def variant_argmin(spark, d):
    e = v.sql(spark, d, f"select event_id, {_VARIANT.replace('.0', 'D')} from {{events}}")
    return e.select("event_id", quality.primary_variant().alias("variant"))


@_query("select conv_id, string_agg(text, ' ' order by turn) as text from conversations group by 1")
def transcript_text(spark, d):
    return lines.ordered_text(v.table(spark, d, "conversations"), ["conv_id"], "turn")


@_query("""select event_id, upper(printf('%06x', event_id * 7919 & 16777215)) as color, cast(round_even(value * 20, 0) as bigint) as twips,
 array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda k: case when event_id - 1 >= (26 ** (k + 1) - 26) / 25 then chr(cast(65 + ((event_id - 1 - cast((26 ** (k + 1) - 26) / 25 as bigint)) // cast(26 ** k as bigint)) % 26 as int)) else '' end), '') as name,
 abs((least(value, 9) + greatest(value, 9)) / 2 - 306) < 0.08 * 612 as centred from events""")
def scalar_rules(spark, d):
    e = v.table(spark, d, "events")
    b = F.struct(F.least("value", F.lit(9)).alias("x0"), F.greatest("value", F.lit(9)).alias("x1"))
    return e.select("event_id", t.color_hex(F.col("event_id") * 7919).alias("color"), t.twips("value").alias("twips"), t.column_name("event_id").alias("name"), (g.alignment(b, 612.0) == "center").alias("centred"))


@_query("""select doc_id, '0x' || substr(sha1(text), 1, 7) as h, regexp_matches(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 'experience|point|damage|roll|weapon|skill') and contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 'table') as titled,
 round(cast(11 * 0.48 as double) * (0.55 * (length(text) - length(replace(text, ' ', ''))) + 0.45 * length(regexp_replace(text, '[^ilI1.,'']', '', 'g')) + 1.25 * length(regexp_replace(text, '[^MW@#%]', '', 'g'))
 + length(replace(regexp_replace(text, '[ilI1.,''MW@#%]', '', 'g'), ' ', ''))), 3) as width from documents""")
def text_rules(spark, d):
    x = v.table(spark, d, "documents").withColumn("size", F.lit(11.0))
    return x.select("doc_id", F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(t.short_number("text")), 7, "0"))).alias("h"), t.table_title_like("text").alias("titled"), F.round(t.text_width("text", "size"), 3).alias("width"))


# --- without a twin: hashes that DuckDB lacks, and folds that depend on order -----------------------------------------


@_query()
def hash_embed(spark, d):
    r = v.table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("record_id"), "text")
    return retrieval.vector_index(r, retrieval.HashProvider()).select("doc_id", "chunk_id", "embedding")


@_query()
def hash_vector_search(spark, d):
    r = v.table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("record_id"), "text")
    provider = retrieval.HashProvider()
    return retrieval.vector_search(retrieval.vector_index(r, provider), "tion the and of", provider)


@_query()
def ocr_tables(spark, d):
    e = v.table(spark, d, "events").select(F.expr("event_id div 30").alias("page"), F.col("event_id").alias("ord"), F.expr("event_id % 30 div 3").alias("row"), (F.col("event_id") % 3).alias("col"), "event_type")
    text = F.when((F.col("col") == 0) & (F.col("row") < 6), F.col("ord").cast("string")).otherwise(F.col("event_type"))
    e = e.select("page", "ord", text.alias("text"), *[x.cast("double").alias(n) for n, x in (("x0", 40 + F.col("col") * 60), ("y0", 100 + F.col("row") * 14), ("x1", 70 + F.col("col") * 60), ("y1", 110 + F.col("row") * 14))])
    return layout.ocr_tables(e).select("page", "table", "class", "confidence", F.to_json("rows").alias("rows"))


from . import catalog_folds, catalog_lines, catalog_packet  # noqa: E402  they use the fragments above


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _Q | catalog_lines.queries() | catalog_packet.queries() | catalog_folds.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | catalog_lines.oracle_sql() | catalog_packet.oracle_sql() | catalog_folds.oracle_sql()
