"""Queries of pages and what belongs to them, of completeness, reports, manifests and searchability, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _clean, _norm
from .functions import text as t
from .operators import packet, quality, records
from .plans import views as v
from .sources import files

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_RECORD, _BOX = f"({v.duck(v.RECORD)})", f"({v.duck(v.BOX)})"


def _query(sql: str):
    def add(f):
        _Q[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _events(spark, d):
    return v.table(spark, d, "events")


# --- pages and what belongs to them -----------------------------------------------------------------------------------


@_query("select p.page_id, c.turn, c.role from pages p join conversations c on p.page_id % 40 = c.conv_id")
def book_pages(spark, d):
    book = v.table(spark, d, "pages").select("page_id", F.concat(F.lit("m"), (F.col("page_id") % 40).cast("string")).alias("manifest"))
    manifests = v.table(spark, d, "conversations").select(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("path"), "turn", "role")
    return packet.book_pages(book, manifests).select("page_id", "turn", "role")


@_query("select page_id as page, coalesce(n, 0) as ocr from pages left join (select conv_id, count(*) filter (role <> 'system') as n from conversations group by 1) on conv_id = page_id")
def side_files(spark, d):
    c = v.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("page")).agg(F.collect_list(F.struct("role")).alias("ocr"))
    c = c.withColumn("ocr", F.transform("ocr", lambda x: F.when(x["role"] != "system", x["role"])))
    return packet.with_side_file(v.table(spark, d, "pages").select(F.col("page_id").alias("page")), c, "array<string>").select("page", F.size("ocr").cast("long").alias("ocr"))


@_query("select page_id, 'in/' || page_id || '.pdf' as path, sha256(html) as sha256, strlen(html) as bytes from pages")
def source_files(spark, d):
    p = v.table(spark, d, "pages")
    name = F.concat("page_id", F.lit(".pdf"))
    listing = p.select(F.concat(F.lit("in/"), name).alias("path"), F.col("html").cast("binary").alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    entries = packet.with_sources(p.select("page_id", name.alias("source_path")), listing, "in/")
    return entries.select("page_id", "path").join(files.checksums(listing), "path").select("page_id", "path", "sha256", "bytes")


@_query("select event_id, coalesce(n_name, '') as label, n_name is not null as priority, contains(printf('%03d', event_id % 300), '012') as found, n_name is not null and contains(printf('%03d', event_id % 300), '212') as both from events left join nation on n_nationkey = user_id")
def page_labels(spark, d):
    labels = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_name").alias("label"))
    p = packet.with_labels(_events(spark, d).withColumnRenamed("user_id", "page"), labels)
    page = F.format_string("%03d", F.col("event_id") % 300)
    return p.select("event_id", "label", "priority", packet.shown(page, F.col("priority"), " 12", False).alias("found"), packet.shown(page, F.col("priority"), "212", True).alias("both"))


def _extracted(spark, d):
    """Pages as extraction gives them: a conversation's turns are its regions and OCR rows, and it has two tables and images."""
    c = v.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    cell = F.array(F.array(F.lit("a"), F.concat(F.lit("c"), F.col("conv_id").cast("string"))), F.array(F.lit(""), F.lit("z")))
    table = lambda k: F.struct(F.lit(f"Table{k}").alias("caption"), F.lit("").alias("title"), F.lit(None).cast("string").alias("text"), F.lit("t.csv").alias("csv"), F.lit("").alias("file"), cell.alias("rows"))
    image = F.struct(F.concat(F.lit("i"), F.col("conv_id").cast("string")).alias("image_id"), F.lit("photo").alias("classification"), F.lit("review").alias("review_role"), F.lit(640).alias("width_px"), (F.col("conv_id") + 1).cast("int").alias("height_px"))
    return c.select(
        F.lit("").alias("book_id"), F.col("conv_id").alias("page"),
        F.transform("x", lambda r: F.struct(F.concat(F.lit("r"), r["turn"].cast("string")).alias("region_id"), F.when(r["role"] == "system", "  ").otherwise(r["text"]).alias("text"), F.when(r["role"] == "user", "normal_editable_text").otherwise("other").alias("classification"), r["role"].alias("layout_class"))).alias("textbox_regions"),
        F.transform("x", lambda r: F.struct(F.when(r["turn"] % 2 == 0, F.concat(F.lit("o"), r["turn"].cast("string"))).otherwise("").alias("region_id"), r["role"].alias("text"))).alias("ocr"),
        F.array(table(1), table(2)).alias("tables"), F.array(image).alias("embedded_images"),
    )


_TEXT = "case when role = 'system' then '  ' else text end"
_ID = "'book::' || printf('p%03d', conv_id) || '::'"


@_query(f"""with c as (select *, cast(row_number() over (partition by conv_id order by turn, role, text) as int) as i from conversations),
 whole as (select conv_id, concat_ws(' ', string_agg({_clean(_TEXT)}, ' ' order by i) filter ({_clean(_TEXT)} <> ''), string_agg({_clean('role')}, ' ' order by i) filter ({_clean('role')} <> '')) as s from c group by 1)
 select {_ID} || 'page::page' as record_id, 'page' as record_type, {_norm('s')} as text, cast(conv_id as int) as page from whole
 union all select {_ID} || 'text_region::r' || turn, 'text_region', {_norm(_TEXT)}, cast(conv_id as int) from c where {_clean(_TEXT)} <> ''
 union all select {_ID} || 'ocr_text::' || case when turn % 2 = 0 then 'o' || turn else printf('ocr_%04d', i) end, 'ocr_text', {_norm('role')}, cast(conv_id as int) from c where {_clean('role')} <> ''
 union all select {_ID} || 'table::table_' || printf('%03d', k), 'table', {_norm("'Table' || k || ' t.csv a c' || conv_id || ' z'")}, cast(conv_id as int) from (select distinct conv_id from conversations), (values (1), (2)) t(k)
 union all select {_ID} || 'image::i' || conv_id, 'image', {_norm("'photo review 640x' || (conv_id + 1)")}, cast(conv_id as int) from (select distinct conv_id from conversations)""")
def records_from_extracted(spark, d):
    return records.from_pages(_extracted(spark, d)).select("record_id", "record_type", "text", "page")


@_query("select conv_id as page, cast(count(*) as int) as textboxes, cast(count(*) filter (role = 'user') as int) as normal, 2 as tables, 1 as images from conversations group by 1")
def page_summary(spark, d):
    return packet.page_summary(_extracted(spark, d))


_CELLS = "array(array(upper(event_type), '', string(event_id % 9), null), array('', ' '), array(case when event_id % 2 = 0 then 'x' else '' end, ' a '))"


@_query("select event_id, cast(3 + (event_id % 2 = 0)::int as int) as cells from events")
def editable_cells(spark, d):
    return _events(spark, d).select("event_id", packet.editable_cells(F.expr(_CELLS)).alias("cells"))


@_query("select event_id, upper(event_type) || '||' || event_id % 9 || '|/| ||/' || case when event_id % 2 = 0 then 'x' else '' end || '| a ||' as cells, 'scan' as extraction_method from events")
def table_records(spark, d):
    r = packet.table_record(_events(spark, d).withColumn("cells", F.expr(_CELLS)), "scan")
    return r.select("event_id", F.array_join(F.transform("cells", lambda x: F.array_join(x, "|")), "/").alias("cells"), "extraction_method")


@_query("""select event_id, unnest(list_filter([case when user_id % 7 = 0 then 'book_id required' end, case when event_id % 11 < 1 then 'page_number invalid' end, case when event_id % 5 = 0 then 'cells required' end,
 case when event_id % 5 = 1 then 'cells rows must have a consistent width' end, case when event_id % 5 = 2 then 'cells values must be strings' end, case when value > 100 then 'confidence invalid' end], lambda x: x is not null)) as issue from events""")
def table_quality(spark, d):
    cells = F.expr("case event_id % 5 when 0 then array() when 1 then array(array('a', 'b'), array('c')) when 2 then array(array('a', null), array('b', 'c')) else array(array('a', 'b'), array('c', 'd')) end")
    rows = _events(spark, d).select("event_id", F.lit("c").alias("corpus_id"), F.when(F.col("user_id") % 7 != 0, "b").otherwise("").alias("book_id"), F.sha2("event_type", 256).alias("source_sha256"), (F.col("event_id") % 11).alias("page_number"), F.lit("t").alias("table_id"), cells.alias("cells"), (F.col("value") / 100).alias("confidence"))
    return quality.issues(rows, ["event_id"], quality.table_rules())


_NUMBERED = "(select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 5 as chunk from events where event_id % 3 > 0)"


@_query(f"""select user_id, cast(chunk as int) as chunk, case when count(*) = 1 then printf('%03d', min(event_id)) else printf('%03d-%03d', min(event_id), max(event_id)) end as label,
 case when count(*) > 1 and max(event_id) - min(event_id) + 1 = count(*) then min(event_id) || '-' || max(event_id) else string_agg(event_id, ',' order by event_id) end as pages from {_NUMBERED} group by 1, 2""")
def page_chunks(spark, d):
    e = _events(spark, d).where("event_id % 3 > 0").select(F.col("user_id").alias("book"), F.col("event_id").alias("page"))
    return packet.page_chunks(e, 5).select(F.col("book").alias("user_id"), "chunk", t.chunk_label("pages").alias("label"), t.page_filter("pages").alias("pages"))


@_query("""select page_id, case when page_id % 2 = 0 then 'a/' || page_id else '/other/' || page_id end as relative, case page_id % 3 when 0 then '' when 1 then '/abs/' || page_id else '/root/x/' || page_id end as artifact from pages""")
def artifact_paths(spark, d):
    p = v.table(spark, d, "pages")
    path = F.expr("case when page_id % 2 = 0 then concat('/root/x/a/', page_id) else concat('/other/', page_id) end")
    artifact = F.expr("case page_id % 3 when 1 then concat('/abs/', page_id) when 2 then string(page_id) end")
    return p.select("page_id", packet.relative_path(path, F.lit("/root/x/")).alias("relative"), packet.artifact_path(artifact, F.lit("/root/x")).alias("artifact"))


@_query(r"""select doc_id, array_to_string(case when len(l) > 3 then l[len(l) - 2:] else l end, chr(10)) as tail from (select doc_id, case when p[len(p)] = '' then p[:len(p) - 1] else p end as l from (
 select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') as p from documents))""")
def log_tails(spark, d):
    return v.table(spark, d, "documents").select("doc_id", packet.log_tail(F.col("text"), 3).alias("tail"))


# --- text recognition, gates ------------------------------------------------------------------------------------------


@_query("""select event_id, case when event_id % 3 = 0 then event_type else 'own' end as text, event_id % 3 > 0 as fallback, case when event_id % 3 = 0 then event_type else '' end as strict, 'pymupdf_text_blocks' as without from events""")
def recognized_text(spark, d):
    found, own = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, ""), F.lit("own")
    e = _events(spark, d).select("event_id", packet.recognized(own, found).alias("a"), packet.recognized(own, found, allowed=False).alias("b"), packet.recognized(own, found, engine=False, reason="none installed").alias("c"))
    return e.select("event_id", "a.text", "a.fallback", F.col("b.text").alias("strict"), F.col("c.engine").alias("without"))


@_query("select user_id, string_agg(event_type, chr(10) order by event_id) as text, round(avg(value), 6) as confidence, bool_or(event_type = 'error') as fallback from events group by 1")
def recognition_summary(spark, d):
    e = _events(spark, d).select("user_id", "event_id", F.col("event_type").alias("text"), F.col("value").alias("confidence"), (F.col("event_type") == "error").alias("fallback"))
    return packet.recognition_summary(e, ["user_id"], "event_id").select("user_id", "text", F.round("confidence", 6).alias("confidence"), "fallback")


@_query(f"select page, case when bool_or(kind = 'R' and x1 - x0 > 400) and sum(cast(ord % 50 = 0 as int)) = 0 then 'NEEDS_ILLUSTRATION_AWARE_EQUIPMENT_CALIBRATION' else 'READY_FOR_USER_REVIEW' end as gate from {_BOX} group by 1")
def visual_gates(spark, d):
    b = v.boxes(spark, d).withColumn("classification", F.when(F.col("kind") == "R", "equipment_table").otherwise("stat_table"))
    return packet.visual_gate(b, ["page"], (F.col("ord") % 50 == 0).cast("int"))


# --- completeness and reports -----------------------------------------------------------------------------------------

_LISTED = "event_type in ('click', 'view', 'purchase') and value < 200"


@_query(f"""select event_id as page, a and b and c as complete from (select event_id, event_id % 4 > 0 and l as a, l as b, event_id % 9 > 0 as c from (select event_id, {_LISTED} as l from events))""")
def complete_pages(spark, d):
    e = _events(spark, d)
    name = lambda n: F.concat(F.lit(n + "/"), F.col("event_id").cast("string"))
    pages = e.select(F.col("event_id").alias("page"), F.when(F.col("event_id") % 4 != 0, name("a")).alias("a"), name("b").alias("b"), name("c").alias("c"))
    listing = e.where(_LISTED).select(F.explode(F.array(name("a"), name("b"))).alias("path")).unionByName(e.where("event_id % 9 > 0").select(name("c").alias("path")))
    return packet.complete_pages(pages, listing, ("a", "b", "c"))


@_query("select user_id as chunk from events group by 1 having bool_or(event_type = 'error' or event_id % 7 = 0)")
def chunks_to_run(spark, d):
    e = _events(spark, d)
    name = F.concat(F.lit("x"), F.col("event_id").cast("string"))
    chunks = e.groupBy(F.col("user_id").alias("chunk")).agg(F.collect_list(F.col("event_id")).alias("pages"))
    pages = e.select(F.col("event_id").alias("page"), F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("status"), *[name.alias(n) for n in packet.RESUMED])
    return packet.chunks_to_run(chunks, pages, e.where("event_id % 7 > 0").select(name.alias("path"))).select("chunk")


@_query("""select doc_id as page, case when e is null then 'PASS' else 'FAIL' end as validation_status, coalesce(e, '') as validation_errors from documents left join (
 select event_id % 400 as page, string_agg(event_type || ' ' || event_id, ' | ' order by event_id) as e from events where event_type = 'error' group by 1) on page = doc_id""")
def validation_report(spark, d):
    errors = _events(spark, d).where("event_type = 'error'").select((F.col("event_id") % 400).alias("page"), F.col("event_id").alias("ord"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("message"))
    return packet.validation_report(v.table(spark, d, "documents").select(F.col("doc_id").alias("page")), errors)


@_query("""select printf('%03d', page_id) as page, coalesce(n_name, '') as priority_label, case when page_id % 2 = 0 then 'bounded_textbox' else '' end as primary_review_variant, url as page_review_sheet, case when page_id % 3 > 0 then 'full/' || page_id else '' end as fullres
 from pages left join nation on n_nationkey = page_id""")
def packet_manifest(spark, d):
    p = v.table(spark, d, "pages")
    full = F.concat(F.lit("full/"), F.col("page_id").cast("string"))
    pages = p.select(F.col("page_id").alias("page"), F.when(F.col("page_id") % 2 == 0, "bounded_textbox").alias("primary_review_variant"), F.col("url").alias("page_review_sheet"), full.alias("fullres"))
    labels = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_name").alias("label"))
    return packet.packet_manifest(pages, labels, p.where("page_id % 3 > 0").select(full.alias("path")))


@_query("select event_id as run, coalesce(case event_id % 3 when 0 then 'PASS' when 1 then 'FAIL' end, 'UNKNOWN') as status, case when event_id % 3 = 0 then 'PASS' else 'FAIL' end as audit, cast(case when event_id % 3 = 1 then 2 else 0 end as int) as errors from events")
def gate_reports(spark, d):
    e = _events(spark, d)
    return packet.gate_report(e.select(F.col("event_id").alias("run"), F.expr("case event_id % 3 when 0 then 'PASS' when 1 then 'FAIL' end").alias("status"), F.expr("case when event_id % 3 = 1 then array('a', event_type) end").alias("failures")))


# --- searchability and manifests --------------------------------------------------------------------------------------

_JSON = """concat('{"schema_version":"', case when event_id % 5 = 0 then 'v1' else 'v3' end, '","record_id":"r","book_id":"b","source_pdf_sha256":"s","page":1,', case when event_id % 3 = 0 then '' else '"page_id":"p",' end,
 case when event_id % 4 = 0 then '' else '"artifact_path":"",' end, '"record_type":"page","text":"t","metadata":', case when event_id % 7 = 0 then '[]' else '{}' end, '}')"""


@_query("""select event_id, unnest(list_filter([case when m <> '' then 'missing fields: ' || m end, case when event_id % 5 = 0 then 'unexpected schema_version' end, case when event_id % 7 = 0 then 'metadata is not an object' end], lambda x: x is not null)) as issue
 from (select event_id, concat_ws(', ', case when event_id % 4 = 0 then 'artifact_path' end, case when event_id % 3 = 0 then 'page_id' end) as m from events)""")
def record_issues(spark, d):
    return packet.record_issues(_events(spark, d).withColumn("j", F.expr(_JSON)), "event_id", "j", "v3")


@_query(f"select record_type, count(*) as found, case record_type when 'page' then 1 when 'table' then 40 else -1 end as listed from {_RECORD} group by 1 having count(*) <> case record_type when 'page' then 1 when 'table' then 40 else -1 end")
def count_mismatches(spark, d):
    return packet.count_mismatches(v.records(spark, d), spark.createDataFrame([("page", 1), ("table", 40)], "record_type string, records long")).select("record_type", "found", F.col("listed").cast("int").alias("listed"))


@_query(f"""select 'record type nothing count 0 is below required minimum 1' as error union all select format('record type page count {{}} is below required minimum 100000000', count(*)) from {_RECORD} where record_type = 'page'
 union all select 'query produced no hits: zzqqxx' union all select 'query produced no page hits: conversationzz'""")
def searchability(spark, d):
    return packet.searchability(v.records(spark, d), {"page": 100_000_000, "nothing": 1}, [(None, "the"), (None, "zzqqxx"), ("page", "conversationzz"), ("ocr_text", "the")])


@_query(r"""select page, cast(i as bigint) as line_number from (select event_id as page, generate_subscripts(p, 1) as i, unnest(p) as line from (select event_id, regexp_split_to_array(case event_id % 4 when 0 then event_type || chr(10) || 'c:\users\x' when 1 then '/mnt/d/x' || chr(10) else event_type end, '\n') as p from events))
 where regexp_matches(line, '(?i)(?:[A-Z]:\\(?:Projects|Users)\\|/mnt/[a-z]/)')""")
def path_leaks(spark, d):
    text = F.expr(r"case event_id % 4 when 0 then concat(event_type, chr(10), 'c:', chr(92), 'users', chr(92), 'x') when 1 then concat('/mnt/d/x', chr(10)) else event_type end")
    leaks = packet.path_leaks(_events(spark, d).select(F.col("event_id").alias("path"), text.alias("text")))
    return leaks.select(F.col("path").alias("page"), "line_number")


_ENTRY = "select event_id, user_id as manifest, 'c' as corpus_id, case when event_id % 13 = 0 then '' else concat('b', event_id % 3) end as book_id, 'n' as display_name, sha2(string(event_id % 40), 256) as sha256, event_id as file_size_bytes, event_id % 5 as page_count, 'synthetic' as privacy_class, 'inventory_only' as processing_intent, case when event_id % 6 = 0 then 'blocked' else 'inventoried' end as intake_state, '' as blocked_reason from {events}"


@_query("""with e as (select *, row_number() over (partition by user_id order by event_id) - 1 as i, case when event_id % 13 = 0 then '' else 'b' || event_id % 3 end as book, event_id % 40 as sha from events),
 l as (select *, lag(book) over (partition by user_id, sha order by i) as also from e)
 select user_id as manifest, 'manifest_version' as path, 'unsupported manifest_version' as message from events where user_id % 3 = 0 group by 1
 union all select user_id, 'batch_id', 'batch_id is required' from events where user_id % 4 = 0 group by 1
 union all select user_id, 'entries[' || i || '].book_id', 'book_id is required' from e where event_id % 13 = 0
 union all select user_id, 'entries[' || i || '].page_count', 'page_count must be null or greater than zero' from e where event_id % 5 = 0
 union all select user_id, 'entries[' || i || '].blocked_reason', 'blocked entries require blocked_reason' from e where event_id % 6 = 0
 union all select user_id, 'entries[' || i || '].sha256', 'duplicate source hash also used by ' || also from l where also <> '' and also <> book""")
def manifest_issues(spark, d):
    rows = v.sql(spark, d, _ENTRY)
    names = [c for c in rows.columns if c not in ("manifest", "event_id")]
    m = rows.groupBy("manifest").agg(F.array_sort(F.collect_list(F.struct("event_id", *names))).alias("entries"))
    m = m.withColumn("manifest_version", F.when(F.col("manifest") % 3 == 0, "old").otherwise(packet.INTAKE_VERSION)).withColumn("batch_id", F.when(F.col("manifest") % 4 != 0, "b"))
    return packet.manifest_issues(m)


@_query("""select event_id as "index", case when event_id % 5 = 0 then 'source_index.path and source_index.sha256 are required' else 'source index SHA-256 does not match vector index metadata; rebuild the vector index' end as issue from events
 where event_id % 5 = 0 or (event_id % 3 = 0 and event_id % 4 > 0)""")
def stale_indexes(spark, d):
    e = _events(spark, d)
    path = F.concat(F.lit("f"), F.col("event_id").cast("string"))
    good = F.sha2("event_type", 256)
    indexes = e.select(F.col("event_id").alias("index"), path.alias("path"), F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 3 == 0, "old").otherwise(good).alias("sha256"))
    return packet.stale_indexes(indexes, e.where("event_id % 4 > 0").select(path.alias("path"), F.col("event_type").cast("binary").alias("content")))


@_query("select event_id as root, case when event_id % 4 = 0 then 'another source' else 'another book' end as conflict from events where event_id % 2 = 0 and (event_id % 4 = 0 or event_id % 6 = 0)")
def pipeline_conflicts(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("root"), F.lit("s").alias("sha256"), F.lit("b").alias("book_id"))
    old = e.where("root % 2 = 0").withColumn("sha256", F.when(F.col("root") % 4 == 0, "t").otherwise("s")).withColumn("book_id", F.when(F.col("root") % 6 == 0, "c").otherwise(""))
    return packet.pipeline_conflicts(e, old)


_FILE = "case doc_id % 6 when 0 then concat('source/own', doc_id, '.pdf') when 1 then concat('source/sample_', doc_id, '.pdf') when 2 then concat('a/__pycache__/m', doc_id, '.pyc') when 3 then concat('docs/secret', doc_id, '.MD') when 4 then concat('.git/x', doc_id, '.txt') else concat('a/b', doc_id, '.txt') end"


@_query(f"""with f as (select doc_id, {_FILE} as path, text from documents), p as (select * from f where doc_id % 6 in (1, 3, 5) and regexp_matches(text, '(?i)password|secret')),
 l as (select path, generate_subscripts(x, 1) as line_number, unnest(x) as line from (select path, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as x from p))
 select path, 0 as line_number, 'private source pdf' as category from f where doc_id % 6 = 0 union all select path, 0, 'generated file' from f where doc_id % 6 = 2
 union all select path, 0, 'wording' from f where doc_id % 6 = 3 union all select path, line_number, 'wording' from l where regexp_matches(line, '(?i)password|secret')""")
def export_findings(spark, d):
    f = v.table(spark, d, "documents").select(F.expr(_FILE).alias("path"), "text")
    return quality.export_findings(f, r"^source/sample_\d+\.pdf$", {"wording": "(?i)password|secret"}).select("path", "line_number", "category")


# --- pictures, selections, sources ------------------------------------------------------------------------------------


@_query("""select event_id, round(len(list_filter(range(0, 20), lambda i: abs((event_id * 7 + i * 13) % 256 - (user_id * 11 + i * 29) % 256) > 24)) / 20.0::double, 6) as ratio from events""")
def picture_differences(spark, d):
    a, b = F.expr("transform(sequence(0, 19), i -> (event_id * 7 + i * 13) % 256)"), F.expr("transform(sequence(0, 19), i -> (user_id * 11 + i * 29) % 256)")
    return _events(spark, d).select("event_id", F.round(packet.diff_ratio(a, b), 6).alias("ratio"))


@_query("""select event_id, round((list_avg(a) + list_avg(b)) / 2, 4) as mean, round((list_stddev_pop(a) + list_stddev_pop(b)) / 2, 4) as contrast from (
 select event_id, list_transform(range(0, 9), lambda i: (event_id * 7 + i * 13) % 256) as a, list_transform(range(0, 9), lambda i: (event_id + i * i) % 100) as b from events)""")
def picture_statistics(spark, d):
    c = F.expr("array(transform(sequence(0, 8), i -> double((event_id * 7 + i * 13) % 256)), transform(sequence(0, 8), i -> double((event_id + i * i) % 100)))")
    return _events(spark, d).select("event_id", packet.channel_stats(c).alias("s")).select("event_id", F.round("s.mean", 4).alias("mean"), F.round("s.contrast", 4).alias("contrast"))


@_query("select event_id, cast(row_number() over (partition by user_id order by case when event_type = 'click' then 0 else 1 end, value, event_id) as int) as place from events")
def image_order(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("page"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "click", "background_image").otherwise("content_image").alias("classification"), F.col("value").alias("area"))
    return packet.image_order(e).select(F.col("ord").alias("event_id"), "place")


@_query("select event_id, event_id % 60 as page from events where event_id % 60 in (3, 4, 5, 9, 41, 50) and event_id % 60 between 4 and 45")
def selected_pages(spark, d):
    e = _events(spark, d).select("event_id", (F.col("event_id") % 60).alias("page"))
    return packet.selected_pages(e, t.page_list(F.lit("3-5,9,41,50")).cast("array<bigint>"), 4, 45)


@_query("""select event_id, case event_id % 4 when 0 then 'private_workspace' when 1 then 'public_repo' when 2 then 'external' else 'private_workspace' end as class from events""")
def path_classes(spark, d):
    path = F.expr("case event_id % 4 when 0 then concat('/pub/own/', event_id) when 1 then concat('/pub/', event_id) when 2 then concat('/pub', event_id) else '/pub/own' end")
    return _events(spark, d).select("event_id", packet.path_class(path, "/pub/own", "/pub").alias("class"))


@_query("select user_id, coalesce(min(event_type) filter (value > 150), 'default') as path from events group by 1")
def first_or_default(spark, d):
    e = _events(spark, d).withColumn("path", F.when(F.col("value") > 150, F.col("event_type")))
    return packet.first_or(e, ["user_id"], F.lit("default"))


@_query("""select event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","label":' || case when event_id % 2 = 0 then '"x"' else 'null' end || '}' as j, event_type || 'a&b' as text from events""")
def sorted_json(spark, d):
    e = _events(spark, d).withColumn("label", F.when(F.col("event_id") % 2 == 0, "x"))
    return e.select("event_id", packet.sorted_json(["label", "event_type", "event_id"]).alias("j"), packet.element_text(F.concat(F.lit("<text><tspan x='1'>"), "event_type", F.lit("</tspan><tspan>a&amp;b</tspan></text>"))).alias("text"))


@_query(f"""with b as (select * from {_BOX}), t as (select * from b where kind = 'R' and ord % 2 = 0)
 select page, ord, case when ord % 3 = 0 then 'equipment_table' else 'structured_table' end as class, 0.98::double as confidence from t
 union all select page, ord, 'stat_table', 0.95::double from b where kind = 'click' and ord % 5 > 0 and not exists (select 1 from t where t.page = b.page and greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) / greatest(1, (b.x1 - b.x0) * (b.y1 - b.y0)) > 0.35)""")
def page_tables(spark, d):
    """Detected tables (some too small), and blocks whose cells are all numbers."""
    b = v.boxes(spark, d)
    found = b.where("kind = 'R'").withColumn("rows", F.expr("case when ord % 2 = 0 then array(array('a', case when ord % 3 = 0 then 'Damage' else 'b' end), array('c', ' d')) else array(array('a', 'b'), array(' ', '')) end"))
    blocks = b.where("kind = 'click'").withColumn("text", F.lit("SDC table")).withColumn("rows", F.expr("array_repeat(array('a', '1', '2', case when ord % 5 = 0 then null else '3' end), case when ord % 5 = 0 then 2 else 4 end)"))
    return packet.page_tables(found, blocks)


# --- files ------------------------------------------------------------------------------------------------------------


@_query("""select 'c' as corpus_id, 'page-' || page_id || '-a' as book_id, 'Page ' || page_id || ' (A)' as display_name, 'x/Page ' || page_id || ' (A).pdf' as source_path, sha256(html) as sha256, cast(strlen(html) as bigint) as file_size_bytes from pages""")
def registry_entries(spark, d):
    listing = v.table(spark, d, "pages").select(F.concat(F.lit("file:/in/x/Page "), "page_id", F.lit(" (A).pdf")).alias("path"), F.col("html").cast("binary").alias("content"))
    r = records.registry_entries(listing.withColumn("length", F.octet_length("content").cast("long")), "c", "/in")
    return r.select("corpus_id", "book_id", "display_name", "source_path", "sha256", "file_size_bytes")


@_query("select path from (select *, row_number() over (partition by lower(path) order by event_id desc) as i from (select event_id, case when event_id % 2 = 0 then 'A/' else 'a/' end || event_type || event_id % 50 as path from events)) where i = 1")
def distinct_paths(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("ord"), F.expr("concat(case when event_id % 2 = 0 then 'A/' else 'a/' end, event_type, event_id % 50)").alias("path"))
    return files.distinct_paths(e)


@_query("select event_type || event_id as id, cast(event_id as double) as x, value as y, 3.0::double as w, 4.0::double as h from events where event_id % 3 > 0 and event_id % 4 > 0")
def bounds_rows(spark, d):
    e = _events(spark, d).selectExpr("concat(event_type, event_id, ',', event_id, ',', value, ',3,', case when event_id % 4 = 0 then 'none' else '4' end, case when event_id % 3 = 0 then ',5' else '' end) as value")
    return files.bounds_rows(e)


@_query(f"select record_type, count(*) as records from (select record_type from {_RECORD} union all select 'text_region' from documents) group by 1")
def union_counts(spark, d):
    more = v.table(spark, d, "documents").select(F.lit("text_region").alias("record_type"), "doc_id")
    return records.counts(records.union([v.records(spark, d), more]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
