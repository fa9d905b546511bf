"""Runs, manifests and review packets: joins of pages with what belongs to them, completeness, reports and searchability."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import padded, stripped
from . import quality
from .quality import text_lines

#: Required fields and versions, artifacts of a finished page, internal paths, the private workspace.
RECORD_FIELDS = ("schema_version", "record_id", "book_id", "source_pdf_sha256", "page", "page_id", "record_type", "text", "artifact_path", "metadata")
ARTIFACTS = ("portable_svg", "render", "edit_test_svg", "edit_test_render", "non_table_edit_test_svg", "non_table_edit_test_render", "diff", "primary_review_svg", "primary_review_render", "primary_review_edit_test_svg", "primary_review_edit_test_render", "primary_review_diff")
RESUMED = ("primary_review_svg", "primary_review_render", "primary_review_diff")
INTERNAL_PATH = r"(?i)(?:[A-Z]:\\(?:Projects|Users)\\|/mnt/[a-z]/)"
INTAKE_VERSION = "0.4.0-intake-v1"


# --- pages and what belongs to them -----------------------------------------------------------------------------------


def book_pages(book: DataFrame, manifests: DataFrame) -> DataFrame:
    """A book's pages (page, manifest) with their manifests (path, ...), by path; a page without one is left out."""
    return book.join(manifests.withColumnRenamed("path", "manifest"), "manifest")


def with_side_file(pages: DataFrame, ocr: DataFrame, kind: str) -> DataFrame:
    """``pages`` with ocr, an array: what a page's side file (page, ocr) holds but nulls; empty if there is none."""
    some = ocr.select("page", F.filter("ocr", lambda x: x.isNotNull()).alias("ocr"))
    return pages.join(some, "page", "left").withColumn("ocr", F.coalesce("ocr", F.array().cast(kind)))


def with_sources(entries: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Manifest entries with their source files (path, content), by ``root``/source_path; an entry without its file is an error."""
    wanted = F.concat(F.lit(root.rstrip("/") + "/"), F.col("source_path"))
    joined = entries.withColumn("path", wanted).join(files.withColumn("__there", F.lit(True)), "path", "left")
    missing = F.raise_error(F.concat(F.lit("no such source file: "), F.col("path"))).cast("string")
    return joined.withColumn("path", F.when(F.col("__there").isNull(), missing).otherwise(F.col("path"))).drop("__there")


def with_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``pages`` with label and priority by page; no label is empty and no priority."""
    rows = pages.join(labels, "page", "left").withColumn("label", F.coalesce("label", F.lit("")))
    return rows.withColumn("priority", F.col("label") != "")


def shown(page_id: Column, priority: Column, query: str, only_priority: bool) -> Column:
    """The packet's filter: the three-digit page holds the query (filled up to three digits), and priority pages alone if asked for."""
    q = query.strip()
    matches = page_id.contains(q.rjust(3, "0")) if q else F.lit(True)
    return matches & (priority if only_priority else F.lit(True))


def page_summary(pages: DataFrame) -> DataFrame:
    """(page, textboxes, normal, tables, images): sizes of a page's arrays, and how many regions are normal text."""
    normal = F.size(F.filter("textbox_regions", lambda r: r["classification"] == "normal_editable_text"))
    return pages.select("page", F.size("textbox_regions").alias("textboxes"), normal.alias("normal"), F.size("tables").alias("tables"), F.size("embedded_images").alias("images"))


def editable_cells(rows: Column) -> Column:
    """How many cells of a table aren't blank."""
    return F.size(F.filter(F.flatten(rows), lambda c: stripped(c) != ""))


def table_record(tables: DataFrame, method: str = "synthetic_table_fixture") -> DataFrame:
    """``tables`` with cells as texts in rows of one length, and how they were taken."""
    return tables.withColumn("cells", padded(F.col("cells"))).withColumn("extraction_method", F.lit(method))


def page_chunks(pages: DataFrame, n: int) -> DataFrame:
    """(chunk, pages): the pages in order, ``n`` to a chunk. A book's pages are one window."""
    number = F.row_number().over(W.partitionBy("book").orderBy("page")) - 1
    return pages.withColumn("chunk", F.floor(number / n).cast("int")).groupBy("book", "chunk").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def relative_path(path: Column, root: Column) -> Column:
    """``path`` below ``root``; as it is if it isn't below."""
    base = F.regexp_replace(root, "/+$", "")
    return F.when(path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def artifact_path(path: Column, root: Column) -> Column:
    """A page's artifact: empty if there is none, an absolute path as it is, else below the page's folder."""
    p = F.coalesce(path, F.lit(""))
    return F.when(p == "", "").when(p.startswith("/"), p).otherwise(F.concat_ws("/", F.regexp_replace(root, "/+$", ""), p))


def log_tail(log: Column, n: int = 20) -> Column:
    """The last ``n`` lines of a log."""
    lines = text_lines(F.coalesce(log, F.lit("")))
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")


# --- text recognition -------------------------------------------------------------------------------------------------


def recognized(text: Column, found: Column, allowed: bool = True, reason: str | None = None, engine: bool = True) -> Column:
    """struct<text, engine, fallback, reason> of a region: what the engine found, else the page's own text if that is allowed, else none.

    engine: whether there is an engine at all; without one, ``reason`` says why.
    """
    own, ocr = "pymupdf_text_blocks", "rapidocr_onnxruntime"
    made = lambda t, e, f, r: F.struct(t.alias("text"), F.lit(e).alias("engine"), F.lit(f).alias("fallback"), F.lit(r).cast("string").alias("reason"))
    if not engine:
        return made(text, own, True, reason)
    empty = made(text, own, True, "rapidocr returned no text; used PyMuPDF text block") if allowed else made(F.lit(""), ocr, False, None)
    return F.when(F.coalesce(found, F.lit("")) != "", made(found, ocr, False, None)).otherwise(empty)


def recognition_summary(records: DataFrame, by: list[str], order: str) -> DataFrame:
    """(``by``, text, confidence, fallback): texts by line, the mean confidence (null without any), whether one fell back."""
    g = records.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("x"), F.avg("confidence").alias("confidence"), F.bool_or("fallback").alias("fallback"))
    return g.select(*by, stripped(F.array_join(F.transform("x", lambda x: x["text"]), "\n")).alias("text"), "confidence", "fallback")


def visual_gate(tables: DataFrame, by: list[str], removed: Column) -> DataFrame:
    """(``by``, gate): an equipment table wider than 400 points needs calibration where nothing was removed."""
    wide = (F.col("classification") == "equipment_table") & (F.col("box.x1") - F.col("box.x0") > 400)
    g = tables.groupBy(*by).agg(F.bool_or(wide).alias("wide"), F.sum(removed).alias("removed"))
    return g.select(*by, F.when(F.col("wide") & (F.coalesce("removed", F.lit(0)) == 0), "NEEDS_ILLUSTRATION_AWARE_EQUIPMENT_CALIBRATION").otherwise("READY_FOR_USER_REVIEW").alias("gate"))


# --- completeness and reports -----------------------------------------------------------------------------------------


def complete_pages(pages: DataFrame, listing: DataFrame, artifacts: tuple[str, ...] = ARTIFACTS) -> DataFrame:
    """(page, complete): whether all of a page's artifacts are named and listed (path)."""
    each = pages.select("page", F.explode(F.array(*[F.coalesce(a, F.lit("")) for a in artifacts])).alias("path"))
    there = each.join(listing.select("path").distinct().withColumn("__there", F.lit(True)), "path", "left")
    return there.groupBy("page").agg((F.count("__there") == len(artifacts)).alias("complete"))


def chunks_to_run(chunks: DataFrame, pages: DataFrame, listing: DataFrame) -> DataFrame:
    """Of chunks (chunk, pages) those with a page that hasn't passed or lacks an artifact of ``RESUMED``."""
    passed = pages.where("status = 'PASS'").select("page", *RESUMED)
    done = complete_pages(passed, listing, RESUMED).where("complete").select("page")
    open_ = chunks.select("chunk", F.explode("pages").alias("page")).join(done, "page", "left_anti").select("chunk").distinct()
    return chunks.join(open_, "chunk", "left_semi")


def validation_report(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """``pages`` with validation_status (PASS without errors) and validation_errors, joined in order; errors: page, ord, message."""
    found = errors.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", "message"))).alias("__e"))
    rows = pages.join(found, "page", "left")
    text = F.coalesce(F.array_join(F.transform("__e", lambda e: e["message"]), " | "), F.lit(""))
    return rows.withColumn("validation_status", F.when(F.col("__e").isNull(), "PASS").otherwise("FAIL")).withColumn("validation_errors", text).drop("__e")


def packet_manifest(pages: DataFrame, labels: DataFrame, listing: DataFrame) -> DataFrame:
    """The packet's rows: three-digit page, label, variant, sheet and the full picture if it is listed; missing ones are empty."""
    rows = with_labels(pages, labels).join(listing.select(F.col("path").alias("fullres"), F.lit(True).alias("__there")).distinct(), "fullres", "left")
    empty = lambda n: F.coalesce(n, F.lit(""))
    return rows.select(F.format_string("%03d", "page").alias("page"), F.col("label").alias("priority_label"), empty("primary_review_variant").alias("primary_review_variant"),
                       empty("page_review_sheet").alias("page_review_sheet"), F.when(F.col("__there"), F.col("fullres")).otherwise("").alias("fullres"))


def gate_report(reports: DataFrame) -> DataFrame:
    """(run, status, audit, errors) of rollout reports (run, status, failures): the status, PASS or FAIL for it, and the failures."""
    status = F.coalesce("status", F.lit("UNKNOWN"))
    errors = F.coalesce("failures", F.array().cast("array<string>"))
    return reports.select("run", status.alias("status"), F.when(status == "PASS", "PASS").otherwise("FAIL").alias("audit"), F.size(errors).alias("errors"))


def missing_columns(df: DataFrame, required: tuple[str, ...] = ("page", "status", "editable_svg", "preview_png")) -> list[str]:
    return sorted(set(required) - set(df.columns))


def write_table(rows: DataFrame, path: str) -> None:
    """CSV with a header; ragged rows are filled up before, see ``functions.tables.padded``."""
    rows.write.option("header", True).csv(path)


# --- searchability ----------------------------------------------------------------------------------------------------


def missing_fields(json: Column, required: tuple[str, ...] = RECORD_FIELDS) -> Column:
    """The required keys that a JSON object lacks, in order."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), keys))


def record_issues(records: DataFrame, key: str, json: str, version: str) -> DataFrame:
    """(key, issue) of JSON records that lack fields, have another version or a metadata that isn't an object."""
    j = F.col(json)
    lacks = missing_fields(j)
    meta = F.get_json_object(j, "$.metadata")
    rules = [
        (F.concat(F.lit("missing fields: "), F.array_join(lacks, ", ")), F.size(lacks) > 0),
        (F.lit("unexpected schema_version"), ~F.get_json_object(j, "$.schema_version").eqNullSafe(F.lit(version))),
        (F.lit("metadata is not an object"), ~F.coalesce(meta.startswith("{"), F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(bad, message) for message, bad in rules]))
    return records.select(key, F.explode(found).alias("issue"))


def count_mismatches(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """(record_type, found, listed) where the manifest (record_type, records) says another number; -1 if it doesn't list the type."""
    found = records.groupBy("record_type").agg(F.count("*").alias("found"))
    both = found.join(manifest.withColumnRenamed("records", "listed"), "record_type", "left").withColumn("listed", F.coalesce("listed", F.lit(-1).cast("long")))
    return both.where("found <> listed")


def searchability(records: DataFrame, required: dict[str, int], queries: list[tuple[str | None, str]]) -> DataFrame:
    """(error): types with too few records, pages and tables without text, and queries (type or None, terms) without a hit; one pass each."""
    from .retrieval import keyword_search

    least = quality.below_minimum(records, required).select(F.format_string("record type %s count %d is below required minimum %d", "record_type", F.greatest("found", F.lit(0)), "required").alias("error"))
    blank = records.where(stripped(F.col("text")) == "").where(F.col("record_type").isin("page", "table")).groupBy("record_type").agg(F.count("*").alias("n"))
    out = least.unionByName(blank.select(F.format_string("%s records with empty text: %d", "record_type", "n").alias("error")))
    for kind, query in queries:
        hit = keyword_search(records, query, 1, kind, page_bonus=False).agg(F.count("*").alias("n")).where("n = 0")
        out = out.unionByName(hit.select(F.lit(f"query produced no {kind + ' ' if kind else ''}hits: {query}").alias("error")))
    return out


def search_errors(
    records: DataFrame, json: str, order: str, version: str, manifest: dict | None = None, required: tuple[str, ...] = (), least: dict[str, int] | None = None,
    queries: tuple[tuple[str | None, str], ...] = (), leaks: DataFrame | None = None, filled: tuple[str, ...] = ("page", "table"),
) -> DataFrame:
    """(section, ord, error): all that is wrong with a search index of JSON records, in the order of a report.

    1 to 3: the manifest's (status, record_count, record_counts) status, total and count of each type; 4: each record's missing
    fields, version and metadata, by its number from 1 in ``order``; 5 and 6: types that are absent or too few; 7: records of the types in ``filled`` without
    text, pages by page, others by id; 8: queries (type or None, terms) without a hit; 9: how many lines ``leaks`` has. One pass finds
    the types, texts and hits, however many queries there are; another numbers the records that are at fault.
    """
    from ..functions.text import keyword_score, query_terms

    fields = "struct<schema_version:string,record_id:string,record_type:string,page:string,text:string,metadata:string>"
    rows = records.select(F.col(order).alias("ord"), F.col(json).alias("json"), F.from_json(json, fields).alias("r"))
    rows = rows.select("ord", "json", "r.*").withColumn("record_type", F.coalesce("record_type", F.lit("")))
    names = [F.get_json_object("metadata", f"$.{n}") for n in ("classification", "review_role", "layout_class")]
    hits = [F.count_if((keyword_score("text", "record_type", names, query_terms(q), False) > 0) & (F.lit(True) if k is None else F.col("record_type") == k)).alias(f"q{i}") for i, (k, q) in enumerate(queries)]
    blank = F.col("record_type").isin(*filled) & (stripped(F.coalesce("text", F.lit(""))) == "")
    label = F.coalesce(F.when(F.col("record_type") == "page", F.col("page")).otherwise(F.col("record_id")), F.lit("None"))
    by_type = rows.groupBy("record_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(blank, F.struct("ord", label.alias("label"))))).alias("blank"), *hits)
    one = by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.struct("record_type", "n"))).alias("types"),
        F.map_from_entries(F.collect_list(F.struct("record_type", F.struct("n", "blank")))).alias("of"), *[F.coalesce(F.sum(f"q{i}"), F.lit(0)).alias(f"q{i}") for i in range(len(queries))],
    )
    found: list[tuple[int, Column]] = []  # section, array of messages

    def when(section: int, bad: Column, *message) -> None:
        text = F.concat(*[m.cast("string") if isinstance(m, Column) else F.lit(str(m)) for m in message])
        found.append((section, F.when(bad, F.array(text))))

    n = lambda kind: F.coalesce(F.col("of")[kind]["n"], F.lit(0))
    if manifest is not None:
        when(1, F.lit(manifest.get("status") != "PASS"), f"search manifest status is not PASS: {manifest.get('status')}")
        said = manifest.get("record_count")
        when(2, F.col("total") != (-1 if said is None else int(said)), f"search manifest record_count mismatch: manifest={said} index=", F.col("total"))
        counts = manifest.get("record_counts") or {}
        listed = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, int(c))]) if counts else F.create_map().cast("map<string,int>")
        other = F.filter("types", lambda t: F.coalesce(listed[t["record_type"]], F.lit(-1)) != t["n"])
        found.append((3, F.transform(other, lambda t: F.concat(F.lit("search manifest count mismatch for "), t["record_type"], F.lit(": manifest="), F.coalesce(listed[t["record_type"]].cast("string"), F.lit("None")), F.lit(" index="), t["n"].cast("string")))))
    for kind in required:
        when(5, n(kind) < 1, f"required record type absent: {kind}")
    for kind, most in (least or {}).items():
        when(6, n(kind) < most, f"record type {kind} count ", n(kind), f" is below required minimum {most}")
    for kind in filled:
        empty = F.col("of")[kind]["blank"]
        when(7, F.size(empty) > 0, f"{kind} records with empty text: ", F.array_join(F.transform(empty, lambda b: b["label"]), ", "))
    for i, (kind, query) in enumerate(queries):
        when(8, F.col(f"q{i}") == 0, f"query produced no {kind + ' ' if kind else ''}hits: {query}")
    def numbered(k: int, section: int, messages: Column) -> Column:
        whole = F.coalesce(messages, F.array().cast("array<string>"))
        return F.transform(whole, lambda m, j: F.struct(F.lit(section).alias("section"), (F.lit(k * 1_000_000).cast("long") + j).alias("ord"), m.alias("error")))

    whole = [numbered(k, section, messages) for k, (section, messages) in enumerate(found)]
    out = one.select(F.explode(F.concat(*whole) if whole else F.array().cast("array<struct<section:int,ord:bigint,error:string>>")).alias("x")).select("x.*")

    lacks = missing_fields(F.col("json"))
    # a string that looks like an object is none
    object_ = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("json"), "$.metadata", "variant")).startswith("OBJECT"), F.lit(False))
    rules = [
        (F.size(lacks) > 0, F.concat(F.lit(" missing fields: "), F.array_join(lacks, ", "))),
        (~F.col("schema_version").eqNullSafe(F.lit(version)), F.concat(F.lit(" has unexpected schema_version: "), F.coalesce("schema_version", F.lit("None")))),
        (~object_, F.lit(" metadata is not an object")),
    ]
    faults = F.filter(F.array(*[F.when(bad, F.struct(F.lit(i).alias("i"), message.alias("m"))) for i, (bad, message) in enumerate(rules)]), lambda x: x.isNotNull())
    bad = rows.select("ord", F.explode(faults).alias("x"))
    out = out.unionByName(bad.select(F.lit(4).alias("section"), (F.col("ord").cast("long") * 4 + F.col("x.i")).alias("ord"), F.concat(F.lit("record "), F.col("ord").cast("string"), F.col("x.m")).alias("error")))
    if leaks is not None:
        some = leaks.agg(F.count("*").alias("n")).where("n > 0")
        out = out.unionByName(some.select(F.lit(9).alias("section"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("user-facing internal path leaks: "), F.col("n").cast("string")).alias("error")))
    return out


def path_leaks(files: DataFrame, pattern: str = INTERNAL_PATH) -> DataFrame:
    """(path, line_number) of lines of user-facing files (path, text) that name an internal path."""
    lines = files.where(F.col("text").rlike(pattern)).select("path", F.posexplode(text_lines("text")).alias("i", "line"))
    return lines.where(F.col("line").rlike(pattern)).select("path", (F.col("i") + 1).cast("long").alias("line_number"))


def issue_field() -> Column:
    """The field that a registry entry's ``issue`` is about."""
    return F.when(F.col("issue").startswith("private OCR"), "processing_intent").when(F.col("issue").contains("blocked_reason"), "blocked_reason").otherwise(F.get(F.split("issue", " "), F.lit(0)))


def manifest_issues(manifests: DataFrame) -> DataFrame:
    """(manifest, path, message) of intake manifests (manifest, manifest_version, batch_id, entries): their own faults, those of each entry
    under ``entries[i]``, and hashes that the entry before with the same hash has under another book."""
    own = manifests.select("manifest", F.explode(F.array_compact(F.array(
        F.when(~F.col("manifest_version").eqNullSafe(F.lit(INTAKE_VERSION)), F.struct(F.lit("manifest_version").alias("path"), F.lit("unsupported manifest_version").alias("message"))),
        F.when(F.coalesce("batch_id", F.lit("")) == "", F.struct(F.lit("batch_id").alias("path"), F.lit("batch_id is required").alias("message"))),
    ))).alias("x")).select("manifest", "x.*")
    entries = manifests.select("manifest", F.posexplode("entries").alias("i", "e")).select("manifest", "i", "e.*")
    prefix = F.concat(F.lit("entries["), F.col("i").cast("string"), F.lit("]"))
    broken = quality.issues(entries, ["manifest", "i"], quality.registry_rules()).select("manifest", F.concat_ws(".", prefix, issue_field()).alias("path"), F.col("issue").alias("message"))
    before = F.lag("book_id").over(W.partitionBy("manifest", "sha256").orderBy("i"))
    again = entries.withColumn("also", before).where("also <> '' and also <> book_id").select("manifest", F.concat(prefix, F.lit(".sha256")).alias("path"), F.concat(F.lit("duplicate source hash also used by "), F.col("also")).alias("message"))
    return own.unionByName(broken).unionByName(again)


def stale_indexes(indexes: DataFrame, files: DataFrame) -> DataFrame:
    """(index, issue) of vector indexes (index, path, sha256): no source named, or a source file (path, content) of another hash; a missing file is no fault."""
    now = files.select("path", F.sha2("content", 256).alias("now"))
    rows = indexes.join(now, "path", "left")
    unnamed = (F.coalesce("path", F.lit("")) == "") | (F.coalesce("sha256", F.lit("")) == "")
    issue = F.when(unnamed, "source_index.path and source_index.sha256 are required").when(F.col("now") != F.col("sha256"), "source index SHA-256 does not match vector index metadata; rebuild the vector index")
    return rows.select("index", issue.alias("issue")).where("issue is not null")


def pipeline_conflicts(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """(root, conflict) of requested runs (root, sha256, book_id) whose folder holds the output (root, sha256, book_id) of another source or book."""
    old = existing.select("root", F.col("sha256").alias("old_sha"), F.col("book_id").alias("old_book"))
    rows = requested.join(old, "root")
    conflict = F.when((F.col("old_sha") != "") & (F.col("old_sha") != F.col("sha256")), "another source").when((F.col("old_book") != "") & (F.col("old_book") != F.col("book_id")), "another book")
    return rows.select("root", conflict.alias("conflict")).where("conflict is not null")


def workspace_issues(root: str, folders: list[str], public: str | None = None, config: str = "workspace.json", version: str = "v1") -> list[tuple[str, str]]:
    """(path, message) of what is wrong with a private workspace on the driver's machine: layout, separation, configuration."""
    import json

    from ..sources.files import inside

    if not os.path.isdir(root):
        return [(root, "workspace root must exist and be a directory")]
    out, there = [], lambda *p: os.path.join(root, *p)
    if public and inside(root, public):
        out.append((root, "private workspace must not be inside the public repository"))
    out += [(f, "required private workspace directory is missing") for f in folders if not os.path.isdir(there(f))]
    ignore = there(".gitignore")
    if not os.path.exists(ignore):
        out.append((".gitignore", "private workspace .gitignore is missing"))
    else:
        with open(ignore, encoding="utf-8") as f:
            if "*" not in f.read():
                out.append((".gitignore", "private workspace .gitignore must ignore private artifacts by default"))
    if not os.path.exists(there(config)):
        return [*out, (config, "workspace config is missing")]
    try:
        with open(there(config), encoding="utf-8") as f:
            c = json.load(f)
        tests = (
            (c["layout_version"] != version, "unsupported private workspace layout_version"),
            (os.path.realpath(c["workspace_root"]) != os.path.realpath(root), "workspace_root does not match the validated directory"),
            (c["public_export_allowed"], "private workspace must not be public-export allowed"),
            (c["release_scope"] != "private_local_only", "release_scope must be private_local_only"),
            (not c["corpus_id"], "corpus_id is required"),
        )
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        return [*out, (config, f"workspace config is invalid: {e}")]
    return out + [(config, message) for bad, message in tests if bad]


# --- pictures, selections, sources ------------------------------------------------------------------------------------


def diff_ratio(a: Column, b: Column, least: int = 24) -> Column:
    """The share of grey values (arrays of one length) that differ by more than ``least``; null if one picture is missing."""
    far = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > least))
    return F.when(F.size(a) > 0, far / F.size(a))


def channel_stats(channels: Column) -> Column:
    """struct<mean, contrast>: the mean over channels (arrays) of their means and of their standard deviations."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    spread = lambda c: F.sqrt(mean(F.transform(c, lambda x: (x - mean(c)) * (x - mean(c)))))
    return F.struct(mean(F.transform(channels, mean)).alias("mean"), mean(F.transform(channels, spread)).alias("contrast"))


def image_order(images: DataFrame) -> DataFrame:
    """``images`` (page, ord, classification, area) with place: backgrounds first, then by area, then as they came."""
    w = W.partitionBy("page").orderBy(F.when(F.col("classification") == "background_image", 0).otherwise(1), "area", "ord")
    return images.withColumn("place", F.row_number().over(w))


def selected_pages(pages: DataFrame, wanted: Column | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages that ``wanted`` (an array) names and that lie from ``first`` to ``last``; what isn't given selects all."""
    rows = pages.where(F.array_contains(wanted, F.col("page"))) if wanted is not None else pages
    rows = rows.where(F.col("page") >= first) if first is not None else rows
    return rows.where(F.col("page") <= last) if last is not None else rows


def path_class(path: Column, private: str, public: str) -> Column:
    """private_workspace, public_repo or external, of normal paths; the private folder is asked first."""
    below = lambda root: (path == root) | path.startswith(root.rstrip("/") + "/")
    return F.when(below(private), "private_workspace").when(below(public), "public_repo").otherwise("external")


def first_or(paths: DataFrame, by: list[str], fallback: Column) -> DataFrame:
    """(``by``, path): the least path that matched (null: none), else the fallback (a column of the group)."""
    return paths.groupBy(*by).agg(F.coalesce(F.min("path"), F.min(fallback)).alias("path"))


def review_rows(pages: DataFrame, debug: bool = False) -> DataFrame:
    """What a reviewer sees of a page; for debugging also what it was made from."""
    names = ["page", "status", "editable_svg", "preview_png"]
    return pages.select(*names, *(["source_primary_review_svg", "source_primary_review_render"] if debug else []))


def sorted_json(row: list[str]) -> Column:
    """A JSON object of columns with its keys in order, nulls included."""
    return F.to_json(F.struct(*sorted(row)), {"ignoreNullFields": "false"})


def element_text(xml: Column) -> Column:
    """All text nodes of an element, joined."""
    return F.array_join(F.xpath(xml, F.lit("//text()")), "")


def page_tables(detected: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, ord, class, confidence) of a page's tables: detected ones of two rows and columns at least, and text blocks that none of them covers
    and whose layout scores like a table. Both: page, ord, box, rows; blocks also text."""
    from ..functions.tables import cleaned, columns, table_class, table_score
    from .layout import not_covered

    whole = detected.withColumn("rows", cleaned(F.col("rows"))).where((F.size("rows") >= 2) & (columns(F.col("rows")) >= 2))
    first = whole.select("page", "ord", table_class(F.col("rows")).alias("class"), F.lit(0.98).alias("confidence"))
    score = not_covered(blocks, whole, "ord").select("page", "ord", table_score(F.col("text"), F.col("rows")).alias("s")).where("s.score > 0")
    return first.unionByName(score.select("page", "ord", "s.class", F.round("s.score", 3).alias("confidence")))


def recognized_pages(entries: DataFrame, files: DataFrame, root: str, reader) -> DataFrame:
    """OCR records of a manifest's entries (corpus_id, book_id, source_path): each file's pages by ``reader``, hashed and measured."""
    from ..sources.files import pages_of
    from .records import ocr_pages

    found = with_sources(entries, files, root)
    pages = ocr_pages(pages_of(found, reader))
    return pages.join(found.select("path", "corpus_id", "book_id", F.sha2("content", 256).alias("source_sha256")), "path").withColumnRenamed("page", "page_number")


def checked(issues: DataFrame, mode: str = "internal") -> DataFrame:
    """``issues``; in mode "internal" any of them is an error."""
    if mode == "internal" and not issues.isEmpty():
        raise ValueError(f"validation failed: {issues.first().asDict()}")
    return issues
