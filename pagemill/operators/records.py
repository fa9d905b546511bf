"""Builders of search records: manifests, texts, tables, images and OCR pages in one schema.

A record is record_id, batch_id, book_id, record_type, text, page, artifact_path, metadata (JSON text). Inputs are the exploded
entries; a malformed entry is a null struct after parsing, and is dropped by the readers. Missing strings count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, empty_to_null, normalize_search_text

COLUMNS = ["record_id", "batch_id", "book_id", "record_type", "text", "page", "artifact_path", "metadata"]


def _has(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _id(*parts: Column) -> Column:
    """Parts that aren't empty, joined."""
    return F.concat_ws("::", *[empty_to_null(p) for p in parts])


def _id_all(*parts: Column) -> Column:
    return F.concat_ws("::", *[F.coalesce(p, F.lit("")) for p in parts])


def _page(df: DataFrame, *names: str) -> Column:
    """The first of these columns that is there, null as 0: presence beats value."""
    name = next((n for n in names if n in df.columns), None)
    return F.coalesce(F.col(name).try_cast("int"), F.lit(0)) if name else F.lit(0)


def _record(df: DataFrame, record_id, batch, book, kind, text, page, artifact, metadata: list[Column]) -> DataFrame:
    meta = F.to_json(F.struct(*metadata)) if metadata else F.lit("{}")
    values = (record_id, batch, book, kind, text, page, artifact, meta)
    return df.select(*[v.alias(n) for v, n in zip(values, COLUMNS, strict=True)])


def from_manifest(entries: DataFrame) -> DataFrame:
    """Inventory records; text: name, book, classes and states, those that aren't empty."""
    g = lambda n: _has(entries, n)
    text = F.concat_ws(" ", *[empty_to_null(g(n)) for n in ("display_name", "book_id", "privacy_class", "rights_class", "intake_state", "processing_intent")])
    kept = ("source_path", "sha256", "file_size_bytes", "page_count", "privacy_class", "rights_class", "intake_state", "processing_intent")
    meta = [F.col(n) for n in kept if n in entries.columns]
    return _record(entries, _id(g("batch_id"), g("book_id"), F.lit("inventory")), g("batch_id"), g("book_id"), F.lit("inventory_entry"), text, F.lit(0), F.lit(""), meta)


def from_texts(entries: DataFrame) -> DataFrame:
    """Text records: the given id, or batch, book and page with empty parts kept."""
    g, page = lambda n: _has(entries, n), _page(entries, "page")
    made = _id_all(g("batch_id"), g("book_id"), F.format_string("p%03d", page), F.lit("text"))
    source = F.coalesce(empty_to_null(g("source")), F.lit("synthetic_fixture"))
    meta = [g("section").alias("section"), *([F.col("confidence")] if "confidence" in entries.columns else []), source.alias("source")]
    return _record(entries, F.coalesce(empty_to_null(g("record_id")), made), g("batch_id"), g("book_id"), F.lit("synthetic_text"), g("text"), page, g("artifact_path"), meta)


def from_tables(entries: DataFrame, kind: str = "synthetic_table") -> DataFrame:
    """Table records; cells is an array of rows; text: caption, id and all cells that aren't empty."""
    g, page = lambda n: _has(entries, n), _page(entries, "page", "page_number")
    cells = F.coalesce("cells", F.array().cast("array<array<string>>"))
    text = F.concat_ws(" ", empty_to_null(g("caption")), empty_to_null(g("table_id")), empty_to_null(F.array_join(F.filter(F.flatten(cells), lambda c: c != ""), " ")))
    batch = g("batch_id") if "batch_id" in entries.columns else g("corpus_id")
    rid = F.coalesce(empty_to_null(g("record_id")), _id_all(batch, g("book_id"), F.format_string("p%03d", page), g("table_id")))
    meta = [g("table_id").alias("table_id"), g("caption").alias("caption"), F.size(cells).alias("row_count"), F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0)).alias("column_count")]
    return _record(entries, rid, batch, g("book_id"), F.lit(kind), text, page, g("artifact_path"), meta)


def from_images(entries: DataFrame) -> DataFrame:
    """Image records; text: label, class, description and id, those that aren't empty."""
    g, page = lambda n: _has(entries, n), _page(entries, "page")
    text = F.concat_ws(" ", *[empty_to_null(g(n)) for n in ("label", "classification", "alt_text", "image_id")])
    rid = F.coalesce(empty_to_null(g("record_id")), _id_all(g("batch_id"), g("book_id"), F.format_string("p%03d", page), g("image_id")))
    meta = [F.col(n) for n in ("image_id", "label", "classification", "width_px", "height_px", "source") if n in entries.columns]
    return _record(entries, rid, g("batch_id"), g("book_id"), F.lit("synthetic_image"), text, page, g("artifact_path"), meta)


def from_ocr(entries: DataFrame) -> DataFrame:
    """OCR page records: five-digit page and the first twelve signs of the text's hash in the id."""
    g, page = lambda n: _has(entries, n), _page(entries, "page_number")
    rid = _id(g("corpus_id"), g("book_id"), F.format_string("p%05d", page), F.substring(g("text_sha256"), 1, 12), F.lit("ocr"))
    meta = [F.col(n) for n in ("corpus_id", "source_sha256", "text_sha256", "char_count", "confidence", "extraction_method") if n in entries.columns]
    return _record(entries, rid, g("corpus_id"), g("book_id"), F.lit("private_ocr_page"), g("text"), page, F.lit(""), meta)


def ocr_pages(pages: DataFrame) -> DataFrame:
    """Adds text_sha256, char_count and confidence (1 if the text has a sign other than white space) to page texts."""
    text = F.coalesce("text", F.lit(""))
    return pages.withColumn("text_sha256", F.sha2(text, 256)).withColumn("char_count", F.length(text).cast("long")).withColumn("confidence", F.when(clean_text("text") != "", 1.0).otherwise(0.0))


def from_pages(pages: DataFrame) -> DataFrame:
    """Records of extracted pages, five kinds.

    pages: book_id, page and arrays of structs textbox_regions (region_id, text, classification, layout_class), ocr (region_id, text),
    tables (caption, title, text, csv, file, rows), embedded_images (image_id, classification, review_role, width_px, height_px).
    """
    head = [F.coalesce(empty_to_null(_has(pages, "book_id")), F.lit("book")).alias("book_id"), _page(pages, "page").alias("page")]

    def made(rows: DataFrame, kind: str, tail: Column, text: Column, metadata: list[Column]) -> DataFrame:
        rid = _id(F.col("book_id"), F.format_string("p%03d", F.col("page")), F.lit(kind), tail)
        return _record(rows, rid, F.lit(""), F.col("book_id"), F.lit(kind), normalize_search_text(text), F.col("page"), F.lit(""), metadata)

    def each(name: str) -> DataFrame:
        return pages.select(*head, F.posexplode(name).alias("i", "x")).where("x is not null")

    joined = F.concat(*[F.transform(F.coalesce(n, F.array().cast(pages.schema[n].dataType)), lambda x: clean_text(x["text"])) for n in ("textbox_regions", "ocr")])
    counts = [F.coalesce(F.size(n), F.lit(0)).alias(a) for n, a in (("textbox_regions", "textbox_count"), ("tables", "table_count"), ("embedded_images", "image_count"))]
    whole = made(pages.select(*head, F.array_join(F.filter(joined, lambda t: t != ""), " ").alias("t"), *counts), "page", F.lit("page"), F.col("t"), [F.col(a) for a in ("textbox_count", "table_count", "image_count")])
    region = made(each("textbox_regions").where(clean_text("x.text") != ""), "text_region", F.col("x.region_id"), F.col("x.text"), [F.col("x.classification"), F.col("x.layout_class")])
    ocr = made(each("ocr").where(clean_text("x.text") != ""), "ocr_text", F.coalesce(empty_to_null(F.col("x.region_id")), F.format_string("ocr_%04d", F.col("i") + 1)), F.col("x.text"), [])
    table_text = F.concat_ws(" ", *[empty_to_null(clean_text(f"x.{n}")) for n in ("caption", "title", "text", "csv", "file")], F.array_join(F.filter(F.flatten("x.rows"), lambda c: c != ""), " "))
    table = made(each("tables"), "table", F.format_string("table_%03d", F.col("i") + 1), table_text, [F.col("x").alias("table")])
    size = F.concat(F.col("x.width_px").cast("string"), F.lit("x"), F.col("x.height_px").cast("string"))
    image = made(each("embedded_images"), "image", F.col("x.image_id"), F.concat_ws(" ", "x.classification", "x.review_role", size), [F.col("x.classification"), F.col("x.review_role")])
    return union([whole, region, ocr, table, image])


def union(frames: list[DataFrame]) -> DataFrame:
    """All records, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("record_type", F.lit("")).alias("record_type")).agg(F.count("*").alias("records"))


def registry_entries(files: DataFrame, corpus_id: str, root: str = "", page_count: str | None = None) -> DataFrame:
    """Intake entries of a ``binaryFile`` listing: relative path, slug, hash, size, pages (a column, or null); see ``sources.files.binary_files``."""
    from ..functions.text import slug, stem, utc_now

    relative = F.regexp_replace("path", F.concat(F.lit(r"^(file:)?/*\Q"), F.lit(root.strip("/")), F.lit(r"\E/?")), "") if root else F.regexp_replace("path", "^.*/", "")
    now = utc_now()
    return files.select(
        F.lit(corpus_id).alias("corpus_id"), slug(stem("path")).alias("book_id"), stem("path").alias("display_name"), relative.alias("source_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_size_bytes"),
        (F.col(page_count) if page_count else F.lit(None)).cast("int").alias("page_count"), now.alias("created_at"), now.alias("updated_at"),
    )
