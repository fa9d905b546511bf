"""Intake of source files: an inventory under one manifest, its faults, and recognition records of every page.

Everything about a file that needs its bytes (hash, size, pages) is taken where the scan reads them; only entries and page texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import utc_now
from ..sources import books, files
from . import numbering, quality, records
from .packet import INTAKE_VERSION, issue_field

#: The version of recognition records, what an entry holds.
OCR_VERSION = "0.5.0-ocr-records-v1"
ENTRY = (
    "index long, corpus_id string, book_id string, display_name string, source_path string, sha256 string, file_size_bytes long, page_count int, privacy_class string, rights_class string, "
    "intake_state string, processing_intent string, created_at string, updated_at string, evidence_paths array<string>, blocked_reason string"
)
PAGE = "schema_version string, corpus_id string, book_id string, source_sha256 string, page_number int, extraction_method string, text string, text_sha256 string, char_count long, confidence double, record_type string"
#: Entries of one range, within which rows of one hash are ordered together.
RANGE = 1 << 20


def inventory(
    sources: DataFrame, corpus_id: str, root: str, privacy_class: str = "private_source", rights_class: str = "unknown_review_required",
    intake_state: str = "registered", processing_intent: str = "inventory_only", pages: Callable[[bytes], int | None] | None = None,
) -> DataFrame:
    """``ENTRY`` of every .pdf file among ``sources`` (path, length, content), numbered by path, folder by folder.

    ``pages`` counts a file's pages, with a library of the caller's choice; without it they are null. A null content gives a null hash,
    which is one of the faults of an entry. Of no file there is no entry, and none of an empty one that Spark's scan doesn't list.
    """
    found = sources.where(F.col("path").endswith(".pdf"))
    entries = records.registry_entries(found.select("path", "length", "content"), corpus_id, root)
    if pages is not None:

        @F.pandas_udf("int")
        def counted(contents: pd.Series) -> pd.Series:
            return pd.Series([None if c is None else pages(bytes(c)) for c in contents], dtype="Int32")

        entries = records.registry_entries(found.select("path", "length", "content", counted("content").alias("page_count")), corpus_id, root, "page_count")
    fixed = {"display_name": F.col("book_id"), "privacy_class": F.lit(privacy_class), "rights_class": F.lit(rights_class), "intake_state": F.lit(intake_state), "processing_intent": F.lit(processing_intent)}
    entries = entries.withColumns(fixed | {"evidence_paths": F.array().cast("array<string>"), "blocked_reason": F.lit(None).cast("string")})
    return as_entries(numbering.numbered(entries, [F.split("source_path", "/"), "sha256"], "index"))


def as_entries(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``ENTRY`` alone, in order."""
    return rows.select(*[F.col(n).cast(t).alias(n) for n, t in (x.split(" ") for x in ENTRY.split(", "))])


def write_inventory(entries: DataFrame, path: str, batch_id: str, version: str = INTAKE_VERSION) -> dict:
    """Writes ``entries`` under ``path`` and returns their envelope; a job that fails leaves none."""
    now = entries.sparkSession.range(1).select(utc_now()).first()[0]
    return books.write_entries(as_entries(entries), path, version, batch_id, now)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return books.read_entries(spark, path, ENTRY)


def previous(rows: DataFrame, keys: list[str], index: str, value: str, name: str = "before", size: int = RANGE) -> DataFrame:
    """``rows`` with the ``value`` of the row before with equal ``keys`` (null ones are equal), by ``index``, distinct numbers from 0.

    One key may be that of most rows: a key's rows are ordered within ranges of ``size`` numbers, and a range's first row takes the last value
    of the ranges before it, of which a window orders one row for each key and range. Null where no row or a null value is before.
    """
    cut = rows.withColumn("__range", F.floor(F.col(index) / size))
    last = cut.groupBy(*keys, "__range").agg(F.max_by(F.struct(value), index).alias("__last"))
    over = last.select(*keys, "__range", F.lag("__last").over(W.partitionBy(*keys).orderBy("__range")).alias("__over")).where("__over is not null")
    over = over.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("__range").alias("__at"), "__over")
    own = cut.withColumn("__own", F.lag(F.struct(value)).over(W.partitionBy(*keys, "__range").orderBy(index)))
    same = (F.col("__range") == F.col("__at"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    both = own.join(over, same, "left")
    return both.select(*rows.columns, F.coalesce("__own", "__over")[value].alias(name))


def inventory_issues(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, message): faults of a written manifest: its own, those of each entry under entries[index], and hashes that the entry before with
    the same hash has under another book."""
    head, entries = books.envelope(path), read_inventory(spark, path)
    own = [("manifest_version", "unsupported manifest_version")] * (head["manifest_version"] != INTAKE_VERSION) + [("batch_id", "batch_id is required")] * (not head["batch_id"])
    prefix = F.concat(F.lit("entries["), F.col("index").cast("string"), F.lit("]"))
    broken = quality.issues(entries, ["index"], quality.registry_rules()).select(F.concat_ws(".", prefix, issue_field()).alias("path"), F.col("issue").alias("message"))
    again = previous(entries.select("index", "sha256", "book_id"), ["sha256"], "index", "book_id", "also", size).where("also <> '' and not also <=> book_id")
    again = again.select(F.concat(prefix, F.lit(".sha256")).alias("path"), F.concat(F.lit("duplicate source hash also used by "), F.col("also")).alias("message"))
    return spark.createDataFrame(own, "path string, message string").unionByName(broken).unionByName(again)


def recognized(entries: DataFrame, sources: DataFrame, root: str, reader: Callable[[bytes], list[str]], method: str = "text_layer") -> DataFrame:
    """``PAGE`` of every page of the entries' files, by ``reader``; hashes of sources are the entries'. A missing file is an error.

    The files' bytes stay in the scan's tasks. Entries of the same path each have their pages.
    """
    at = F.concat(F.lit(root.rstrip("/") + "/"), F.col("source_path"))
    wanted = entries.select(F.col("corpus_id"), "book_id", F.col("sha256").alias("source_sha256"), at.alias("path"))
    bare = F.regexp_replace("path", "^file:/+", "/")
    there = sources.select(bare.alias("path")).distinct().withColumn("there", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("no such source file: "), F.col("path"))).cast("string")
    known = wanted.join(there, "path", "left").select("corpus_id", "book_id", "source_sha256", F.when(F.col("there"), F.col("path")).otherwise(missing).alias("path"))
    pages = files.pages_of(sources.select(bare.alias("path"), "content"), reader)
    made = {"schema_version": F.lit(OCR_VERSION), "extraction_method": F.lit(method), "page_number": F.col("page"), "record_type": F.lit("ocr_page")}
    # from the left, so that an entry without its file reaches the error also where the other side has no pages
    found = records.ocr_pages(known.join(pages, "path", "left").where("page is not null"))  # hashes after the join, so that none is shuffled
    return found.withColumns(made).select(*[x.split(" ")[0] for x in PAGE.split(", ")])


def write_recognized(entries: DataFrame, sources: DataFrame, root: str, reader: Callable[[bytes], list[str]], output: str, private: str) -> dict:
    """Writes ``recognized`` as one index under ``output``, which must lie in the folder ``private``; returns its manifest."""
    if not files.inside(books.local(output), books.local(private)):
        raise ValueError("recognition records must be inside the private workspace")
    return books.write_records(recognized(entries, sources, root, reader), output, OCR_VERSION)


def recognized_issues(spark: SparkSession, output: str) -> DataFrame:
    """(book_id, page_number, issue) of written recognition records; another version of all is an issue without either."""
    rows = books.read_records(spark, output, PAGE)
    rules = [("schema_version unsupported", ~F.col("schema_version").eqNullSafe(OCR_VERSION)), *quality.ocr_rules()]
    own = [(None, None, "unsupported schema_version")] * (books.index_manifest(output)["schema_version"] != OCR_VERSION)
    return spark.createDataFrame(own, "book_id string, page_number int, issue string").unionByName(quality.issues(rows, ["book_id", "page_number"], rules))
