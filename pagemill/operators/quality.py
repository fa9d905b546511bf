"""Constraints on records, scans for secrets and private paths, merges of reports, resumption."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import stripped

Rule = tuple[str, Column]


def issues(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """(keys, issue): one row for every rule (message, violated) that a row breaks; a null condition isn't a breach."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for message, bad in rules]))
    return rows.select(*keys, F.explode(found).alias("issue"))


def _missing(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def registry_rules() -> list[Rule]:
    """Of an intake entry; text recognition of private sources needs its own approval."""
    blocked, reason = F.col("intake_state") == "blocked", ~_missing("blocked_reason")
    return [
        *[(f"{n} is required", _missing(n)) for n in ("corpus_id", "book_id", "display_name")],
        ("sha256 must be a 64-character hex digest", ~F.lower(F.coalesce("sha256", F.lit(""))).rlike("^[0-9a-f]{64}$")),
        ("file_size_bytes must be non-negative", F.col("file_size_bytes") < 0),
        ("page_count must be null or greater than zero", F.col("page_count") < 1),
        ("private OCR requires a separate recorded approval gate", (~F.col("privacy_class").isin("public_sample", "synthetic")) & (F.col("processing_intent") == "ocr_approved_private")),
        ("blocked entries require blocked_reason", blocked & ~reason),
        ("blocked_reason is only valid for blocked entries", ~blocked & reason),
    ]


def ocr_rules() -> list[Rule]:
    return [
        *[(f"{n} required", _missing(n)) for n in ("corpus_id", "book_id")],
        ("source_sha256 invalid", F.length(F.coalesce("source_sha256", F.lit(""))) != 64),
        ("page_number invalid", F.coalesce("page_number", F.lit(0)) < 1),
        ("text required", F.col("text").isNull()),
        ("text_sha256 mismatch", ~F.col("text_sha256").eqNullSafe(F.sha2("text", 256))),
        ("char_count mismatch", ~F.col("char_count").cast("long").eqNullSafe(F.length("text").cast("long"))),
        ("confidence invalid", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
    ]


def table_rules() -> list[Rule]:
    none = F.coalesce(F.size("cells"), F.lit(0)) <= 0
    return [
        *[(f"{n} required", _missing(n)) for n in ("corpus_id", "book_id")],
        ("source_sha256 invalid", F.length(F.coalesce("source_sha256", F.lit(""))) != 64),
        ("page_number invalid", F.coalesce("page_number", F.lit(0)) < 1),
        ("table_id required", _missing("table_id")),
        ("cells required", none),
        ("cells rows must have a consistent width", ~none & (F.size(F.array_distinct(F.transform("cells", F.size))) != 1)),
        ("cells values must be strings", ~none & F.exists(F.flatten("cells"), lambda c: c.isNull())),
        ("confidence invalid", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
    ]


def vector_rules(dimensions: int, key: str = "chunk_id", text: str | None = "text") -> list[Rule]:
    return [
        (f"{key} is required", _missing(key)),
        *([("text is required", _missing(text))] if text else []),
        ("embedding length must match provider dimensions", F.coalesce(F.size("embedding"), F.lit(-1)) != dimensions),
        ("embedding values must be numeric", F.exists("embedding", lambda x: x.isNull() | F.isnan(x))),
    ]


def repeated_hashes(entries: DataFrame, hash_: str = "sha256", book: str = "book_id", order: str = "ord") -> DataFrame:
    """Entries whose hash the entry before with that hash (in ``order``) has under another, non-empty book: with its name."""
    before = F.lag(book).over(W.partitionBy(hash_).orderBy(order))
    return entries.withColumn("also_used_by", before).where((F.col("also_used_by") != "") & (F.col("also_used_by") != F.col(book)))


#: What no line of a public export may hold.
FORBIDDEN = {
    "private path": r"(?i)\b[A-Z]:\\(?:Users\\[^\\\s]+|Projects\\[^\\\s]+)",
    "api key wording": r"(?i)api[_ -]?key|apikey|secret|password|passwd|bearer\s+[A-Za-z0-9._-]+|authorization:",
    "aws access key": r"\bAKIA[0-9A-Z]{16}\b",
    "google api key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "openai style key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "github token": r"\b(?:ghp|github_pat)_[A-Za-z0-9_]{20,}\b",
    "slack token": r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    "private key block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def denied(terms: list[str]) -> dict[str, str]:
    """Patterns of a deny list's lines: blanks and # comments are left out, the rest is taken literally, in any case."""
    kept = [t.strip() for t in terms]
    return {f"custom denylist {i}": "(?i)" + re.escape(t) for i, t in enumerate((t for t in kept if t and not t.startswith("#")), 1)}


#: The ends of a line.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def text_lines(x: Column | str) -> Column:
    """A text's lines without their ends; what follows the last end is a line only if it isn't empty."""
    parts = F.split(x if isinstance(x, Column) else F.col(x), LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def forbidden_lines(docs: DataFrame, key: str, text: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, line_number, category, line) of each line and category that matches, the line stripped; no join with the patterns.

    Texts that match no pattern as a whole aren't split.
    """
    patterns = FORBIDDEN if patterns is None else patterns
    may = reduce(lambda a, b: a | b, [F.col(text).rlike(p) for p in patterns.values()])
    lines = docs.where(may).select(key, F.posexplode(text_lines(text)).alias("i", "line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(c)) for c, p in patterns.items()]))
    return lines.select(key, (F.col("i") + 1).cast("long").alias("line_number"), F.explode(hits).alias("category"), stripped(F.col("line")).alias("line"))


#: Which files of a public export are looked at, and which must not be there.
TEXT_SUFFIXES = (".bat", ".cfg", ".css", ".csv", ".html", ".ini", ".js", ".json", ".md", ".ps1", ".py", ".svg", ".toml", ".txt", ".xml", ".yaml", ".yml", ".pdf")
SKIPPED_PARTS, GENERATED_PARTS, GENERATED_SUFFIXES = (".git", ".mypy_cache", ".pytest_cache"), (".ruff_cache", "__pycache__"), (".pyc", ".pyo")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def scanned(path: str = "path", own_name: str = "") -> Column:
    """Whether a file (relative path) is read: its suffix is of a text, no folder is skipped, and it isn't the scanner itself."""
    p = F.col(path)
    return _suffix(p).isin(*TEXT_SUFFIXES) & ~F.arrays_overlap(_parts(p), F.array(*map(F.lit, SKIPPED_PARTS))) & (F.element_at(_parts(p), -1) != own_name)


def export_findings(files: DataFrame, public_sources: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(path, line_number, category, line) of a public export's files (path, text): what their paths (line 0) and lines must not hold.

    public_sources: a pattern of the source PDFs that may be there. A private source or generated file isn't read.
    """
    patterns = FORBIDDEN if patterns is None else patterns
    p = F.col("path")
    folders = F.slice(_parts(p), 1, F.size(_parts(p)))
    private = (_suffix(p) == ".pdf") & F.array_contains(folders, "source") & ~p.rlike(public_sources)
    made = F.arrays_overlap(folders, F.array(*map(F.lit, GENERATED_PARTS))) | _suffix(p).isin(*GENERATED_SUFFIXES)
    marked = files.withColumn("__private", private).withColumn("__made", made & ~private)
    found = F.array_compact(F.array(F.when(F.col("__private"), F.lit("private source pdf")), *[F.when(p.rlike(x), F.lit(c)) for c, x in patterns.items()], F.when(F.col("__made"), F.lit("generated file"))))
    why = F.when(F.col("category") == "private source pdf", "source PDFs must be public sample fixtures only").when(F.col("category") == "generated file", "remove generated cache/artifact from public export").otherwise("matched path")
    paths = marked.select("path", F.lit(0).cast("long").alias("line_number"), F.explode(found).alias("category")).withColumn("line", why)
    return paths.unionByName(forbidden_lines(marked.where(~F.col("__private") & ~F.col("__made") & scanned()), "path", patterns=patterns))


def last_wins(reports: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the row that comes last by ``order``: one shuffle of one row for each key and task."""
    names = reports.columns
    best = reports.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r"))
    return best.select("r.*")


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def rollup(results: DataFrame, by: list[str]) -> DataFrame:
    """status, passed, failed of each group of results (status PASS or not, blocked): FAIL, PASS_WITH_VISUAL_BLOCKERS or PASS."""
    failed = F.count_if(F.col("status") != "PASS")
    status = F.when(failed > 0, "FAIL").when(F.bool_or("blocked"), "PASS_WITH_VISUAL_BLOCKERS").otherwise("PASS")
    return results.groupBy(*by).agg(status.alias("status"), F.count_if(F.col("status") == "PASS").alias("passed"), failed.alias("failed"))


def below_minimum(records: DataFrame, least: dict[str, int]) -> DataFrame:
    """(record_type, required, found) of required types that have too few records; none at all is -1."""
    wanted = records.sparkSession.createDataFrame(list(least.items()), "record_type string, required long")
    found = records.groupBy("record_type").agg(F.count("*").alias("found"))
    return wanted.join(found, "record_type", "left").select("record_type", "required", F.coalesce("found", F.lit(-1).cast("long")).alias("found")).where("found < required")


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, link): each page's distinct local links, sorted within the page; absolute ones and anchors are left out."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|src)=["']([^"']+)["']"""), F.lit(1))))
    return pages.select(key, F.explode(found).alias("link")).where("not contains(link, '://') and not startswith(link, '#')")


def primary_variant(source_line="source_line", bounded="bounded", line_width="line_width", path="path_fidelity", background="background", tables="tables", widths="kept_widths", reflowed="reflowed", converted="converted", overlay="overlay") -> Column:
    """Which of a page's variants is reviewed, by difference ratios (null as 1) and counts; later rules win."""
    r = {n: F.coalesce(n, F.lit(1.0)) for n in (source_line, bounded, line_width, path, background)}
    first = F.when((r[source_line] + 0.005 < r[bounded]) | ((F.col(widths) > 0) & (F.col(reflowed) > 0) & (r[source_line] <= r[bounded] + 0.005)), "source_line_preserving")
    first = first.when((F.col(converted) == 0) & (F.col(reflowed) == 0), "line_width_preserving").otherwise("bounded_textbox")
    least = F.least(r[line_width], r[source_line], r[bounded])
    return (
        F.when(F.col(overlay), "ocr_editable_overlay")
        .when((F.col(tables) == 0) & F.col(background).isNotNull() & (r[background] <= F.least(least, r[path])), "source_render_background_hidden_editable_text")
        .when((F.col(tables) == 0) & F.col(path).isNotNull() & (r[path] + 0.002 < least), "path_fidelity_hidden_editable_text").otherwise(first)
    )
