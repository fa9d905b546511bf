"""Intake from files to checked recognition records."""

import hashlib
import json
from pathlib import PurePosixPath

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.operators import intake
from pagemill.sources import books, files

NAMES = ["b/Two (x).pdf", "a b/z.pdf", "a/z.pdf", "a-b/q.pdf", "a/Z.pdf", "note.txt", "ä/ß.pdf", "b/--.pdf", "a/z/deep.pdf", "UP.PDF"]


@pytest.fixture()
def folder(tmp_path):
    for k, name in enumerate(NAMES):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(f"page {k % 3}\fand {k % 3} more".encode())
    return tmp_path


def test_inventory_of_files(spark, folder):
    root = str(folder / "in")
    found = files.binary_files(spark, root, "*")
    made = intake.inventory(found, "c", root, pages=lambda c: c.count(b"\f") + 1)
    head = intake.write_inventory(made, str(folder / "m"), "b")
    got = {r["index"]: r for r in intake.read_inventory(spark, str(folder / "m")).collect()}
    want = sorted((PurePosixPath(n) for n in NAMES if n.endswith(".pdf")), key=lambda p: p.parts)
    assert [got[i].source_path for i in range(len(got))] == [str(p) for p in want]
    for i, p in enumerate(want):
        data = (folder / "in" / p).read_bytes()
        assert (got[i].sha256, got[i].file_size_bytes, got[i].page_count) == (hashlib.sha256(data).hexdigest(), len(data), data.count(b"\f") + 1)
        assert got[i].evidence_paths == [] and got[i].blocked_reason is None and got[i].display_name == got[i].book_id
    by_path = {r.source_path: r.book_id for r in got.values()}
    assert by_path["b/Two (x).pdf"] == "two-x" and by_path["b/--.pdf"] == "source-document"
    assert head["entry_count"] == len(want) and head["state_counts"] == {"registered": len(want)} and head["batch_id"] == "b" and head["generated_at"].endswith("Z")
    messages = {(r.path, r.message) for r in intake.inventory_issues(spark, str(folder / "m")).collect()}
    also = {}
    expected = set()
    for i in range(len(got)):
        if also.get(got[i].sha256, got[i].book_id) != got[i].book_id:
            expected.add((f"entries[{i}].sha256", f"duplicate source hash also used by {also[got[i].sha256]}"))
        also[got[i].sha256] = got[i].book_id
    assert messages == expected != set()


def test_empty_files_are_passed_over(spark, tmp_path):
    """Spark's scan doesn't list them."""
    (tmp_path / "a.pdf").write_bytes(b"")
    (tmp_path / "b.pdf").write_bytes(b"x")
    assert [r.source_path for r in intake.inventory(files.binary_files(spark, str(tmp_path)), "c", str(tmp_path)).collect()] == ["b.pdf"]


def test_row_before_of_equal_keys_in_any_range(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "a", None, f"k{i}"]), rng.choice(["x", "y", "", None])) for i in range(400)]
    before, want = {}, {}
    for i, k, value in rows:
        want[i] = before.get(k)
        before[k] = value
    df = spark.createDataFrame(rows, "n long, k string, v string").repartition(3)
    for size in (1, 7, 100, 1000):
        assert {r.n: r.before for r in intake.previous(df, ["k"], "n", "v", size=size).collect()} == want
    assert intake.previous(df.limit(0), ["k"], "n", "v").count() == 0


def test_recognition_end_to_end(spark, folder):
    root, private = str(folder / "in"), str(folder / "private")
    found = files.binary_files(spark, root, "*")
    intake.write_inventory(intake.inventory(found, "c", root), str(folder / "m"), "b")
    entries = intake.read_inventory(spark, str(folder / "m"))
    reader = lambda c: c.decode().split("\f")
    with pytest.raises(ValueError, match="private workspace"):
        intake.write_recognized(entries, found, root, reader, str(folder / "public"), private)
    manifest = intake.write_recognized(entries, found, root, reader, f"{private}/ocr", private)
    pages = books.read_records(spark, f"{private}/ocr", intake.PAGE).collect()
    assert manifest["record_count"] == len(pages) == sum(len(reader((folder / "in" / n).read_bytes())) for n in NAMES if n.endswith(".pdf"))
    for r in pages:
        assert r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r.char_count == len(r.text) and r.confidence == (1.0 if r.text.strip() else 0.0)
    assert intake.recognized_issues(spark, f"{private}/ocr").count() == 0
    with pytest.raises(Exception, match="no such source file"):
        intake.write_recognized(entries.withColumn("source_path", F.concat("source_path", F.lit("x"))), found, root, reader, f"{private}/none", private)
    assert not (folder / "private" / "none" / "manifest.json").exists()


def test_broken_records_and_empty_inventories(spark, tmp_path):
    row = dict(schema_version=intake.OCR_VERSION, corpus_id="c", book_id="b", source_sha256="0" * 64, page_number=1, extraction_method="m", text="t", text_sha256=hashlib.sha256(b"t").hexdigest(), char_count=1, confidence=1.0, record_type="ocr_page")
    rows = [row, row | {"page_number": 0}, row | {"page_number": 2, "char_count": 5, "schema_version": "old"}, row | {"page_number": 3, "confidence": 2.0, "corpus_id": None}]
    books.write_records(spark.createDataFrame(rows, intake.PAGE), str(tmp_path / "r"), "old")
    got = {(r.page_number, r.issue) for r in intake.recognized_issues(spark, str(tmp_path / "r")).collect()}
    assert got == {(None, "unsupported schema_version"), (0, "page_number invalid"), (2, "char_count mismatch"), (2, "schema_version unsupported"), (3, "confidence invalid"), (3, "corpus_id required")}
    none = intake.inventory(spark.createDataFrame([], "path string, length long, content binary"), "c", "/in")
    head = intake.write_inventory(none, str(tmp_path / "e"), "", "old")
    assert head["entry_count"] == 0 and intake.read_inventory(spark, str(tmp_path / "e")).count() == 0
    assert {r.path for r in intake.inventory_issues(spark, str(tmp_path / "e")).collect()} == {"manifest_version", "batch_id"}
    with open(tmp_path / "e" / "intake_manifest.json") as f:
        assert json.load(f)["files"] == []


def test_lines_of_a_batch_are_those_of_json():
    rows = [
        {"b": "a\"\\\n\t\x00\x7f\u2028 ä 😀", "a": 1, "é": -0.0, "l": ["x", None], "t": True}, {"b": None, "a": None, "é": None, "l": None, "t": None},
        {"b": "", "a": -(1 << 63), "é": float("inf"), "l": [], "t": False}, {"b": "", "a": 0, "é": 0.0, "l": ["ä"], "t": True}, {"b": "null", "a": 7, "é": 1e300, "l": ["x"], "t": None},
    ]
    schema = pa.schema([("b", pa.string()), ("a", pa.int64()), ("é", pa.float64()), ("l", pa.list_(pa.string())), ("t", pa.bool_())])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    want = [json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows]
    assert books.json_lines(batch, schema.names).to_pylist() == want and books.json_lines(batch.slice(1, 3), schema.names).to_pylist() == want[1:4]
