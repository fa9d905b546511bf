"""Books and indexes: filters reach planning, and outputs appear together or not at all."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from pagemill.sources import books


@pytest.fixture()
def book(spark, tmp_path):
    rows = [(p, json.dumps({"page": p, "entries": [{"k": i, "é": "x"} for i in range(p % 4)] + [None, 3, "s"], "other": {}})) for p in range(1, 41)]
    return books.write_book(spark.createDataFrame(rows, "page int, document string").repartition(5), str(tmp_path / "book"))


def test_entries(spark, book):
    got = books.book_entries(spark, book).collect()
    assert sorted((r.page, r.ord, r.entry) for r in got) == [(p, i, f'{{"k": {i}, "é": "x"}}') for p in range(1, 41) for i in range(p % 4)]
    listed = books._json(book)
    assert listed["page_count"] == 40 and [p["page"] for p in listed["pages"]] == list(range(1, 41))


def test_filters_reach_the_plan(spark, book):
    """Pages that a filter rules out are never opened: their files may be gone."""
    for p in books._json(book)["pages"]:
        if not 7 <= p["page"] <= 9:
            os.remove(os.path.join(os.path.dirname(book), p["manifest"]))
    df = books.book_entries(spark, book, pages=2).where((F.col("page") >= 7) & (F.col("page") < 10) & F.col("page").isin(7, 9, 30) & F.col("entry").contains("1"))
    assert sorted((r.page, r.ord) for r in df.collect()) == [(7, 1)]
    above = df._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert "entry" in above and "page#" in above and ">= 7" not in above and "< 10" not in above  # what was pushed isn't tested again
    assert df.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="No such file"):
        books.book_entries(spark, book).where("page > 9").collect()


def test_bad_manifests(spark, book, tmp_path):
    with pytest.raises(Exception, match="manifest other must be a list"):
        books.book_entries(spark, book, "other").collect()
    (tmp_path / "none.json").write_text("{}")
    assert books.book_entries(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "odd.json").write_text('{"pages": 3}')
    with pytest.raises(Exception, match="pages must be a list"):
        books.book_entries(spark, str(tmp_path / "odd.json")).collect()


SCHEMA = "record_id string, record_type string, page long, text string"


def _records(spark, n, mark=""):
    kind = F.when(F.col("id") % 3 == 0, "page").when(F.col("id") % 7 == 1, None).otherwise("table")
    return spark.range(n).select(F.concat(F.lit("r"), "id").alias("record_id"), kind.alias("record_type"), F.col("id").alias("page"), F.concat(F.lit(f"é\n{mark}"), "id").alias("text")).repartition(4)


def test_index_round_trip(spark, tmp_path):
    path = str(tmp_path / "index")
    manifest = books.write_records(_records(spark, 100), path, "v3")
    assert manifest["record_count"] == 100 and manifest["record_counts"]["page"] == 34 and sum(manifest["record_counts"].values()) == 100
    back = books.read_records(spark, path, SCHEMA)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in _records(spark, 100).collect()}
    more = books.write_records(_records(spark, 10, "more"), path, "v3", append=True)
    assert more["record_count"] == 110 and books.read_records(spark, path, SCHEMA).count() == 110
    again = books.write_records(_records(spark, 5), path, "v3")
    assert again["record_count"] == 5 and len(os.listdir(f"{path}/records")) == len(again["files"])
    with open(f"{path}/{again['files'][0]['name']}", "a") as f:
        f.write('{"record_id": "forged"}\n')
    with pytest.raises(Exception, match="isn't what the manifest says"):
        books.read_records(spark, path, SCHEMA).collect()
    assert books.write_records(_records(spark, 0), path, "v3")["record_count"] == 0 and books.read_records(spark, path, SCHEMA).count() == 0


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    bad = _records(spark, 100).withColumn("text", F.when(F.col("page") == 57, F.raise_error(F.lit("broken record"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken record"):
        books.write_records(bad, path, "v3")
    assert not os.path.exists(f"{path}/manifest.json")
    before = books.write_records(_records(spark, 20), path, "v3")
    with pytest.raises(Exception, match="broken record"):
        books.write_records(bad, path, "v3")
    assert books._json(f"{path}/manifest.json") == before and books.read_records(spark, path, SCHEMA).count() == 20
    books.vacuum(path)  # what tasks wrote that were still running when the job had failed
    assert books.read_records(spark, path, SCHEMA).count() == 20 and books.vacuum(path) == []
    assert sorted(os.listdir(f"{path}/records")) == sorted(f["name"].split("/")[1] for f in before["files"])


def test_a_failing_page_leaves_no_book(spark, tmp_path):
    rows = spark.createDataFrame([(1, "{}"), (2, "[1]"), (3, "{}")], "page int, document string").repartition(3)
    with pytest.raises(Exception, match="must be an object"):
        books.write_book(rows, str(tmp_path / "book"))
    assert not os.path.exists(tmp_path / "book" / "book_manifest.json")
    books.vacuum(str(tmp_path / "book"))
    assert not os.listdir(tmp_path / "book" / "pages")


def test_reader_gives_batches_of_bounded_size(tmp_path, monkeypatch):
    """An index is read in Arrow batches of few bytes, not row by row in batches of 10,000; all rows come, nulls too."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    monkeypatch.setattr(books, "BATCH", 1000, raising=False)
    lines = [json.dumps({"i": i, "text": "x" * 100 if i % 3 else None}) + "\n" for i in range(200)]
    (tmp_path / "a.jsonl").write_text("".join(lines))
    files = [{"name": "a.jsonl", "sha256": hashlib.sha256("".join(lines).encode()).hexdigest()}]
    (tmp_path / "manifest.json").write_text(json.dumps({"files": files}))
    source = books.IndexSource({"path": str(tmp_path)})
    reader = source.reader(StructType([StructField("i", LongType()), StructField("text", StringType())]))
    got = list(reader.read(reader.partitions()[0]))
    assert len(got) > 10 and all(b.nbytes < 5000 for b in got)
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(i, "x" * 100 if i % 3 else None) for i in range(200)]
