"""Index upkeep, resolved links, and the whole check of a search index."""

import json
from urllib.parse import unquote

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill import catalog_folds
from pagemill.operators import links, packet, retrieval, vector_store

RECORDS = "record_id string, text string, page int"


class Counting(retrieval.HashProvider):
    """A provider that refuses texts it has no business with."""

    def __init__(self, allowed, dimensions=8):
        super().__init__(dimensions)
        self.allowed = allowed

    def embed(self, text):
        if not any(a in text for a in self.allowed):
            raise ValueError(f"embedded again: {text}")
        return super().embed(text)


def _rows(index):
    return sorted((r.record_id, r.chunk_id, r.text, tuple(r.embedding)) for r in index.collect())


def test_only_changes_are_embedded(spark, tmp_path):
    path = str(tmp_path / "index")
    first = [("a", "alpha one", 1), ("b", "beta two", 2), ("c", "gamma three", 3), ("c", "gamma three", 3)]
    df = lambda rows: spark.createDataFrame(rows, RECORDS)
    assert vector_store.update(df(first), path, retrieval.HashProvider(8)) == {"embedded": 3, "gone": 0, "chunks": 3}
    assert vector_store.update(df(first), path, Counting([])) == {"embedded": 0, "gone": 0, "chunks": 3}
    second = [("a", "alpha one", 1), ("b", "beta changed", 2), ("d", "delta new", 4)]
    assert vector_store.update(df(second), path, Counting(["changed", "new"])) == {"embedded": 2, "gone": 2, "chunks": 3}
    rebuilt = retrieval.vector_index(vector_store.record_hash(df(second)), retrieval.HashProvider(8))
    assert _rows(vector_store.live(spark, path)) == _rows(rebuilt)
    assert vector_store.update(df(first), path, Counting(["beta two", "gamma"])) == {"embedded": 2, "gone": 2, "chunks": 3}  # what was gone comes back
    before = _rows(vector_store.live(spark, path))
    assert len(vector_store.compact(spark, path)["generations"]) == 1 and _rows(vector_store.live(spark, path)) == before
    assert vector_store.update(df([]), path, Counting([])) == {"embedded": 0, "gone": 3, "chunks": 0}


def test_records_without_text_count(spark, tmp_path):
    path, provider = str(tmp_path / "index"), retrieval.HashProvider(8)
    df = lambda rows: spark.createDataFrame(rows, RECORDS)
    first = [("a", "alpha one", 1), ("b", None, 2), ("c", "", 3), ("d", " \n ", 4)]
    assert vector_store.update(df(first), path, provider) == {"embedded": 4, "gone": 0, "chunks": 1}
    assert vector_store.update(df(first), path, provider) == {"embedded": 0, "gone": 0, "chunks": 1}
    assert vector_store.update(df([*first[:2], ("c", "gamma", 3)]), path, provider) == {"embedded": 1, "gone": 2, "chunks": 2}
    assert vector_store.compact(spark, path)["generations"][0]["records"] == 3
    assert vector_store.update(df(first), path, provider) == {"embedded": 2, "gone": 1, "chunks": 1}


def test_index_upkeep_counts_documents_without_text(spark, tmp_path):
    docs = [(i, None if i % 9 == 1 else "" if i % 9 == 2 else " \n " if i % 9 == 3 else f"text {i}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog_folds.index_upkeep(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(con.execute(catalog_folds._SQL["index_upkeep"]).fetchall()) and ("first", 60, 0, 0) in got


def test_fingerprints_are_not_mixed(spark, tmp_path):
    path = str(tmp_path / "index")
    df = spark.createDataFrame([("a", "alpha", 1)], RECORDS)
    vector_store.update(df, path, retrieval.HashProvider(8))
    with pytest.raises(ValueError, match="rebuild it"):
        vector_store.update(df, path, retrieval.HashProvider(16))
    with pytest.raises(ValueError, match="rebuild it"):
        vector_store.search(spark, path, "alpha", retrieval.HashProvider(16))
    with pytest.raises(ValueError, match="chunks of 1400"):
        vector_store.update(df, path, retrieval.HashProvider(8), 100)
    assert vector_store.search(spark, path, "alpha", retrieval.HashProvider(8)).count() == 1


def test_resolved(spark):
    cases = {"b.html": "s/b.html", "./x/../%62.html?q=1#f": "s/b.html", "/b.html": "b.html", "../b.html": "b.html", "../../b.html": None, "a+b%20c.html": "s/a+b c.html", "100%.html": "s/100%.html", "?q": "s/a.html", "x//y/": "s/x/y", "%C3%A9": "s/é"}
    left_out = ["https://x.org/b", "mailto:me@x", "#top", "//cdn/x.js", "javascript:void(0)"]
    html = "".join(f'<a href="{c}">' if i % 2 else f"<img SRC = '{c}'>" for i, c in enumerate([*cases, *left_out, "b.html"]))
    got = links.resolved(spark.createDataFrame([("s/a.html", html), ("s/none.html", None), ("s/empty.html", "")], "path string, html string")).collect()
    assert {r.link: r.target for r in got} == cases and len(got) == len(cases)
    assert unquote("%C3%A9") == "é"
    based = spark.createDataFrame([("s/a.html", '<base href="/t/u/x"><a href="../b">'), ("s/b.html", '<base href="sub/"><a href="c">'), ("s/c.html", '<base href="https://x/"><a href="c">')], "path string, html string")
    assert {r.path: r.target for r in links.resolved(based).collect()} == {"s/a.html": "t/b", "s/b.html": "s/sub/c"}


def test_closure(spark):
    pages = [(f"p{i}", f'<a href="p{i + 1}">' if i not in (4, 9) else '<a href="gone">' if i == 4 else '<a href="p9">') for i in range(12)]
    site = spark.createDataFrame(pages, "path string, html string")
    found = links.resolved(site)
    assert {tuple(r) for r in links.dangling(found, site).collect()} == {("p4", "gone", "link target missing"), ("p11", "p12", "link target missing")}
    assert {r.path for r in links.orphans(found, site).collect()} == {"p0", "p5", "p10"}
    assert {r.path for r in links.unreachable(found, site, "p2").collect()} == {f"p{i}" for i in (0, 1, 5, 6, 7, 8, 9, 10, 11)}
    assert links.unreachable(found, site, "nowhere").count() == 12


def test_held_links_search_pages_once(spark):
    pages = [(f"p{i}", f'<BASE href="/s/"><a href="p{i + 1}">' if i % 3 else f'<a href="p{i + 1}">') for i in range(12)]
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    site = spark.createDataFrame(pages, "path string, html string")
    found = links.held(links.resolved(site.withColumn("html", counted.asNondeterministic()("html"))))
    assert {(r.path, r.target) for r in found.collect()} == {(f"p{i}", f"s/p{i + 1}" if i % 3 else f"p{i + 1}") for i in range(12)}
    searched = seen.value
    assert links.dangling(found, site).count() == 8 and links.orphans(found, site).count() == 8
    assert links.unreachable(found, site, "p0").count() == 10 and seen.value == searched == 12


def test_search_errors(spark):
    record = lambda **more: json.dumps({"schema_version": "v3", "record_id": "r", "book_id": "b", "source_pdf_sha256": "s", "page": 1, "page_id": "p", "record_type": "page", "text": "A text", "artifact_path": "", "metadata": {"review_role": "Judge"}} | more)
    rows = [record(), record(page=7, text="  "), record(page=9, text=""), record(record_type="table", text="", record_id="t1"), record(metadata="{x}"), '{"schema_version": null}']
    df = spark.createDataFrame(list(enumerate(rows, 1)), "n int, j string")
    manifest = {"status": None, "record_count": 6, "record_counts": {"page": 4, "table": 2}}
    got = packet.search_errors(df, "j", "n", "v3", manifest, ("image",), {"page": 5}, ((None, "judge"), ("table", "judge text")), df.limit(0)).orderBy("section", "ord").collect()
    missing = "artifact_path, book_id, metadata, page, page_id, record_id, record_type, source_pdf_sha256, text"
    assert [r.error for r in got] == [
        "search manifest status is not PASS: None", "search manifest count mismatch for : manifest=None index=1", "search manifest count mismatch for table: manifest=2 index=1",
        "record 5 metadata is not an object", f"record 6 missing fields: {missing}", "record 6 has unexpected schema_version: None", "record 6 metadata is not an object",
        "required record type absent: image", "record type page count 4 is below required minimum 5", "page records with empty text: 7, 9", "table records with empty text: t1",
    ]
    none = packet.search_errors(df.limit(0), "j", "n", "v3", None, ("page",), {}, ((None, "x"),)).collect()
    assert [r.error for r in none] == ["required record type absent: page", "query produced no hits: x"]
    assert packet.search_errors(df.limit(1), "j", "n", "v3").count() == 0
