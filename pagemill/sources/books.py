"""Books of page manifests, indexes of records and intake manifests as Spark data sources whose files appear together or not at all.

``page_book``: a book manifest (JSON: ``pages``, each with ``page`` and ``manifest``) leads to one JSON document a page. Reading plans its
partitions from the book manifest alone, after filters on ``page`` have been pushed into it, and opens page manifests in the tasks.
``record_index``: records as JSON lines with their counts and hashes in one manifest.
``intake_manifest``: the same of registry entries, under an envelope of version, batch and time.

A task writes files of its own and tells the driver in its commit message what they hold; only when all have succeeded does the driver put
the manifest in place, by one rename. Files that no manifest names don't exist for readers; a failed job removes its own, and
``vacuum`` what tasks wrote that ended after it. Paths are those of a folder that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BOOK, INDEX, INTAKE = "page_book", "record_index", "intake_manifest"
ENTRY = "page int, manifest string, ord int, entry string"
#: Pages of a partition.
PAGES = 64
#: Bytes of JSON lines that a reader gives out at once, and of an Arrow batch that a writer takes.
BATCH = 4 << 20


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session and lets filters reach them."""
    for source in (BookSource, IndexSource, IntakeSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a temporary one, on one machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: these files need a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pagemill-")
    return f"{local(root)}/{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of ``BATCH`` bytes at most within; the session's own setting is as it was after."""
    before = spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set(key, f"{BATCH}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _put(path: str, document: dict) -> None:
    """Writes a JSON document under its name at once."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(held := f"{path}.{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
        json.dump(document, f, sort_keys=True, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(held, path)


@dataclass
class Wrote(WriterCommitMessage):
    """What a task has written: (name, facts of the file)."""

    files: list[tuple[str, dict]] = field(default_factory=list)


def _remove(folder: str, names: list[str]) -> None:
    for name in names:
        if os.path.exists(path := os.path.join(folder, name)):
            os.remove(path)


class _Writer(DataSourceWriter):
    """Task files under ``folder``, then ``manifest`` over them. With ``overwrite`` those of the manifest before go, else they stay listed."""

    manifest = ""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.folder, self.names, self.overwrite = local(options["path"]), names, overwrite
        self.run = uuid.uuid4().hex  # the same in every task and in the driver

    def new_name(self, folder: str, suffix: str) -> str:
        os.makedirs(os.path.join(self.folder, folder), exist_ok=True)
        return f"{folder}/{self.run}-{uuid.uuid4().hex}{suffix}"

    def taken(self, iterator: Iterator) -> Iterator:
        return (dict(zip(self.names, r)) for r in iterator)

    def files(self, rows: Iterator, wrote: Wrote) -> None:
        raise NotImplementedError

    def content(self, files: list[tuple[str, dict]]) -> dict:
        raise NotImplementedError

    def listed(self, manifest: dict) -> list[tuple[str, dict]]:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Wrote:
        wrote = Wrote()
        try:
            self.files(self.taken(iterator), wrote)
        except BaseException:
            _remove(self.folder, [n for n, _ in wrote.files])
            raise
        return wrote

    def commit(self, messages: list[Wrote | None]) -> None:
        new = [f for m in messages if m is not None for f in m.files]
        path = os.path.join(self.folder, self.manifest)
        old = self.listed(_json(path)) if os.path.exists(path) else []
        _put(path, self.content(new if self.overwrite else old + new))
        if self.overwrite:
            _remove(self.folder, [n for n, _ in old])

    def abort(self, messages: list[Wrote | None]) -> None:
        # those of tasks that broke off without a message, too
        for folder in ("pages", "records"):
            if os.path.isdir(at := os.path.join(self.folder, folder)):
                _remove(at, [n for n in os.listdir(at) if n.startswith(f"{self.run}-")])


def vacuum(path: str) -> list[str]:
    """Removes the files under a folder that its manifest doesn't name; returns them. Not while a job writes there."""
    folder, listed = local(path), set()
    for kind in (_BookWriter, _IndexWriter, _IntakeWriter):
        if os.path.exists(at := os.path.join(folder, kind.manifest)):
            listed |= {name for name, _ in kind.listed(None, _json(at))}
    there = [f"{d}/{n}" for d in ("pages", "records") if os.path.isdir(os.path.join(folder, d)) for n in os.listdir(os.path.join(folder, d))]
    _remove(folder, gone := sorted(set(there) - listed))
    return gone


# --- books ------------------------------------------------------------------------------------------------------------


class _Pages(InputPartition):
    def __init__(self, pages: list[tuple[int, str]]):
        super().__init__(pages)


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class _BookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.name, self.pages = local(options["path"]), options.get("list", "entries"), int(options.get("pages", PAGES))
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("page",):
                self.filters.append((_TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """By the book manifest alone, pages in order; those that a filter rules out are never opened."""
        if not isinstance(book := _json(self.path), dict) or not isinstance(pages := book.get("pages", []), list):
            raise ValueError(f"{self.path}: pages must be a list")
        folder = os.path.dirname(self.path)
        listed = sorted((int(p.get("page") or 0), os.path.join(folder, p["manifest"])) for p in pages if isinstance(p, dict))
        listed = [p for p in listed if all(test(p[0], value) for test, value in self.filters)]
        return [_Pages(listed[i : i + self.pages]) for i in range(0, len(listed), self.pages)] or [_Pages([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page, path in partition.value:
            document = _json(path)
            entries = document.get(self.name) if isinstance(document, dict) else None
            if not isinstance(entries, list):
                raise ValueError(f"{path}: manifest {self.name} must be a list")
            for k, entry in enumerate(entries):
                if isinstance(entry, dict):
                    yield page, path, k, json.dumps(entry, sort_keys=True, ensure_ascii=False)


class _BookWriter(_Writer):
    """One document for each row (page, document: a JSON object), named in the book manifest with its hash."""

    manifest = "book_manifest.json"

    def files(self, rows, wrote):
        for r in rows:
            name = self.new_name("pages", f"-{r['page']}.json")
            if not isinstance(json.loads(r["document"]), dict):
                raise ValueError(f"page {r['page']}: a page manifest must be an object")
            data = r["document"].encode()
            wrote.files.append((name, {"page": r["page"], "sha256": hashlib.sha256(data).hexdigest()}))
            with open(os.path.join(self.folder, name), "wb") as f:
                f.write(data)

    def content(self, files):
        return {"page_count": len(files), "pages": [facts | {"manifest": name} for name, facts in sorted(files, key=lambda x: (x[1]["page"], x[0]))]}

    def listed(self, manifest):
        return [(p["manifest"], {k: v for k, v in p.items() if k != "manifest"}) for p in manifest["pages"]]


class BookSource(DataSource):
    @classmethod
    def name(cls):
        return BOOK

    def schema(self):
        return ENTRY

    def reader(self, schema):
        return _BookReader(self.options)

    def writer(self, schema, overwrite):
        return _BookWriter(self.options, schema.names, overwrite)


def write_book(pages: DataFrame, path: str) -> str:
    """Writes (page, document) under the folder ``path``; returns the book manifest's path."""
    register(pages.sparkSession)
    pages.select("page", "document").write.format(BOOK).mode("overwrite").save(path)
    return f"{local(path)}/{_BookWriter.manifest}"


def book_entries(spark: SparkSession, manifest: str, of: str = "entries", pages: int = PAGES) -> DataFrame:
    """(page, manifest, ord, entry) of every object in the list ``of`` of a book's page manifests, as JSON with its keys in order.

    A page manifest whose list isn't one fails the read; what isn't an object in it is left out; a book without pages has none.
    """
    register(spark)
    return spark.read.format(BOOK).option("list", of).option("pages", pages).load(manifest)


# --- record indexes ---------------------------------------------------------------------------------------------------


def json_lines(batch: pa.RecordBatch, names: list[str]) -> pa.LargeStringArray:
    """Of every row the line that ``json.dumps`` with keys in order gives; strings are quoted once for all rows of the batch that have them."""
    parts = []
    for k, name in sorted(enumerate(names), key=lambda x: x[1]):
        column = batch.column(k)
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            coded = column.dictionary_encode()
            values = pa.array(map(json.encoder.encode_basestring, coded.dictionary.to_pylist()), pa.large_string()).take(coded.indices)
        elif pa.types.is_integer(column.type):
            values = column.cast(pa.large_string())
        else:
            values = pa.array([json.dumps(x, sort_keys=True, ensure_ascii=False) for x in column.to_pylist()], pa.large_string())
        parts += [pa.scalar(f"{', ' if parts else '{'}{json.dumps(name, ensure_ascii=False)}: ", pa.large_string()), pc.fill_null(values, "null")]
    return pc.binary_join_element_wise(*parts, pa.scalar("}\n", pa.large_string()), pa.scalar("", pa.large_string()))


class _IndexWriter(_Writer, DataSourceArrowWriter):
    """Records as JSON lines with keys in order; the manifest has files, hashes and counts by type from the tasks' own messages."""

    manifest = "manifest.json"

    def __init__(self, options, names, overwrite):
        super().__init__(options, names, overwrite)
        self.version, self.kind = options.get("version", "v1"), options.get("type", "record_type")

    def taken(self, iterator):
        return (batch for batch in iterator if batch.num_rows)

    def files(self, rows, wrote):
        first = next(rows, None)
        if first is None:
            return
        name = self.new_name("records", ".jsonl")
        facts = {"records": 0, "bytes": 0, "counts": {}}
        wrote.files.append((name, facts))
        sha = hashlib.sha256()
        with open(os.path.join(self.folder, name), "wb") as f:
            while first is not None:
                lines = "".join(json_lines(first, self.names).to_pylist()).encode()
                f.write(lines)
                sha.update(lines)
                kinds = first.column(self.names.index(self.kind)).value_counts().to_pylist() if self.kind in self.names else [{"values": None, "counts": first.num_rows}]
                facts["records"] += first.num_rows
                facts["bytes"] += len(lines)
                for x in kinds:
                    kind = str(x["values"])
                    facts["counts"][kind] = facts["counts"].get(kind, 0) + x["counts"]
                first = next(rows, None)
        facts["sha256"] = sha.hexdigest()

    def content(self, files):
        counts: dict[str, int] = {}
        for _, facts in files:
            for k, n in facts["counts"].items():
                counts[k] = counts.get(k, 0) + n
        return {"schema_version": self.version, "status": "PASS", "record_count": sum(f["records"] for _, f in files), "record_counts": counts, "files": [f | {"name": n} for n, f in sorted(files)]}

    def listed(self, manifest):
        return [(f["name"], {k: v for k, v in f.items() if k != "name"}) for f in manifest["files"]]


class _IndexReader(DataSourceReader):
    """One partition for each listed file, whose hash must be the manifest's."""

    def __init__(self, options: dict, schema: StructType, manifest: str):
        self.folder, self.names, self.manifest = local(options["path"]), schema.names, manifest
        self.kinds = to_arrow_schema(schema)

    def partitions(self):
        return [InputPartition((f["name"], f["sha256"])) for f in _json(os.path.join(self.folder, self.manifest))["files"]] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        name, wanted = partition.value
        sha = hashlib.sha256()
        held, size = [], 0
        with open(os.path.join(self.folder, name), "rb") as f:
            for line in f:
                sha.update(line)
                record = json.loads(line)
                held.append([record.get(n) for n in self.names])
                size += len(line)
                if size >= BATCH:
                    yield self.batch(held)
                    held, size = [], 0
        if held:
            yield self.batch(held)
        if sha.hexdigest() != wanted:
            raise ValueError(f"{name} isn't what the manifest says")

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        """Arrow batches of ``BATCH`` bytes: of rows one by one, Spark's worker would hold 10,000, however long."""
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.kinds)], schema=self.kinds)


class IndexSource(DataSource):
    @classmethod
    def name(cls):
        return INDEX

    def reader(self, schema):
        return _IndexReader(self.options, schema, _IndexWriter.manifest)

    def writer(self, schema, overwrite):
        return _IndexWriter(self.options, schema.names, overwrite)


def write_records(records: DataFrame, path: str, version: str, append: bool = False) -> dict:
    """Writes records of plain columns with a record_type; returns the manifest. All of it or, if a task fails for good, nothing is there."""
    register(records.sparkSession)
    with small_batches(records.sparkSession):
        records.write.format(INDEX).option("version", version).mode("append" if append else "overwrite").save(path)
    return index_manifest(path)


def index_manifest(path: str) -> dict:
    return _json(os.path.join(local(path), _IndexWriter.manifest))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records that the manifest lists."""
    register(spark)
    return spark.read.format(INDEX).schema(schema).load(path)


# --- intake manifests -------------------------------------------------------------------------------------------------


class _IntakeWriter(_IndexWriter):
    """Registry entries as JSON lines; the envelope has version, batch, time, and what the tasks said of their files."""

    manifest = "intake_manifest.json"

    def __init__(self, options, names, overwrite):
        super().__init__({**options, "type": "intake_state"}, names, overwrite)
        self.envelope = {n: options.get(n) for n in ("manifest_version", "batch_id", "generated_at")}

    def content(self, files):
        index = super().content(files)
        return self.envelope | {"entry_count": index["record_count"], "state_counts": index["record_counts"], "files": index["files"]}


class IntakeSource(IndexSource):
    @classmethod
    def name(cls):
        return INTAKE

    def reader(self, schema):
        return _IndexReader(self.options, schema, _IntakeWriter.manifest)

    def writer(self, schema, overwrite):
        return _IntakeWriter(self.options, schema.names, overwrite)


def write_entries(entries: DataFrame, path: str, version: str, batch_id: str, generated_at: str) -> dict:
    """Writes registry entries and, when all are there, their envelope, which it returns."""
    register(entries.sparkSession)
    with small_batches(entries.sparkSession):
        entries.write.format(INTAKE).option("manifest_version", version).option("batch_id", batch_id).option("generated_at", generated_at).mode("overwrite").save(path)
    return envelope(path)


def envelope(path: str) -> dict:
    """An intake manifest without its entries."""
    return _json(os.path.join(local(path), _IntakeWriter.manifest))


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries that the envelope's files hold; a file whose hash isn't the envelope's fails the read."""
    register(spark)
    return spark.read.format(INTAKE).schema(schema).load(path)
