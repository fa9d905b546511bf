"""Readers and writers of the engine's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "record_id string, batch_id string, book_id string, record_type string, text string, page int, artifact_path string, metadata string"


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def exploded(documents: DataFrame, name: str = "entries") -> DataFrame:
    """The array's elements with the documents' other columns; malformed elements, null after parsing, are left out."""
    rest = [c for c in documents.columns if c != name]
    return documents.select(*rest, F.posexplode(name).alias("ord", "e")).where("e is not null").select(*rest, "ord", "e.*")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped; a bad line fails the read (strict) or gives nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, line) of every line that isn't a JSON object. Each file is one row: for files that fit a task."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    return whole.where("trim(line) <> '' and (try_parse_json(line) is null or schema_of_variant(try_parse_json(line)) not like 'OBJECT%')").select("path", (F.col("i") + 1).alias("line_number"), "line")


def binary_files(spark: SparkSession, paths: str | list[str], pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """path, length, content of files by name pattern; empty ones are passed over, as Spark's scan doesn't list them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(paths)
    return files.select("path", "length", "content")


def distinct_paths(files: DataFrame, order: str = "ord") -> DataFrame:
    """(path): of paths equal but for case the last by ``order``."""
    return files.groupBy(F.lower("path").alias("key")).agg(F.max_by("path", order).alias("path")).select("path")


def checksums(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def csv_rows(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.option("header", header).option("mode", "FAILFAST").csv(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def bounds_rows(output: DataFrame) -> DataFrame:
    """(id, x, y, w, h) of lines "id,x,y,w,h"; others are left out."""
    p = output.select(F.split("value", ",").alias("p")).where("size(p) = 5")
    p = p.select(F.col("p")[0].alias("id"), *[F.col("p")[i].try_cast("double").alias(n) for i, n in enumerate("xywh", 1)])
    return p.where("x is not null and y is not null and w is not null and h is not null")


def pages_of(files: DataFrame, reader) -> DataFrame:
    """(path, page, text) of each file by ``reader(bytes) -> list of texts``, a library of the caller's choice."""

    def go(batches):
        import pandas as pd

        for b in batches:
            rows = [(p, i, t) for p, c in zip(b.path, b.content) for i, t in enumerate(reader(c), 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(go, "path string, page int, text string")


def write_lines(records: DataFrame, path: str) -> None:
    """JSON lines with keys in order."""
    records.select(*sorted(records.columns)).write.json(path)


def write_index(records: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines to ``path``/records and the counts by type, which it returns, to ``path``/manifest."""
    write_lines(records, f"{path}/records")
    counts = records.groupBy("record_type").agg(F.count("*").alias("records"))
    counts.write.json(f"{path}/manifest")
    return counts.sparkSession.read.schema("record_type string, records long").json(f"{path}/manifest")


def write_vector_index(index: DataFrame, path: str, info: dict) -> int:
    """Chunks as Parquet and one row about them; returns the number of chunks."""
    index.write.parquet(f"{path}/chunks")
    n = index.sparkSession.read.parquet(f"{path}/chunks").count()
    index.sparkSession.createDataFrame([(info["provider"], info["model"], info["dimensions"], info["fingerprint"], n)], "provider string, model string, dimensions int, fingerprint string, chunk_count long").write.json(f"{path}/info")
    return n


def inside(path: str, root: str) -> bool:
    import os

    path, root = os.path.realpath(path), os.path.realpath(root)
    return path == root or path.startswith(root.rstrip(os.sep) + os.sep)


def write_private(df: DataFrame, path: str, root: str) -> None:
    """JSON lines, but nowhere outside ``root``."""
    if not inside(path, root):
        raise ValueError(f"{path} is outside the private folder")
    write_lines(df, path)


def workspace_class(path: str, private: str, public: str) -> str:
    return "private" if inside(path, private) else "public" if inside(path, public) else "external"


def required_columns(df: DataFrame, names: list[str]) -> list[str]:
    return sorted(set(names) - set(df.columns))


SPAN = T.StructType([T.StructField(n, k) for n, k in (("text", T.StringType()), ("font", T.StringType()), ("size_pt", T.DoubleType()), ("bold", T.BooleanType()), ("italic", T.BooleanType()), ("color", T.StringType()), ("flags", T.IntegerType()))])
