"""A corpus from documents to training sequences: five stages, each of one operator, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import jaccard, labelled, mixing, packing, quality, secrets
from pagemill.llm.common import cut, shared_dir, table
from pagemill.llm.encoding import tokenizer_path
from pagemill.llm.queries import BYTE_TOKENIZER


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labelled ones of ``docs``, doesn't reject."""
    model = quality.QualityModel(*labelled.training_rows(docs, table(spark, sf_dir, "labels"), "quality", quality.TRAINING_ROWS))
    return labelled.kept(docs, model, quality.THRESHOLD)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; rows that are equal in every column stay once.

    Rows that share an id stay or go together: those that differ in any column all stay. A null id is in no other's group and stays, if its
    group has no id.
    """
    first = jaccard.jaccard_components(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.join(cut(first), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    # equal rows have equal ids, so only rows of a repeated id are looked at as a whole
    names = [f"`{n}`" for n in docs.columns]
    marked = rows.select("*", F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias("__h"))
    return marked.dropDuplicates(["doc_id", "__h"]).select(*names)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by a mark."""
    return secrets.redacted(docs, f"{shared_dir(spark)}/ledger")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated rows, and none of those it doesn't take."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    return packing.pack(docs, tokenizer_path(BYTE_TOKENIZER))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_duplicates),
    ("secret scan", without_secrets),
    ("source mixing", mixed_sources),
    ("packing", packed_sequences),
]
#: None: neither a trained network nor a tokenizer can be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
