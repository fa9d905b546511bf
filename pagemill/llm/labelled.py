"""The labelled rows that the classifiers of this subpackage learn from, and what both do with a fitted model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket5, slices

OUT = "doc_id long, held_out boolean, score double, predicted int"


#: Bytes of training text that come to the driver at most.
TRAINING_BYTES = 32 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = TRAINING_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``most`` ids whose crc32 modulo 5 isn't 0: those with the least hash of the id.

    In that order they are taken while their texts have ``most_bytes`` bytes together at most. These bounds are the only ones on what a
    model sees. Of several labels of an id the largest counts, of several texts the one of the least hash; null labels and
    ids are left out; a null text is empty. Reruns agree.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (bucket5(F.col("doc_id")) != 0))
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    ids = ids.withColumn("turn", F.xxhash64("doc_id", F.lit(label))).orderBy("turn", "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "turn", "label").agg(F.min(F.struct("h", F.octet_length("text").alias("size"))).alias("x"))
    found = found.select("doc_id", "label", "x.h", "x.size", F.row_number().over(W.orderBy("turn", "doc_id")).alias("turn"))  # ``most`` rows
    taken, total = [], 0
    for r in found.orderBy("turn").collect():
        total += r.size
        if total > most_bytes:
            break
        taken.append((r.doc_id, r.h, r.turn, r.label))
    if not taken:
        return [], np.zeros(0)
    names = docs.sparkSession.createDataFrame(taken, "doc_id long, h long, turn int, label int")
    rows = texts.join(F.broadcast(names), ["doc_id", "h"]).groupBy("turn", "label").agg(F.min("text").alias("text")).toArrow()
    order = np.argsort(rows["turn"].to_numpy())
    return rows["text"].take(pa.array(order)).to_pylist(), rows["label"].to_numpy()[order].astype(np.float64)


def scored(docs: DataFrame, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """``OUT`` for every row: ``scorer`` gets the bytes of texts and where each begins. docs: doc_id, text; others are ignored."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(scorer)

    def score(batches):
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                s = np.clip(np.nan_to_num(model.value(data, at), nan=0.5), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (bucket5(F.col("doc_id")) == 0).alias("held_out"))
    return rows.mapInArrow(score, OUT)


def kept(docs: DataFrame, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more; no row moves between tasks."""
    spark = docs.sparkSession
    model, place = spark.sparkContext.broadcast(scorer), docs.columns.index("text")

    def good(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            at = 0
            for part, data, begins in slices(texts, "text"):
                s = np.nan_to_num(model.value(data, begins), nan=0.5)
                yield batch.slice(at, part.num_rows).filter(pa.array(s >= threshold))
                at += part.num_rows

    return docs.mapInArrow(good, docs.schema)
