"""Upkeep of a vector index: only what changed is embedded, what went is marked, and one provider's vectors are never mixed with another's.

An index is a folder of generations. Each has the hashes of records that are new or changed since (``records``; one whose text is empty has
no chunk), their chunks (``chunks``) and the hashes of those that went or changed (``gone``); ``index.json`` lists them and is replaced at once,
so readers see the index before an update or after it. A record and its chunks count while no later generation names its hash as gone.
``compact`` writes what counts as one generation.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.books import _json, _put, local, small_batches
from .retrieval import vector_index

_INFO = "index.json"


def record_hash(records: DataFrame) -> DataFrame:
    """Records with ``record_hash``, of all their columns; equal ones once, so that a repeated record is embedded once."""
    names = sorted(records.columns)
    whole = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})
    return records.withColumn("record_hash", F.sha2(whole, 256)).dropDuplicates(["record_hash"])


def info(path: str) -> dict | None:
    return _json(at) if os.path.exists(at := os.path.join(local(path), _INFO)) else None


def _guard(said: dict, provider) -> None:
    if said["fingerprint"] != provider.info["fingerprint"]:
        raise ValueError(f"the index holds vectors of {said['fingerprint']}, not of {provider.info['fingerprint']}: rebuild it")


def live(spark: SparkSession, path: str, what: str = "chunks") -> DataFrame:
    """The chunks that count, with ``generation``; or, of the same form, ``what="records"``: (record_hash) of every record."""
    said = info(path)
    out = gone = None
    for g in said["generations"]:
        if what == "records" and "records" not in g:  # written before generations listed their records
            rows = spark.read.parquet(f"{local(path)}/{g['folder']}/chunks").select("record_hash").distinct()
        else:
            rows = spark.read.parquet(f"{local(path)}/{g['folder']}/{what}")
        rows = rows.withColumn("generation", F.lit(g["number"]))
        out = rows if out is None else out.unionByName(rows)
        if g["gone"]:
            names = spark.read.parquet(f"{local(path)}/{g['folder']}/gone").withColumn("until", F.lit(g["number"]))
            gone = names if gone is None else gone.unionByName(names)
    if gone is None:
        return out
    last = gone.groupBy("record_hash").agg(F.max("until").alias("until"))
    return out.join(last, "record_hash", "left").where("until is null or generation >= until").drop("until")


def changes(records: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to embed, names to mark as gone): anti-joins of record hashes, both ways."""
    now = record_hash(records)
    known = held.select("record_hash").distinct()
    return now.join(known, "record_hash", "left_anti"), known.join(now.select("record_hash"), "record_hash", "left_anti")


def update(records: DataFrame, path: str, provider, most: int = 1400) -> dict:
    """Brings the index at ``path`` up to date with ``records`` (record_id, text, more), or makes it; returns how many records were
    embedded (those without text too, which take no chunk) and marked as gone, and how many chunks count now. An index of another
    provider, or other chunk sizes, is refused."""
    spark = records.sparkSession
    said = info(path)
    if said is None:
        said = {"fingerprint": provider.info["fingerprint"], "provider": provider.info, "max_chars": most, "generations": []}
        new, gone = record_hash(records), None
    else:
        _guard(said, provider)
        if said["max_chars"] != most:
            raise ValueError(f"the index has chunks of {said['max_chars']} characters, not {most}: rebuild it")
        new, gone = changes(records, live(spark, path, "records"))
    number = max((g["number"] for g in said["generations"]), default=-1) + 1
    folder = f"{number:06d}-{uuid.uuid4().hex}"
    with small_batches(spark):
        vector_index(new, provider, most).write.parquet(f"{local(path)}/{folder}/chunks")
    new.select("record_hash").write.parquet(f"{local(path)}/{folder}/records")
    chunks, embedded = (spark.read.parquet(f"{local(path)}/{folder}/{x}").count() for x in ("chunks", "records"))
    marked = 0
    if gone is not None:
        gone.write.parquet(f"{local(path)}/{folder}/gone")
        marked = spark.read.parquet(f"{local(path)}/{folder}/gone").count()
    said["generations"].append({"number": number, "folder": folder, "gone": marked, "chunks": chunks, "records": embedded})
    _put(os.path.join(local(path), _INFO), said)
    return {"embedded": embedded, "gone": marked, "chunks": live(spark, path).count()}


def compact(spark: SparkSession, path: str) -> dict:
    """One generation of all that counts; the old folders stay until ``sweep``, for readers that still hold them."""
    said = info(path)
    number = said["generations"][-1]["number"] + 1
    folder = f"{number:06d}-{uuid.uuid4().hex}"
    counts = {}
    for what in ("chunks", "records"):
        live(spark, path, what).drop("generation").write.parquet(f"{local(path)}/{folder}/{what}")
        counts[what] = spark.read.parquet(f"{local(path)}/{folder}/{what}").count()
    _put(os.path.join(local(path), _INFO), said | {"generations": [{"number": number, "folder": folder, "gone": 0} | counts]})
    return info(path)


def search(spark: SparkSession, path: str, query: str, provider, limit: int = 10) -> DataFrame:
    """``vector_search`` over the chunks that count, by the provider that made them."""
    from .retrieval import vector_search

    _guard(info(path), provider)
    return vector_search(live(spark, path), query, provider, limit)
