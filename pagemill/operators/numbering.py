"""Numbers over a whole table, and dictionaries whose codes count first appearances, without a window into one partition.

Rows are dealt by range and written once; then each part numbers its own rows and adds how many the parts before it hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.books import shared_folder, small_batches


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number", parts: int | None = None) -> DataFrame:
    """Every row with its number from 0, without gaps, by ``order``; rows that are equal in it are numbered as they happen to come, so give a total one.

    ``parts``: how many ranges (the session's shuffle partitions otherwise). The written copy fixes where the ranges end, which a
    second reading of the input might place elsewhere. Only one count a range is gathered, in a window of as many rows.
    """
    spark, names = rows.sparkSession, rows.columns
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    keyed = rows.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"))
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark)
    keyed.repartitionByRange(count, "key").withColumn("part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    own = held.withColumn("own", F.row_number().over(W.partitionBy("part").orderBy("key")).cast("long") - 1)
    return own.join(F.broadcast(before), "part").select(*[F.col("row")[n].alias(n) for n in names], (F.col("before") + F.col("own")).alias(name))


def numbered_paths(files: DataFrame, path: str = "path", order: str = "ord", name: str = "number") -> DataFrame:
    """(path, number) of paths in order of their lower-case form; of paths equal but for case the last by ``order``."""
    last = files.groupBy(F.lower(path).alias("folded")).agg(F.max_by(path, order).alias("path"))
    return numbered(last, ["folded"], name).select("path", name)


def first_seen(values: DataFrame, value: str, order: list[str], name: str = "code") -> DataFrame:
    """(value, ``order``, code): each distinct value with where it stands first and its number, from 0, by first appearance; null has none.

    Each task keeps the first place of its own values, so one value in every row costs one row a task.
    """
    first = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("__first"))
    return numbered(first.select(value, "__first.*"), order, name)


def coded(values: DataFrame, value: str, dictionary: DataFrame, name: str = "code") -> DataFrame:
    """``values`` with the code of each in place of ``value``; a value that the dictionary lacks has a null code."""
    return values.join(dictionary.select(value, name), value, "left").drop(value)


def decoded(codes: DataFrame, value: str, dictionary: DataFrame, name: str = "code") -> DataFrame:
    """``coded`` undone."""
    return codes.join(dictionary.select(name, value), name, "left").drop(name)


def folded_words(texts: DataFrame, key: str, text: str, separator: str) -> DataFrame:
    """(key, word, place, n, places) of each row's distinct words: where one stands first, from 0, how often it occurs, and the sum of its places from 1.

    ``separator`` is an expression that Java and RE2 read alike; empty words count, a null text has none. Split once, and written to the shared
    folder, as a word that a text repeats need not be shuffled for each of its places.
    """

    def fold(batches):
        for batch in batches:
            lists = pc.split_pattern_regex(batch.column(1), separator)
            owner, words = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
            if not len(owner):
                continue
            place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(batch.num_rows))[owner]
            codes = words.dictionary_encode()
            pair = owner.astype(np.int64) * len(codes.dictionary) + codes.indices.to_numpy()
            order = np.argsort(pair, kind="stable")
            begin = np.flatnonzero(np.diff(pair[order], prepend=-1))
            first = order[begin]
            counts = np.diff(begin, append=len(order)), np.add.reduceat(place[order] + 1, begin)
            columns = [batch.column(0).take(pa.array(owner[first])), words.take(pa.array(first)), pa.array(place[first], pa.int32()), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "word", "place", "n", "places"])

    path, kind = shared_folder(texts.sparkSession), texts.schema[key].dataType
    folded = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(fold, f"key {kind.simpleString()}, word string, place int, n long, places long")
    with small_batches(texts.sparkSession):
        folded.withColumnRenamed("key", key).write.parquet(path)
    return texts.sparkSession.read.parquet(path)
