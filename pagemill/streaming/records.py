"""Record builders on streams: the same projections over a folder that grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def record_stream(spark: SparkSession, path: str, schema: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Records of every new JSON-lines file in ``path``."""
    return build(spark.readStream.schema(schema).json(path))


def write_stream(records: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to Parquet, each input once; ``once``: what is there now, then stop."""
    w = records.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start(path)
