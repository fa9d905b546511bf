"""Stand-ins for boxes, words and records over the driver's tables, the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box

BOX = """select user_id as page, event_id as ord, case when event_type = 'error' then 'R' else event_type end as kind,
 cast(event_id % 61 as double) * 9 as x0, cast(event_id % 79 as double) * 3 as y0,
 cast(event_id % 61 as double) * 9 + 20 + value as x1, cast(event_id % 79 as double) * 3 + 12 as y1 from {events}"""
WORD = """select user_id as page, event_id as ord, cast(ts as date) as line_id, event_type as word,
 cast(hour(ts) * 60 + minute(ts) as double) as x0, cast(hour(ts) * 60 + minute(ts) as double) + value / 10 as x1 from {events}"""
RECORD = """select concat('doc', doc_id) as book_id, source as batch_id, 'text_region' as record_type, doc_id as ord, cast(1 + doc_id % 50 as int) as page, text, concat('{{"layout_class":"', lang, '"}}') as metadata from {documents}
 union all select concat('conv', conv_id), role, 'ocr_text', conv_id * 1000 + turn, cast(turn + 1 as int), text, concat('{{"review_role":"', role, '"}}') from {conversations}
 union all select concat('item', item_id), 'benchmark', 'table', item_id, 0, text, '{{}}' from {benchmark}
 union all select concat('page', page_id), 'web', 'page', page_id, cast(page_id as int), html, '{{"classification":"article"}}' from {pages}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = [n for n in ("events", "documents", "conversations", "benchmark", "pages") if f"{{{n}}}" in text]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, BOX).withColumn("box", box())


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, WORD)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, RECORD)
    rid = F.concat_ws("::", "batch_id", "book_id", F.format_string("p%03d", "page"), "record_type")
    return rows.withColumn("record_id", rid)


def duck(view: str) -> str:
    """The view's text for DuckDB, where the tables have their own names."""
    for n in ("events", "documents", "conversations", "benchmark", "pages"):
        view = view.replace(f"{{{n}}}", n)
    return view.replace("{{", "{").replace("}}", "}")
